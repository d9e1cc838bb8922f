"""Driver-bound queries: centroids, cosine ranking, best cluster, event clustering."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clustering, similarity
from ..sources.tables import DriverTables
from .registry import query

# Test threshold: at the reference's 0.5 almost every driver vector is a
# singleton, so the clustering query runs at 0.4 (window as in the reference).
TEST_THRESHOLD = 0.4

_CENT_SQL = """
m AS (select l.cluster_id, v.vec_id as article_id, v.embedding as e
      from v_links l join embeddings v on v.vec_id = l.article_id),
p AS (select cluster_id, unnest(e)::DOUBLE as x, generate_subscripts(e, 1) as i from m),
cent AS (select cluster_id, list(x order by i) as centroid
         from (select cluster_id, i, avg(x) as x from p group by cluster_id, i) group by cluster_id)
"""


def _members(t: DriverTables):
    e = t.raw("embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
    return t.links.select("cluster_id", "article_id").join(e, "article_id")


@query("cluster_centroids", "WITH " + _CENT_SQL + """
select cluster_id, list_transform(centroid, lambda x: round_even(x, 6)) as centroid from cent""")
def cluster_centroids(spark, sf_dir):
    c = similarity.centroids(_members(DriverTables(spark, sf_dir)))
    return c.select("cluster_id", F.transform("centroid", lambda x: F.bround(x, 6)).alias("centroid"))


@query("cosine_topk", "WITH " + _CENT_SQL + """,
s AS (select m.cluster_id, m.article_id, list_cosine_similarity(m.e::DOUBLE[], c.centroid) as cos
      from m join cent c on c.cluster_id = m.cluster_id)
select cluster_id, article_id, round_even(cos, 6) as cosine,
  row_number() over (partition by cluster_id order by cos desc, article_id asc) as rank
from s qualify rank <= 5""")
def cosine_topk(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    m = _members(t)
    c = similarity.centroids(m)
    j = m.join(c, "cluster_id").withColumn("cos", similarity.cosine(similarity.to_double("embedding"), "centroid"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("cos"), F.asc("article_id"))
    return j.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= 5) \
        .select("cluster_id", "article_id", F.bround("cos", 6).alias("cosine"), "rank")


@query("best_cluster_for_vector", "WITH " + _CENT_SQL + """,
c AS (select cent.cluster_id, cent.centroid from cent join v_clusters k on k.id = cent.cluster_id
      where k.created_at >= (select as_of from v_asof) - INTERVAL 72 HOUR),
s AS (select m.article_id as id, c.cluster_id, list_cosine_similarity(m.e::DOUBLE[], c.centroid) as sim
      from m, c)
select id, arg_max(cluster_id, (sim, -cluster_id)) as cluster_id, round_even(max(sim), 6) as similarity
from s where sim >= 0.5 group by id""")
def best_cluster_for_vector(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    m = _members(t)
    c = similarity.centroids(m).join(t.clusters.select(F.col("id").alias("cluster_id"), "created_at"), "cluster_id")
    v = m.select(F.col("article_id").alias("id"), "embedding")
    b = similarity.best_cluster_for_vectors(v, c, t.as_of(), threshold=0.5, hours=72)
    return b.select("id", "cluster_id", F.bround("similarity", 6).alias("similarity"))


# The sequential pass as a recursive query: one article a step, the live clusters as a list in the order they began.
_SEQUENTIAL_SQL = f"""
o AS MATERIALIZED (
  select row_number() over (order by a.created_at_s, a.id) as k, a.id, a.src, a.created_at_s as t, a.v from (
    select a.id, cast(a.source_id as varchar) as src, strptime(a.published_at, '%Y-%m-%d %H:%M:%S') as created_at_s,
      list_transform(e.embedding, lambda x: cast(x as double)) as v
    from v_articles a join embeddings e on e.vec_id = a.id
    where regexp_matches(coalesce(a.headline, '') || coalesce(a.description, ''), '[^\\s]')) a),
run AS (
  select 0::BIGINT as k, []::STRUCT(root BIGINT, s DOUBLE[], last TIMESTAMP, srcs VARCHAR[])[] as live,
    null::BIGINT as id, null::BIGINT as label, null::DOUBLE as score
  union all
  select k,
    case when best > {TEST_THRESHOLD} then
      list_transform(live, lambda c, i: case when i = list_position(sims, best) then
        {{'root': c.root, 's': list_transform(range(1, len(v) + 1), lambda j: c.s[j] + v[j]), 'last': t, 'srcs': list_append(c.srcs, src)}} else c end)
    else list_append(live, {{'root': id, 's': v, 'last': t, 'srcs': [src]}}) end,
    id, case when best > {TEST_THRESHOLD} then live[list_position(sims, best)].root else id end,
    case when best > {TEST_THRESHOLD} then best else 1.0 end
  from (select *, list_max(sims) as best from (
    select *, list_transform(live, lambda c: case when list_contains(c.srcs, src) then -1.0 else list_cosine_similarity(c.s, v) end) as sims from (
      select o.k, o.id, o.src, o.t, o.v, list_filter(run.live, lambda c: date_diff('microsecond', c.last, o.t) <= 300 * 3600000000) as live
      from run join o on o.k = run.k + 1))))
"""


@query("event_clusters", "WITH RECURSIVE " + _SEQUENTIAL_SQL + """
select label as cluster_id, id as article_id, round_even(score, 6) as similarity_score from run where id is not null""")
def event_clusters(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    links = clustering.event_clusters(t.vectors, threshold=TEST_THRESHOLD)
    return links.select("cluster_id", "article_id", F.bround("similarity_score", 6).alias("similarity_score"))

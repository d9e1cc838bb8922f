"""Driver-bound queries: nested cluster detail, source detail, coverage history."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving, trending, upserts
from ..sources.tables import DriverTables
from .q_writes import _DETAILS_SQL, _details
from . import q_bias, q_serving  # noqa: F401  (their texts are parts of the cards' one)
from .registry import REGISTRY, query


@query("cluster_detail_nested", """
WITH x AS (select l.cluster_id, a.id, s.name, a.published_at, e.category as c, array_to_string(e.cities, ',') as cities,
    try_strptime(a.published_at, '%Y-%m-%d %H:%M:%S') as t,
    row_number() over (partition by l.cluster_id, coalesce(a.source_id, -a.id) order by try_strptime(a.published_at, '%Y-%m-%d %H:%M:%S'), a.id) as rn
  from v_links l join v_articles a on a.id = l.article_id
  left join v_sources s on s.id = a.source_id left join v_entities e on e.article_id = a.id)
select x.cluster_id, any_value(k.title) as title, count(*)::INTEGER as n_articles,
  list(concat_ws('|', x.id, x.name, x.published_at, x.c, x.cities) order by x.t, x.id) as articles
from x join v_clusters k on k.id = x.cluster_id where rn = 1 group by x.cluster_id""")
def cluster_detail_nested(spark, sf_dir):
    """F-17 / J-3: the nested articles of every cluster, each as one text."""
    t = DriverTables(spark, sf_dir)
    d = serving.cluster_detail(t.links, t.articles, t.sources, t.entities, t.clusters)
    shown = F.transform("articles", lambda a: F.concat_ws("|", a["id"], a["source_name"], a["published_at"], a["entities"]["nlp_category"],
                                                         F.array_join(a["entities"]["cities"], ",")))
    return d.select(F.col("id").alias("cluster_id"), "title", F.size("articles").alias("n_articles"), shown.alias("articles"))


@query("source_detail", "WITH " + _DETAILS_SQL + """,
r AS (select source_id, id, published_at, row_number() over (partition by source_id order by published_at desc nulls last, id desc) as rank
      from v_articles qualify rank <= 20),
top AS (select source_id, list(id order by rank) as recent_ids from r group by source_id),
tot AS (select source_id, count(*) as total_articles from v_articles group by source_id)
select s.id as source_id, s.url, s.language, case when d.url is not null then d.name else s.name end as name,
  case when d.url is not null then d.bias else s.bias end as bias, d.owner, d.founded_at, d.hq_location,
  coalesce(tot.total_articles, 0) as total_articles, top.recent_ids
from v_sources s left join details d on d.url = s.url left join tot on tot.source_id = s.id left join top on top.source_id = s.id""")
def source_detail(spark, sf_dir):
    """J-4: all attributes of every source with its newest articles."""
    t = DriverTables(spark, sf_dir)
    sources = upserts.update_source_details(t.sources, _details(t))
    return serving.source_detail(sources, t.articles).select(
        "source_id", "url", "language", "name", "bias", "owner", "founded_at", "hq_location", "total_articles",
        F.transform("recent", lambda a: a["id"]).alias("recent_ids"))


@query("coverage_history", """
WITH c AS (select l.cluster_id, a.created_at as c from v_links l join v_articles a on a.id = l.article_id),
b AS (select distinct cluster_id, unnest([b0, b0 + 1]) as b from (
  select cluster_id, (epoch_us(c) + 21599999999) // 21600000000 as b0 from c)),
k AS (select cluster_id, make_timestamp(b * 21600000000) as t from b),
n AS (select k.cluster_id, k.t, count(*) filter (where c > t - INTERVAL 6 HOUR and c <= t) as r,
    count(*) filter (where c > t - INTERVAL 12 HOUR and c <= t - INTERVAL 6 HOUR) as p
  from k join c using (cluster_id) where t <= (select as_of from v_asof) group by k.cluster_id, k.t)
select cluster_id, t as checked_at, r as recent, p as previous,
  round_even(case when p > 0 then r / p when r > 0 then r::DOUBLE else 0.0 end, 2) as velocity,
  (case when p > 0 then r / p when r > 0 then r::DOUBLE else 0.0 end) > %s as rising
from n""" % trending.fx.TRENDING_VELOCITY)
def coverage_history(spark, sf_dir):
    """L-5: velocity of every cluster at every check, one pass."""
    t = DriverTables(spark, sf_dir)
    return trending.coverage_history(t.links, t.articles, t.as_of())


def _part(name: str) -> str:
    return "(" + REGISTRY[name].sql + ")"


@query("homepage_cards", f"""
WITH pg AS (select id, title from v_clusters order by published_at desc nulls last, id desc limit 30)
select pg.id, pg.title, c.category_label, d.dominant_label, d.dominant_pct
from pg left join {_part("category_label")} c on c.cluster_id = pg.id
left join {_part("dominant_side")} d on d.cluster_id = pg.id""")
def homepage_cards(spark, sf_dir):
    """J-2: the cards of the first page (their age is checked with ``time_ago``)."""
    t = DriverTables(spark, sf_dir)
    cards = serving.cluster_cards(serving.page(t.clusters, 30, 0), t.links, t.articles, t.sources, t.entities, t.as_of())
    return cards.drop("ago")

"""Driver-bound queries of single rows' operations: writes by key, rejects, lookups, displays, location sets."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import dates, labels
from ..operators import notify, serving, similarity, upserts
from ..sources import feeds
from ..sources.tables import DriverTables
from . import sqlgen as S
from .registry import query


@query("location_sets", """
select l.cluster_id, min(c) as country_city, list_sort(list_distinct(list(c))) as cities
from v_links l join v_entities e on e.article_id = l.article_id, unnest(e.cities) as u(c) group by l.cluster_id""")
def location_sets(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.location_sets(t.links, t.entities).select("cluster_id", "country_city", "cities")


@query("mark_processed", """
select a.id, case when l.article_id is not null then (select as_of from v_asof) end as updated_at
from v_articles a left join (select distinct article_id from v_links) l on l.article_id = a.id""")
def mark_processed(spark, sf_dir):
    """H-8: linked articles are processed; an id may come more than once."""
    t = DriverTables(spark, sf_dir)
    ids = t.links.select(F.col("article_id").alias("id"))
    articles = t.articles.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return upserts.mark_processed(articles, ids.unionByName(ids), t.as_of()).select("id", "updated_at")


@query("update_partial", """
WITH d AS (select source as url, doc_id, lang as language, case when lang = 'en' then source || ' ' || doc_id end as name from documents),
ch AS (select url, arg_max(name, doc_id) filter (where name is not null) as name,
         arg_max(language, doc_id) filter (where language is not null) as language from d group by url)
select s.id, s.url, coalesce(ch.name, s.name) as name, coalesce(ch.language, s.language) as language
from v_sources s left join ch on ch.url = s.url""")
def update_partial(spark, sf_dir):
    """H-4: one change row per document, applied in order of its id, so keys repeat with other values; nulls change nothing."""
    t = DriverTables(spark, sf_dir)
    changes = t.raw("documents").select(
        F.col("source").alias("url"), "doc_id", F.col("lang").alias("language"),
        F.when(F.col("lang") == "en", F.concat_ws(" ", "source", "doc_id")).alias("name"))
    return upserts.update_partial(t.sources, changes, "url", ["name", "language"], order="doc_id").select("id", "url", "name", "language")


@query("rejected_registrations", """
select id from v_tokens where id % 5 = 0 or id % 7 = 0""")
def rejected_registrations(spark, sf_dir):
    """B-15: registrations that lack a token (null or empty)."""
    t = DriverTables(spark, sf_dir)
    token = F.when(F.col("id") % 5 == 0, F.lit("")).when(F.col("id") % 7 != 0, F.col("token"))
    return upserts.split_valid_registrations(t.tokens.withColumn("token", token))[1].select("id")


@query("date_display", "select id, substr(published_at, 1, 16) as shown from v_articles")
def date_display(spark, sf_dir):
    return DriverTables(spark, sf_dir).articles.select("id", dates.date_display("published_at").alias("shown"))


@query("custom_outbox", """
select token, platform, 'T' as title, 'B' as body, 'custom' as type from v_tokens where token is not null""")
def custom_outbox(spark, sf_dir):
    """K-4 + K-5: one message of one's own to every active token."""
    t = DriverTables(spark, sf_dir)
    return notify.outbox(notify.custom_message(spark, "T", "B"), t.tokens).select("token", "platform", "title", "body", "type")


@query("delivery_counts", """
select case when id % 3 = 0 then 'failure' else 'success' end as status, count(*) as n from v_tokens group by 1""")
def delivery_counts(spark, sf_dir):
    status = F.when(F.col("id") % 3 == 0, "failure").otherwise("success")
    return notify.delivery_counts(DriverTables(spark, sf_dir).tokens.select(status.alias("status")))


@query("article_lookup", "select id, headline from v_articles where id = 17")
def article_lookup(spark, sf_dir):
    return serving.lookup(DriverTables(spark, sf_dir).articles, "id", 17).select("id", "headline")


@query("clustering_text", f"""
select id, {S.norm_v2('headline')} || '. ' || {S.norm_v2('description')} as text,
  case when category = 'local' then {S.lit(fx.LABEL_LOCAL)} else {S.lit(fx.LABEL_INTERNATIONAL)} end as label from v_articles""")
def clustering_text(spark, sf_dir):
    """C-1 and the local label (E-16) of every article."""
    return DriverTables(spark, sf_dir).articles.select(
        "id", similarity.clustering_text("headline", "description").alias("text"), labels.local_label("category").alias("label"))


@query("list_codec", "select id, cities from v_entities")
def list_codec(spark, sf_dir):
    """A-7: list columns written as JSON text and read again."""
    e = DriverTables(spark, sf_dir).entities.select("id", "cities")
    return feeds.decode_lists(feeds.encode_lists(e, ["cities"]), ["cities"]).select("id", "cities")


@query("list_union", """
WITH w AS (select l.cluster_id, e.article_id, e.cities from v_links l join v_entities e on e.article_id = l.article_id)
select a.article_id as left_id, b.article_id as right_id, list_sort(list_distinct(list_concat(a.cities, b.cities))) as cities
from w a join w b on b.cluster_id = a.cluster_id and b.article_id = a.article_id + 5""")
def list_union(spark, sf_dir):
    """H-9: union of two lists, here of articles of one cluster whose ids are five apart."""
    t = DriverTables(spark, sf_dir)
    w = t.links.select("cluster_id", "article_id").join(t.entities.select("article_id", "cities"), "article_id")
    b = w.select("cluster_id", F.col("article_id").alias("right_id"), (F.col("article_id") - 5).alias("article_id"), F.col("cities").alias("more"))
    return w.join(b, ["cluster_id", "article_id"]).select(
        F.col("article_id").alias("left_id"), "right_id", F.array_sort(serving.set_union(F.col("cities"), F.col("more"))).alias("cities"))

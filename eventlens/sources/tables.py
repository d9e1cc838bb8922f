"""Parquet table scans and the binding of the application tables onto the
driver's test tables (documents, events, embeddings, pages).

Every view is a plain DataFrame plan over the scans, so Catalyst prunes the
columns and pushes filters of the calling query down to the Parquet readers.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Stop words standing in for city names in the test binding of the entities table.
TEST_CITY_WORDS = ["the", "of", "and", "elle", "de", "la", "der", "und", "el"]

# Topic label of the test binding, by id % 6 (5 -> null).
TEST_TOPICS = ["politics", "security", "economy", "sports", "culture"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _source_num(col: str = "source") -> Column:
    return F.expr(f"substr({col}, 4)").cast("int")


def sources_view(documents: DataFrame) -> DataFrame:
    sid = _source_num()
    bias = (
        F.when(sid % 10 == 9, F.lit(None).cast("string"))
        .when((sid % 10).isin(0, 1), F.lit("Pro-SAF"))
        .when((sid % 10).isin(2, 3, 4), F.lit("Oppose-SAF"))
        .otherwise(F.lit("Neutral"))
    )
    return documents.select(
        sid.alias("id"), F.col("source").alias("url"), F.col("source").alias("name"),
        F.lit("ar").alias("language"), bias.alias("bias"),
    ).distinct()


def articles_view(documents: DataFrame, events: DataFrame) -> DataFrame:
    sid = _source_num()
    # the text is cut before the join, so a query that reads no description shuffles none
    d = documents.select(
        "doc_id", "source",
        F.substring_index("text", ".", 1).alias("headline"),
        F.expr("substr(text, length(substring_index(text, '.', 1)) + 2)").alias("description"))
    # the date text stands below the join, too: above it, it keeps semi joins by id from reaching the documents
    e = events.select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published_at"))
    j = d.join(e, d.doc_id == e.event_id, "inner")
    return j.select(
        F.col("doc_id").alias("id"),
        sid.alias("source_id"),
        "headline",
        "description",
        "published_at",
        F.col("ts").alias("created_at"),
        F.when(sid < 13, "international").otherwise("local").alias("category"),
    )


def links_view(embeddings: DataFrame, articles: DataFrame) -> DataFrame:
    v = embeddings.select("vec_id", "label")
    a = articles.select("id")
    return v.join(a, v.vec_id == a.id, "inner").select(
        (F.col("label") * 5 + F.col("vec_id") % 5).alias("cluster_id"),
        F.col("vec_id").alias("article_id"),
        F.lit(1.0).alias("similarity_score"),
    )


def clusters_view(links: DataFrame, articles: DataFrame) -> DataFrame:
    a = articles.select("id", "headline", "source_id", "published_at", "created_at")
    j = links.select("cluster_id", "article_id").join(a, F.col("article_id") == F.col("id"))
    return j.groupBy("cluster_id").agg(
        F.min_by("headline", F.struct("created_at", "id")).alias("title"),
        F.count_distinct("source_id").alias("number_of_sources"),
        F.min("published_at").alias("published_at"),
        F.min("created_at").alias("created_at"),
    ).withColumnRenamed("cluster_id", "id")


def entities_view(articles: DataFrame) -> DataFrame:
    words = F.array(*[F.lit(w) for w in TEST_CITY_WORDS])
    toks = F.split(F.lower("headline"), " ")
    cities = F.array_sort(F.array_distinct(F.filter(toks, lambda x: F.array_contains(words, x))))
    cat = F.when(F.col("id") % 6 == 0, "politics").when(F.col("id") % 6 == 1, "security") \
        .when(F.col("id") % 6 == 2, "economy").when(F.col("id") % 6 == 3, "sports") \
        .when(F.col("id") % 6 == 4, "culture").otherwise(F.lit(None).cast("string"))
    return articles.filter(F.col("id") % 7 != 0).select(
        F.col("id"), F.col("id").alias("article_id"), cities.alias("cities"), cat.alias("category"))


def tokens_view(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("device_id"),
        F.concat(F.lit("tok"), (F.col("event_id") % 50).cast("string")).alias("token"),
        F.when(F.col("event_id") % 3 == 0, "ios").otherwise("android").alias("platform"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("ts")).alias("updated_at"),
    )


class DriverTables:
    """Lazily built application tables over one driver scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def sources(self) -> DataFrame:
        return sources_view(self.raw("documents"))

    @cached_property
    def articles(self) -> DataFrame:
        return articles_view(self.raw("documents"), self.raw("events"))

    @cached_property
    def links(self) -> DataFrame:
        return links_view(self.raw("embeddings"), self.articles)

    @cached_property
    def clusters(self) -> DataFrame:
        return clusters_view(self.links, self.articles)

    @cached_property
    def entities(self) -> DataFrame:
        return entities_view(self.articles)

    @cached_property
    def tokens(self) -> DataFrame:
        return tokens_view(self.raw("events"))

    @cached_property
    def vectors(self) -> DataFrame:
        """Clustering input: linked articles with their embedding (id, source_id, ts, vec)."""
        e = self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        a = self.articles.select("id", "source_id", "headline", "description", "published_at", "created_at")
        return a.join(e, "id")

    def as_of(self) -> Column:
        """Reference instant of time-relative queries: newest linked article (scalar subquery)."""
        a = self.articles.select("id", "created_at")
        return self.links.join(a, F.col("article_id") == F.col("id")).agg(F.max("created_at")).scalar()


# DuckDB text of the same binding; oracle queries are prefixed with it.
ORACLE_VIEWS_SQL = """
v_sources AS (
  select distinct cast(substr(source, 4) as int) as id, source as url, source as name, 'ar' as language,
    case cast(substr(source, 4) as int) % 10
      when 9 then null when 0 then 'Pro-SAF' when 1 then 'Pro-SAF'
      when 2 then 'Oppose-SAF' when 3 then 'Oppose-SAF' when 4 then 'Oppose-SAF'
      else 'Neutral' end as bias
  from documents),
v_articles AS (
  select d.doc_id as id, cast(substr(d.source, 4) as int) as source_id,
    split_part(d.text, '.', 1) as headline,
    substr(d.text, length(split_part(d.text, '.', 1)) + 2) as description,
    strftime(e.ts, '%Y-%m-%d %H:%M:%S') as published_at, e.ts as created_at,
    case when cast(substr(d.source, 4) as int) < 13 then 'international' else 'local' end as category
  from documents d join events e on e.event_id = d.doc_id),
v_links AS (
  select v.label * 5 + v.vec_id % 5 as cluster_id, v.vec_id as article_id, 1.0::DOUBLE as similarity_score
  from embeddings v join v_articles a on a.id = v.vec_id),
v_clusters AS (
  select l.cluster_id as id, arg_min(a.headline, (a.created_at, a.id)) as title,
    count(distinct a.source_id) as number_of_sources,
    min(a.published_at) as published_at, min(a.created_at) as created_at
  from v_links l join v_articles a on a.id = l.article_id group by l.cluster_id),
v_entities AS (
  select id, id as article_id,
    list_sort(list_distinct(list_filter(string_split(lower(headline), ' '),
      lambda x: x in ('the','of','and','elle','de','la','der','und','el')))) as cities,
    case id % 6 when 0 then 'politics' when 1 then 'security' when 2 then 'economy'
                when 3 then 'sports' when 4 then 'culture' else null end as category
  from v_articles where id % 7 <> 0),
v_tokens AS (
  select event_id as id, user_id, 'dev' || user_id as device_id, 'tok' || (event_id % 50) as token,
    case when event_id % 3 = 0 then 'ios' else 'android' end as platform, ts as created_at,
    case when event_id % 4 = 0 then null else ts end as updated_at
  from events where event_type = 'signup'),
v_asof AS (
  select max(a.created_at) as as_of from v_links l join v_articles a on a.id = l.article_id)
"""


def with_views(sql: str) -> str:
    """Prefix an oracle query with the view CTEs (unused CTEs cost nothing)."""
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "WITH RECURSIVE " + ORACLE_VIEWS_SQL.strip() + ",\n" + body[15:]
    if body.lower().startswith("with "):
        return "WITH " + ORACLE_VIEWS_SQL.strip() + ",\n" + body[5:]
    return "WITH " + ORACLE_VIEWS_SQL.strip() + "\n" + body

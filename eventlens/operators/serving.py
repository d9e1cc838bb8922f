"""Serving marts: listings, searches, details and statistics (B-*, G-*, F-6…F-17, J-*).

What the reference does as N+1 loops per cluster and per article becomes a
handful of joins and aggregations over whole tables.  Pages use
``orderBy(...).offset().limit()`` (TakeOrderedAndProject: per-partition
top-k, no full sort); per-group top-k uses a ``row_number`` filter which
Spark plans with a partial WindowGroupLimit before the shuffle, so a hot
group sends at most k rows per map task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..fixed_values import ENTITY_LIST_KEYS
from ..functions.dates import iso_text, parse_iso, parse_ntz
from ..session import materialize
from .bias import bias_side, side_aggregates, side_share


def text_match(col: Column, q: str, mode: str = "contains") -> Column:
    """Q-18: literal substring by default; 'like' / 'ilike' keep the wildcard behaviour."""
    if mode == "like":
        return col.like(f"%{q}%")
    if mode == "ilike":
        return col.ilike(f"%{q}%")
    return col.contains(F.lit(q))


# ---------------------------------------------------------------------------
# B-2 / J-5 article search
# ---------------------------------------------------------------------------
def article_search(articles: DataFrame, sources: DataFrame, category: str | None = None,
                   date_from: str | None = None, date_to: str | None = None,
                   keyword: str | None = None, limit: int = 50, offset: int = 0,
                   mode: str = "contains") -> DataFrame:
    a = articles
    if category is not None:
        a = a.filter(F.col("category") == category)
    pub = parse_iso("published_at")
    if date_from is not None:
        a = a.filter(pub >= parse_iso(F.lit(date_from)))
    if date_to is not None:
        a = a.filter(pub <= parse_iso(F.lit(date_to)))
    if keyword is not None:
        a = a.filter(text_match(F.col("headline"), keyword, mode) | text_match(F.col("description"), keyword, mode))
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    j = a.join(s, "source_id")
    return j.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).offset(offset).limit(limit)


# ---------------------------------------------------------------------------
# B-3 … B-7, G-1, G-2, F-8: cluster listings
# ---------------------------------------------------------------------------
def _clusters_with(links: DataFrame, entities: DataFrame, cond: Column | None) -> DataFrame:
    e = entities if cond is None else entities.filter(cond)
    e = e.select("article_id")
    return links.select(F.col("cluster_id").alias("id"), "article_id").join(e, "article_id").select("id")


def filter_clusters(clusters: DataFrame, links: DataFrame, entities: DataFrame,
                    query: str | None = None, has_entities: bool = False,
                    category: str | None = None, city: str | None = None,
                    topic_map: dict | None = None, mode: str = "contains") -> DataFrame:
    """B-3: the conjunction of the optional filters, each an IN-subquery → left semi join."""
    c = clusters
    if query:
        c = c.filter(text_match(F.col("title"), query, mode))
    if has_entities:
        c = c.join(_clusters_with(links, entities, None), "id", "left_semi")
    if category and category != "all":
        tmap = fx.TOPIC_MAP if topic_map is None else topic_map
        label = tmap.get(category, category)
        c = c.join(_clusters_with(links, entities, F.col("category") == label), "id", "left_semi")
    if city:
        c = c.join(_clusters_with(links, entities, F.array_contains("cities", city)), "id", "left_semi")
    return c


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """G-1: newest first by published date, id breaks ties."""
    return df.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).offset(offset).limit(limit)


def page_with_total(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """G-2 + F-8: the page plus the filtered total (ignoring limit) as a column."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return page(df, limit, offset).withColumn("total", total)


# ---------------------------------------------------------------------------
# Statistics
# ---------------------------------------------------------------------------
def distinct_values(entities: DataFrame, kind: str = "cities", name: str = "city") -> DataFrame:
    """F-9: union of all lists of one kind (explode → distinct), sorted."""
    return entities.filter(F.col(kind).isNotNull()).select(F.explode(kind).alias(name)).distinct().orderBy(name)


def entity_stats(entities: DataFrame) -> DataFrame:
    """F-6: rows with entities, and count per non-null topic."""
    total = entities.agg(F.count(F.lit(1))).scalar()
    return entities.filter(F.col("category").isNotNull()).groupBy("category") \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("total_with_entities", total)


def top_entities(entities: DataFrame, kinds=("cities", "people", "organizations"), k: int = 10) -> DataFrame:
    """F-6 (intended): top-k values per entity kind by frequency (value breaks ties)."""
    parts = [entities.select(F.lit(kind).alias("kind"), F.explode_outer(kind).alias("value"))
             for kind in kinds if kind in entities.columns]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    cnt = u.filter(F.col("value").isNotNull()).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), F.asc("value"))
    return cnt.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def group_count(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """F-7 / F-11: count per key (null is its own group)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def articles_per_cluster(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """F-12 / D-J6: cluster ⋈ link, count per cluster."""
    cnt = links.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"))
    return clusters.select("id", "title").join(cnt, clusters.id == cnt.cluster_id).drop("cluster_id")


def source_recent_articles(sources: DataFrame, articles: DataFrame, k: int = 20) -> DataFrame:
    """G-4 + J-4 for all sources at once: newest k per source, plus the source's total."""
    w = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("published_at"), F.desc("id"))
    top = articles.select("source_id", "id", "headline", "published_at", "category") \
        .withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    totals = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_articles"))
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "bias")
    return top.join(totals, "source_id").join(s, "source_id")


# ---------------------------------------------------------------------------
# Per-cluster article facts
# ---------------------------------------------------------------------------
def cluster_articles(links: DataFrame, articles: DataFrame) -> DataFrame:
    """D-J3: link ⋈ article, with the article order key (published date, id)."""
    a = articles.withColumnRenamed("id", "article_id")
    return links.join(a, "article_id")


def first_article(links: DataFrame, articles: DataFrame) -> DataFrame:
    """G-9: first article of each cluster by (published date, id)."""
    ca = cluster_articles(links, articles)
    key = F.struct(parse_ntz("published_at").alias("t"), F.col("article_id"))
    return ca.groupBy("cluster_id").agg(
        F.min_by(F.struct("article_id", "headline", "description", "published_at"), key).alias("first"))


def earliest_article(links: DataFrame, articles: DataFrame) -> DataFrame:
    """F-14: article with the smallest *parseable* date (first wins); clusters without one drop."""
    ca = cluster_articles(links, articles).withColumn("_t", parse_iso("published_at")) \
        .filter(F.col("_t").isNotNull())
    best = ca.groupBy("cluster_id").agg(
        F.min_by(F.struct("article_id", "headline", "published_at"), F.struct("_t", "article_id")).alias("e"),
        F.count(F.lit(1)).alias("dated"))
    return best.select("cluster_id", "e.article_id", "e.headline", "e.published_at")


def first_publication(links: DataFrame, articles: DataFrame) -> DataFrame:
    """F-13: min parseable date per cluster as ISO text, '' when none parses."""
    ca = cluster_articles(links, articles)
    m = ca.groupBy("cluster_id").agg(F.min(parse_iso("published_at")).alias("_m"))
    return m.select("cluster_id", F.coalesce(iso_text("_m"), F.lit("")).alias("first_date_of_publication"))


def _place(country: str, city: str) -> Column:
    """E-20: 'country/city', or the one there is, or ''."""
    return F.concat_ws("/", country, city)


def location_sets(links: DataFrame, entities: DataFrame) -> DataFrame:
    """F-15 + E-20: distinct cities/countries per cluster and the 'country/city' label.
    Q-13: the smallest value by code point is taken (deterministic)."""
    e = entities.select("article_id",
                        *[F.coalesce(F.col(k), F.array().cast("array<string>")).alias(k)
                          for k in ("cities", "countries") if k in entities.columns])
    if "countries" not in e.columns:
        e = e.withColumn("countries", F.array().cast("array<string>"))
    x = links.select("cluster_id", "article_id").join(e, "article_id")
    city = x.select("cluster_id", F.explode("cities").alias("v"), F.lit("city").alias("k"))
    country = x.select("cluster_id", F.explode("countries").alias("v"), F.lit("country").alias("k"))
    g = city.unionByName(country).groupBy("cluster_id").agg(
        F.min(F.when(F.col("k") == "city", F.col("v"))).alias("city"),
        F.min(F.when(F.col("k") == "country", F.col("v"))).alias("country"),
        F.array_sort(F.collect_set(F.when(F.col("k") == "city", F.col("v")))).alias("cities"),
        F.array_sort(F.collect_set(F.when(F.col("k") == "country", F.col("v")))).alias("countries"))
    return g.select("cluster_id", _place("country", "city").alias("country_city"), "cities", "countries")


def category_label(links: DataFrame, articles: DataFrame, entities: DataFrame) -> DataFrame:
    """F-16 (Q-12): first article topic in article order; else local / international / both."""
    e = entities.select("article_id", F.col("category").alias("topic"))
    ca = cluster_articles(links, articles).join(e, "article_id", "left")
    key = F.struct(parse_ntz("published_at"), F.col("article_id"))
    has_topic = F.col("topic").isNotNull() & (F.col("topic") != "")
    g = ca.groupBy("cluster_id").agg(
        F.min_by(F.when(has_topic, F.col("topic")), F.when(has_topic, key)).alias("topic"),
        F.max((F.col("category") == "local").cast("int")).alias("has_local"),
        F.max((F.col("category") == "international").cast("int")).alias("has_intl"))
    fallback = (F.when((F.col("has_local") == 1) & (F.col("has_intl") == 1), F.lit(fx.LABEL_BOTH))
                .when(F.col("has_intl") == 1, F.lit(fx.LABEL_INTERNATIONAL)).otherwise(F.lit(fx.LABEL_LOCAL)))
    return g.select("cluster_id", F.coalesce(F.col("topic"), fallback).alias("category_label"))


def cluster_detail_rows(links: DataFrame, articles: DataFrame, sources: DataFrame,
                        entities: DataFrame) -> DataFrame:
    """F-17 flat: one row per (cluster, article) with source and entity columns (B-14 defaults)."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"),
                       F.col("url").alias("source_url"), F.col("bias").alias("source_bias"))
    first_ent = entities.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("article_id").orderBy("id"))).filter("_rn = 1")
    ent_cols = [F.coalesce(F.col(k), F.array().cast("array<string>")).alias(k)
                for k in ENTITY_LIST_KEYS if k in entities.columns]
    e = first_ent.select("article_id", F.lit(True).alias("_has"), *ent_cols,
                         F.col("category").alias("nlp_category"))
    ca = cluster_articles(links, articles).join(s, "source_id", "left").join(e, "article_id", "left")
    return ca


def cluster_detail(links: DataFrame, articles: DataFrame, sources: DataFrame,
                   entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """F-17 nested: per cluster an array of article structs in article order.

    A cluster has one article of a source; should the links hold more, the first of each source
    is shown (its limit is applied before the shuffle), so no array is longer than there are sources."""
    rows = cluster_detail_rows(links, articles, sources, entities)
    w = Window.partitionBy("cluster_id", F.coalesce("source_id", -F.col("article_id"))).orderBy(parse_ntz("published_at").asc_nulls_last(), "article_id")
    rows = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 1").drop("_rn")
    ent = [k for k in ENTITY_LIST_KEYS if k in rows.columns]
    art = F.struct(
        parse_ntz("published_at").alias("_t"), F.col("article_id").alias("id"), "headline",
        "description", "published_at", "source_id", "source_name", "source_url", "source_bias",
        "category", "similarity_score",
        F.when(F.col("_has"), F.struct(*ent, "nlp_category")).alias("entities"))
    g = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(art)).alias("articles"))
    g = g.withColumn("articles", F.transform("articles", lambda x: x.dropFields("_t")))
    return clusters.join(g, clusters.id == g.cluster_id).drop("cluster_id")


def source_detail(sources: DataFrame, articles: DataFrame, k: int = 20) -> DataFrame:
    """J-4: a row per source with all its attributes, its number of articles and its newest ``k`` as an array."""
    w = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("published_at"), F.desc("id"))
    top = articles.select("source_id", "id", "headline", "published_at", "category").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    recent = top.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "headline", "published_at", "category"))).alias("recent"))
    totals = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_articles"))
    return sources.withColumnRenamed("id", "source_id").join(totals, "source_id", "left").join(recent, "source_id", "left") \
        .withColumn("total_articles", F.coalesce("total_articles", F.lit(0).cast("long")))


# ---------------------------------------------------------------------------
# G-5 popular clusters
# ---------------------------------------------------------------------------
def popular_clusters(clusters: DataFrame, links: DataFrame, as_of: Column,
                     scan: int = fx.POPULAR_SCAN_LIMIT, hours: float = fx.TRENDING_LOOKBACK_HOURS,
                     min_articles: int = fx.POPULAR_MIN_ARTICLES, top: int = fx.POPULAR_TOP) -> DataFrame:
    """Newest ``scan`` clusters → created within ``hours`` → ≥ ``min_articles`` articles →
    article count desc (ties keep the newest-first order) → top ``top``.  The limit stays
    before the filters: that is the semantics."""
    w = Window.orderBy(F.desc_nulls_last("published_at"), F.desc("id"))
    newest = clusters.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(scan) \
        .withColumn("recent_rank", F.row_number().over(w))
    fresh = newest.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))
    cnt = links.join(fresh.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi") \
        .groupBy("cluster_id").agg(F.count(F.lit(1)).alias("article_count"))
    j = fresh.join(cnt, fresh.id == cnt.cluster_id).drop("cluster_id") \
        .filter(F.col("article_count") >= min_articles)
    return j.orderBy(F.desc("article_count"), F.asc("recent_rank")).limit(top) \
        .select("id", "title", "number_of_sources", "article_count", "created_at")


# ---------------------------------------------------------------------------
# J-1 cluster summaries (mobile listing)
# ---------------------------------------------------------------------------
def cluster_summaries(page_clusters: DataFrame, links: DataFrame, articles: DataFrame,
                      sources: DataFrame, entities: DataFrame, trending: DataFrame | None = None) -> DataFrame:
    """J-1: one flat row per listed cluster that has articles.

    The page and its links are written once, so the planner knows that they are small; one
    join of them with article, source and entities and one aggregation give all the columns but
    the first article's text, which is read for the clusters' first articles only.
    ``trending`` (id, is_trending) overrides the stored flag when given."""
    pg = materialize(page_clusters.withColumnRenamed("id", "cluster_id"), "summary-page")
    lk = materialize(links.select("cluster_id", "article_id").join(pg.select("cluster_id"), "cluster_id", "left_semi"), "summary-links")
    ids = lk.select("article_id").distinct()
    none = F.lit(None).cast("string")
    ent = entities.join(ids, "article_id", "left_semi").groupBy("article_id").agg(
        *[F.min(F.array_min(kind) if kind in entities.columns else none).alias(name)
          for kind, name in (("cities", "city"), ("countries", "country"))])
    image = F.col("image_url") if "image_url" in articles.columns else none
    t = parse_ntz("published_at").alias("t")
    art = articles.select(F.col("id").alias("article_id"), "source_id", "published_at")
    src = sources.select(F.col("id").alias("source_id"), bias_side(F.col("bias")).alias("side"))
    g = materialize(lk.join(art, "article_id").join(src, "source_id", "left").join(ent, "article_id", "left").groupBy("cluster_id").agg(
        F.min(F.struct(t, F.col("article_id"))).alias("_f"), F.min(parse_iso("published_at")).alias("_m"),
        F.min("city").alias("city"), F.min("country").alias("country"), *side_aggregates()), "summary-clusters")
    wanted = g.select("cluster_id", F.col("_f.article_id").alias("_a"), F.col("_f.t").alias("_t"))
    text = materialize(articles.select("id", "published_at", "description", image.alias("image_url")).join(
        wanted.select(F.col("_a").alias("id")), "id", "left_semi"), "summary-texts").select(F.col("id").alias("_a"), t, "description", "image_url")
    first = wanted.join(text, "_a").filter(F.col("_t").eqNullSafe(F.col("t"))).groupBy("cluster_id").agg(
        F.min(F.struct("description", "image_url")).alias("first"))
    g = g.join(first, "cluster_id")
    c = pg.withColumnRenamed("title", "headline")
    if trending is not None:
        c = c.drop("is_trending").join(trending.select(F.col("id").alias("cluster_id"), "is_trending"), "cluster_id", "left")
    flag = ["is_trending"] if "is_trending" in c.columns else []
    return c.join(g, "cluster_id").select(
        F.col("cluster_id").alias("id"), "headline", "number_of_sources", *flag, "first.description", "first.image_url",
        F.coalesce(iso_text("_m"), F.lit("")).alias("first_date_of_publication"),
        *[x for k in ("pro", "neutral", "oppose") for x in (f"{k}_count", side_share(k))],
        _place("country", "city").alias("country_city"))


# ---------------------------------------------------------------------------
# Lookups and page compositions
# ---------------------------------------------------------------------------
def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """B-1: the row with ``key == value`` (the lowest id when several match)."""
    out = df.filter(F.col(key) == F.lit(value))
    return out.orderBy("id").limit(1) if "id" in df.columns else out.limit(1)


def distinct_topics(entities: DataFrame) -> DataFrame:
    """F-10 (intended): topics present in the entity table."""
    return entities.filter(F.col("category").isNotNull()).select("category").distinct()


def set_union(a, b) -> Column:
    """H-9: union of two string lists (order of first appearance, no duplicates)."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")),
                         F.coalesce(b, F.array().cast("array<string>")))


def topic_sidebar(clusters: DataFrame, links: DataFrame, entities: DataFrame, topic: str = "security",
                  k: int = 5, topic_map: dict | None = None) -> DataFrame:
    """G-6: newest ``k`` clusters of one topic."""
    return page(filter_clusters(clusters, links, entities, category=topic, topic_map=topic_map), k, 0)


def cluster_cards(page_clusters: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame,
                  entities: DataFrame, as_of: Column) -> DataFrame:
    """J-2: what a listed cluster's card shows beside its title: category label (F-16), dominant side and its share (E-18),
    and the age of its first article (E-11), for the page's clusters only."""
    from ..functions.dates import time_ago
    from .bias import bias_distribution, dominant_side
    pg = materialize(page_clusters.select("id", "title"), "cards-page")
    lk = materialize(links.join(pg.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi"), "cards-links")
    ids = lk.select(F.col("article_id").alias("id")).distinct()
    art = materialize(articles.join(ids, "id", "left_semi"), "cards-articles")
    ent = entities.join(ids.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    first = lk.join(art.select(F.col("id").alias("article_id"), parse_ntz("published_at").alias("t")), "article_id") \
        .groupBy("cluster_id").agg(F.min("t").alias("t"))
    cards = pg.withColumnRenamed("id", "cluster_id").join(category_label(lk, art, ent), "cluster_id", "left") \
        .join(dominant_side(bias_distribution(lk, art, sources)), "cluster_id", "left").join(first, "cluster_id", "left")
    return cards.select(F.col("cluster_id").alias("id"), "title", "category_label", "dominant_label", "dominant_pct", time_ago(F.col("t"), as_of).alias("ago"))


def homepage(clusters: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame,
             entities: DataFrame, as_of: Column, page_no: int = 1, per_page: int = 100) -> dict:
    """J-2: the homepage's parts as DataFrames (page, totals, page list, cities, sidebar, trending, cards)."""
    from ..functions.dates import page_numbers
    from .trending import refresh_trending, trending_topk
    total = clusters.agg(F.count(F.lit(1)).alias("total"))
    pages = total.select(F.lit(page_no).alias("page"), "total",
                         page_numbers(F.lit(page_no), F.col("total"), F.lit(per_page)).alias("page_numbers"))
    pg = page(clusters, per_page, (page_no - 1) * per_page)
    refreshed = refresh_trending(clusters, links, articles, as_of)
    return {
        "clusters": cluster_summaries(pg, links, articles, sources, entities),
        "pages": pages,
        "cities": distinct_values(entities, "cities", "city"),
        "sidebar": topic_sidebar(clusters, links, entities),
        "trending": trending_topk(refreshed, as_of, 5),
        "cards": cluster_cards(pg, links, articles, sources, entities, as_of),
    }

"""Driver-bound queries: trending, listings, search, statistics, details, labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions import dates as D
from ..operators import bias, serving, trending
from ..session import materialize
from ..sources.tables import DriverTables
from .q_bias import _SIDES_SQL
from .registry import query

# Look-back of the 48-hour features (the reference value).
TEST_LOOKBACK_HOURS = fx.TRENDING_LOOKBACK_HOURS

_VEL_SQL = """
cnt AS (
  select l.cluster_id,
    count(*) filter (where a.created_at > (select as_of from v_asof) - INTERVAL 6 HOUR) as recent_count,
    count(*) filter (where a.created_at <= (select as_of from v_asof) - INTERVAL 6 HOUR
                       and a.created_at > (select as_of from v_asof) - INTERVAL 12 HOUR) as previous_count
  from v_links l join v_articles a on a.id = l.article_id group by l.cluster_id),
vel AS (
  select c.*, coalesce(recent_count, 0) as r, coalesce(previous_count, 0) as p,
    case when coalesce(previous_count, 0) > 0 then coalesce(recent_count, 0) / previous_count
         when coalesce(recent_count, 0) > 0 then recent_count::DOUBLE else 0.0::DOUBLE end as v
  from v_clusters c left join cnt on cnt.cluster_id = c.id)
"""


@query("coverage_velocity", "WITH " + _VEL_SQL + """
select id, r as recent_count, p as previous_count, round_even(v, 2) as coverage_velocity,
  v > 1.5 and number_of_sources >= 3 as is_trending from vel""")
def coverage_velocity(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return trending.coverage_velocity(t.clusters, t.links, t.articles, t.as_of()) \
        .select("id", "recent_count", "previous_count", "coverage_velocity", "is_trending")


@query("trending_topk", "WITH " + _VEL_SQL + f"""
select id, title, round_even(v, 2) as coverage_velocity, number_of_sources from vel
where try_strptime(published_at, '%Y-%m-%d %H:%M:%S') >= (select as_of from v_asof) - INTERVAL {TEST_LOOKBACK_HOURS} HOUR
  and v > 1.5 and number_of_sources >= 3
order by coverage_velocity desc, id asc limit 10""")
def trending_topk(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    as_of = t.as_of()
    r = trending.refresh_trending(t.clusters, t.links, t.articles, as_of, TEST_LOOKBACK_HOURS)
    return trending.trending_topk(r, as_of, 10, TEST_LOOKBACK_HOURS) \
        .select("id", "title", "coverage_velocity", "number_of_sources")


@query("article_search", """
select a.id, a.headline, a.published_at, s.name as source_name, a.category
from v_articles a join v_sources s on s.id = a.source_id
where try_cast(a.published_at as timestamp) >= timestamp '2024-01-01 12:00:00'
  and try_cast(a.published_at as timestamp) <= timestamp '2024-01-02 12:00:00'
  and (contains(a.headline, 'the') or contains(a.description, 'the'))
order by a.published_at desc nulls last, a.id desc limit 100""")
def article_search(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.article_search(t.articles, t.sources, date_from="2024-01-01 12:00:00",
                                  date_to="2024-01-02T12:00:00", keyword="the", limit=100) \
        .select("id", "headline", "published_at", "source_name", "category")


@query("clusters_page", """
select id, title, published_at, number_of_sources from v_clusters
order by published_at desc nulls last, id desc limit 20 offset 20""")
def clusters_page(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.page(t.clusters, limit=20, offset=20).select("id", "title", "published_at", "number_of_sources")


@query("clusters_total", "select count(*) as total_clusters from v_clusters")
def clusters_total(spark, sf_dir):
    return DriverTables(spark, sf_dir).clusters.agg(F.count(F.lit(1)).alias("total_clusters"))


_FILTERED_SQL = """
f AS (
  select * from v_clusters c
  where contains(c.title, 'e')
    and c.id in (select l.cluster_id from v_links l join v_entities e on e.article_id = l.article_id)
    and c.id in (select l.cluster_id from v_links l join v_entities e on e.article_id = l.article_id
                 where e.category = 'security')
    and c.id in (select l.cluster_id from v_links l join v_entities e on e.article_id = l.article_id
                 where list_contains(e.cities, 'de')))
"""


@query("clusters_filtered", "WITH " + _FILTERED_SQL + """
select id, title, published_at, (select count(*) from f) as total from f
order by published_at desc nulls last, id desc limit 50""")
def clusters_filtered(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    f = serving.filter_clusters(t.clusters, t.links, t.entities, query="e", has_entities=True,
                                category="security", city="de", topic_map={})
    return serving.page_with_total(f, 50, 0).select("id", "title", "published_at", "total")


@query("distinct_cities", "select distinct unnest(cities) as city from v_entities where cities is not null")
def distinct_cities(spark, sf_dir):
    return serving.distinct_values(DriverTables(spark, sf_dir).entities, "cities", "city")


@query("entity_stats", """
select category, count(*) as n, (select count(*) from v_entities) as total_with_entities
from v_entities where category is not null group by category""")
def entity_stats(spark, sf_dir):
    return serving.entity_stats(DriverTables(spark, sf_dir).entities)


@query("top_entities", """
WITH x AS (select 'cities' as kind, unnest(cities) as value from v_entities),
c AS (select kind, value, count(*) as n from x where value is not null group by kind, value)
select kind, value, n, row_number() over (partition by kind order by n desc, value asc) as rank
from c qualify rank <= 10""")
def top_entities(spark, sf_dir):
    return serving.top_entities(DriverTables(spark, sf_dir).entities, kinds=("cities",))


@query("token_stats", """
select platform, count(*) as n, (select count(*) from v_tokens) as total_tokens from v_tokens group by platform""")
def token_stats(spark, sf_dir):
    tk = DriverTables(spark, sf_dir).tokens
    total = tk.agg(F.count(F.lit(1))).scalar()
    return serving.group_count(tk, "platform").withColumn("total_tokens", total)


@query("sources_by_bias", "select bias, count(*) as n from v_sources group by bias")
def sources_by_bias(spark, sf_dir):
    return serving.group_count(DriverTables(spark, sf_dir).sources, "bias")


@query("articles_per_cluster", """
select c.id, c.title, count(*) as article_count
from v_clusters c join v_links l on l.cluster_id = c.id group by c.id, c.title""")
def articles_per_cluster(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.articles_per_cluster(t.clusters, t.links)


@query("source_recent_articles", """
WITH r AS (
  select source_id, id, headline, published_at, category,
    row_number() over (partition by source_id order by published_at desc nulls last, id desc) as rank
  from v_articles qualify rank <= 20),
tot AS (select source_id, count(*) as total_articles from v_articles group by source_id)
select r.*, tot.total_articles, s.name as source_name, s.bias
from r join tot on tot.source_id = r.source_id join v_sources s on s.id = r.source_id""")
def source_recent_articles(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.source_recent_articles(t.sources, t.articles, 20)


_POPULAR_SQL = f"""
newest AS (
  select *, row_number() over (order by published_at desc nulls last, id desc) as recent_rank
  from v_clusters order by published_at desc nulls last, id desc limit 100),
cnt AS (select cluster_id, count(*) as article_count from v_links group by cluster_id),
popular AS (
  select n.id, n.title, n.number_of_sources, cnt.article_count, n.created_at, n.recent_rank
  from newest n join cnt on cnt.cluster_id = n.id
  where n.created_at >= (select as_of from v_asof) - INTERVAL {TEST_LOOKBACK_HOURS} HOUR
    and cnt.article_count >= 2
  order by cnt.article_count desc, n.recent_rank asc limit 10)
"""


@query("popular_clusters", "WITH " + _POPULAR_SQL + """
select id, title, number_of_sources, article_count, created_at from popular""")
def popular_clusters(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.popular_clusters(t.clusters, t.links, t.as_of(), hours=TEST_LOOKBACK_HOURS)


@query("earliest_article", """
WITH x AS (select l.cluster_id, a.id as article_id, a.headline, a.published_at,
                  try_cast(a.published_at as timestamp) as t
           from v_links l join v_articles a on a.id = l.article_id)
select cluster_id, arg_min(article_id, (t, article_id)) as article_id,
  arg_min(headline, (t, article_id)) as headline, arg_min(published_at, (t, article_id)) as published_at
from x where t is not null group by cluster_id""")
def earliest_article(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.earliest_article(t.links, t.articles)


@query("category_label", """
WITH x AS (
  select l.cluster_id, a.id as article_id, a.category, e.category as topic,
    try_strptime(a.published_at, '%Y-%m-%d %H:%M:%S') as t
  from v_links l join v_articles a on a.id = l.article_id left join v_entities e on e.article_id = a.id),
g AS (
  select cluster_id,
    arg_min(topic, (t, article_id)) filter (where topic is not null and topic <> '') as topic,
    max(case when category = 'local' then 1 else 0 end) as has_local,
    max(case when category = 'international' then 1 else 0 end) as has_intl
  from x group by cluster_id)
select cluster_id, coalesce(topic, case when has_local = 1 and has_intl = 1 then 'محلي ودولي'
  when has_intl = 1 then 'دولي' else 'محلي' end) as category_label from g""")
def category_label(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.category_label(t.links, t.articles, t.entities)


@query("cluster_detail", """
select l.cluster_id, a.id as article_id, a.headline, a.published_at, s.name as source_name,
  s.bias as source_bias, a.category, l.similarity_score, e.cities, e.category as nlp_category
from v_links l join v_articles a on a.id = l.article_id
left join v_sources s on s.id = a.source_id left join v_entities e on e.article_id = a.id""")
def cluster_detail(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return serving.cluster_detail_rows(t.links, t.articles, t.sources, t.entities).select(
        "cluster_id", "article_id", "headline", "published_at", "source_name", "source_bias",
        "category", "similarity_score", "cities", "nlp_category")


@query("cluster_summary", """
WITH pg AS (select * from v_clusters order by published_at desc nulls last, id desc limit 50),
x AS (select l.cluster_id, a.*, try_strptime(a.published_at, '%Y-%m-%d %H:%M:%S') as t
      from v_links l join v_articles a on a.id = l.article_id where l.cluster_id in (select id from pg)),
first AS (select cluster_id, arg_min(description, (t, id)) as description,
                 min(try_cast(published_at as timestamp)) as m, count(*) as n from x group by cluster_id),
sides AS (
  select x.cluster_id,
    case when s.bias is null or s.bias = '' then null when contains(lower(s.bias), 'pro') then 'pro'
         when contains(lower(s.bias), 'oppose') then 'oppose' else 'neutral' end as side
  from x left join v_sources s on s.id = x.source_id),
dist AS (select cluster_id,
    count(*) filter (where side = 'pro') as pro_count, count(*) filter (where side = 'neutral') as neutral_count,
    count(*) filter (where side = 'oppose') as oppose_count,
    round_even(count(*) filter (where side = 'pro') / count(*) * 100, 1) as pro_pct,
    round_even(count(*) filter (where side = 'neutral') / count(*) * 100, 1) as neutral_pct,
    round_even(count(*) filter (where side = 'oppose') / count(*) * 100, 1) as oppose_pct
  from sides group by cluster_id),
loc AS (select x.cluster_id, min(c) as city from x join v_entities e on e.article_id = x.id,
        unnest(e.cities) as u(c) group by x.cluster_id),
cnt AS (
  select l.cluster_id,
    count(*) filter (where a.created_at > (select as_of from v_asof) - INTERVAL 6 HOUR) as r,
    count(*) filter (where a.created_at <= (select as_of from v_asof) - INTERVAL 6 HOUR
                       and a.created_at > (select as_of from v_asof) - INTERVAL 12 HOUR) as p
  from v_links l join v_articles a on a.id = l.article_id group by l.cluster_id)
select pg.id, pg.title as headline, pg.number_of_sources,
  (case when coalesce(cnt.p, 0) > 0 then cnt.r / cnt.p when coalesce(cnt.r, 0) > 0 then cnt.r::DOUBLE
        else 0.0 end) > 1.5 and pg.number_of_sources >= 3 as is_trending,
  first.description,
  coalesce(case when microsecond(first.m) % 1000000 = 0 then strftime(first.m, '%Y-%m-%dT%H:%M:%S')
                else strftime(first.m, '%Y-%m-%dT%H:%M:%S.%f') end, '') as first_date_of_publication,
  dist.pro_count, dist.neutral_count, dist.oppose_count,
  dist.pro_pct, dist.neutral_pct, dist.oppose_pct, coalesce(loc.city, '') as country_city
from pg join first on first.cluster_id = pg.id join dist on dist.cluster_id = pg.id
left join loc on loc.cluster_id = pg.id left join cnt on cnt.cluster_id = pg.id""")
def cluster_summary(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    pg = materialize(serving.page(t.clusters, 50, 0), "page")
    tr = trending.coverage_velocity(pg, t.links, t.articles, t.as_of()).select("id", "is_trending")
    return serving.cluster_summaries(pg, t.links, t.articles, t.sources, t.entities, trending=tr).select(
        "id", "headline", "number_of_sources", "is_trending", "description", "first_date_of_publication",
        "pro_count", "neutral_count", "oppose_count", "pro_pct", "neutral_pct", "oppose_pct", "country_city")


@query("unclustered_articles", "select id from v_articles where id not in (select article_id from v_links)")
def unclustered_articles(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return t.articles.select("id").join(t.links.select(F.col("article_id").alias("id")), "id", "left_anti")


@query("time_ago", """
WITH s AS (select id, created_at,
  trunc((epoch_us((select as_of from v_asof)) - epoch_us(created_at)) / 1000000.0)::BIGINT as sec,
  floor((epoch_us((select as_of from v_asof)) - epoch_us(created_at)) / 1000000.0)::BIGINT as fsec
  from v_articles)
select id,
  case when sec < 60 then 'الآن'
       when sec < 3600 then case when sec // 60 = 1 then 'منذ دقيقة' when sec // 60 = 2 then 'منذ دقيقتين'
                                 else 'منذ ' || (sec // 60) || ' دقائق' end
       when sec < 86400 then case when sec // 3600 = 1 then 'منذ ساعة' when sec // 3600 = 2 then 'منذ ساعتين'
                                  else 'منذ ' || (sec // 3600) || ' ساعات' end
       when sec < 2592000 then case when sec // 86400 = 1 then 'قبل يوم' when sec // 86400 = 2 then 'قبل يومين'
                                    else 'قبل ' || (sec // 86400) || ' أيام' end
       else strftime(created_at, '%Y-%m-%d') end as ago,
  case when fsec / 31536000 > 1 then 'منذ ' || floor(fsec / 31536000)::BIGINT || ' سنة'
       when fsec / 2592000 > 1 then 'منذ ' || floor(fsec / 2592000)::BIGINT || ' شهر'
       when fsec / 86400 > 1 then 'منذ ' || floor(fsec / 86400)::BIGINT || ' يوم'
       when fsec / 3600 > 1 then 'منذ ' || floor(fsec / 3600)::BIGINT || ' ساعة'
       when fsec / 60 > 1 then 'منذ ' || floor(fsec / 60)::BIGINT || ' دقيقة'
       else 'منذ لحظات' end as ago_client
from s""")
def time_ago(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    as_of = t.as_of()
    return t.articles.select("id", D.time_ago(F.col("created_at"), as_of).alias("ago"),
                             D.time_ago_client(F.col("created_at"), as_of).alias("ago_client"))


@query("date_standardize", """
WITH r AS (select event_id, ts,
  case event_id % 3 when 0 then strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000'
                    when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S')
                    else '12:18 | ' || strftime(ts, '%d-%m-%Y') end as raw
  from events)
select event_id, raw,
  case event_id % 3 when 0 then strftime(date_trunc('second', ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
                    when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') else 'N/A' end as published_at
from r""")
def date_standardize(spark, sf_dir):
    ev = DriverTables(spark, sf_dir).raw("events")
    raw = (F.when(F.col("event_id") % 3 == 0,
                  F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
           .when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .otherwise(F.concat(F.lit("12:18 | "), F.date_format("ts", "dd-MM-yyyy"))))
    r = ev.select("event_id", raw.alias("raw"))
    return r.select("event_id", "raw", D.standardize_feed_date(F.col("raw")).alias("published_at"))


def _map_sql(col: str, m: dict, default: str) -> str:
    arms = " ".join(f"when {col} = '{k}' then '{v}'" for k, v in m.items())
    return f"case {arms} else {default} end"


@query("bias_label", f"""
select id, bias, {_map_sql('bias', fx.BIAS_LABELS, "'" + fx.BIAS_LABEL_UNKNOWN + "'")} as bias_label,
  {_map_sql('bias', fx.BIAS_CSS, "'unknown'")} as bias_css,
  case when bias is null or bias = '' then null when contains(lower(bias), 'pro') then 'pro'
       when contains(lower(bias), 'oppose') then 'oppose' else 'neutral' end as bias_side,
  case when language = 'ar' then 'عربي' else language end as language_label
from v_sources""")
def bias_label(spark, sf_dir):
    from ..functions.labels import bias_css, bias_label as bl, language_label
    s = DriverTables(spark, sf_dir).sources
    return s.select("id", "bias", bl("bias").alias("bias_label"), bias_css("bias").alias("bias_css"),
                    bias.bias_side(F.col("bias")).alias("bias_side"),
                    language_label("language").alias("language_label"))


@query("blindspot_caption", "WITH " + _SIDES_SQL + f""",
p AS (select *, pro_count + neutral_count + oppose_count as tr,
        pro_count / (pro_count + neutral_count + oppose_count) * 100 as pp,
        neutral_count / (pro_count + neutral_count + oppose_count) * 100 as pn,
        oppose_count / (pro_count + neutral_count + oppose_count) * 100 as po
      from counts where pro_count + neutral_count + oppose_count > 0),
b AS (select cluster_id, case when po > 70 and pp < 15 then 'PRO_SAF_BLINDSPOT'
       when pp > 70 and po < 15 then 'OPPOSE_SAF_BLINDSPOT' when pn > 80 and tr > 2 then 'NEUTRAL_ONLY'
       when pn < 20 and tr > 3 then 'PARTISAN_STORY' else 'BALANCED' end as blindspot_type from p)
select cluster_id, blindspot_type, {_map_sql('blindspot_type', fx.BLINDSPOT_CAPTIONS, 'null')} as caption from b""")
def blindspot_caption(spark, sf_dir):
    from ..functions.labels import blindspot_caption as cap
    t = DriverTables(spark, sf_dir)
    m = bias.blindspot_metrics(t.links, t.articles, t.sources)
    return m.select("cluster_id", "blindspot_type", cap("blindspot_type").alias("caption"))


@query("page_numbers", """
WITH t AS (select count(*) as total from v_clusters),
p AS (select unnest(range(1, (select (total + 9) // 10 from t) + 1)) as page)
select page, (page - 1) * 10 as "offset", (select (total + 9) // 10 from t) as total_pages,
  range(greatest(1, page - 2), least((select (total + 9) // 10 from t) + 1, page + 3)) as page_numbers
from p""")
def page_numbers(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    per = 10
    tot = t.clusters.agg(F.count(F.lit(1)).alias("total"))
    pages = tot.select(F.explode(F.sequence(F.lit(1).cast("long"),
                                            F.floor((F.col("total") + per - 1) / per).cast("long"))).alias("page"),
                       "total")
    return pages.select(
        "page", ((F.col("page") - 1) * per).alias("offset"),
        F.floor((F.col("total") + per - 1) / per).cast("long").alias("total_pages"),
        D.page_numbers(F.col("page"), F.col("total"), F.lit(per)).alias("page_numbers"))

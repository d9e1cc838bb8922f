"""Driver-bound queries: upserts (sources, details, tokens) and notifications."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import notify, serving, upserts
from ..sources.tables import DriverTables
from .registry import query

HOST_RE = r"^https?://([^/?#]+)"


def _hosts(t: DriverTables):
    """Source urls seen in the crawled pages (new sources for the upsert tests)."""
    return t.raw("pages").select(F.regexp_extract("url", HOST_RE, 1).alias("url")).distinct()


@query("source_upsert", f"""
WITH inc AS (
  select url, upper(url) as name from v_sources
  union all
  select distinct regexp_extract(url, '{HOST_RE}', 1) as url, null as name from pages),
new AS (
  select url, min(case when coalesce(name, '') = '' then url else name end) as name
  from inc where url not in (select url from v_sources) group by url)
select id, url, name, language, bias from v_sources
union all
select (select max(id) from v_sources) + row_number() over (order by url) as id, url, name,
  'ar' as language, null as bias from new""")
def source_upsert(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    s = t.sources.select("id", "url", "name", "language", "bias")
    inc = t.sources.select("url", F.upper("url").alias("name")).unionByName(
        _hosts(t).withColumn("name", F.lit(None).cast("string")))
    inc = inc.withColumn("language", F.lit(None).cast("string")).withColumn("bias", F.lit(None).cast("string"))
    return upserts.get_or_create_sources(s, inc)


_DETAILS_SQL = f"""
details AS (
  select source as url, upper(source) as name,
    case when count(*) filter (where lang = 'en') * 2 > count(*) then 'Neutral' else 'Oppose-SAF' end as bias,
    'owner of ' || source as owner, cast(min(doc_id) as varchar) as founded_at,
    cast(null as varchar) as hq_location
  from documents group by source
  union all
  select distinct regexp_extract(url, '{HOST_RE}', 1), null, null, null, null, null from pages)
"""


def _details(t: DriverTables):
    d = t.raw("documents").groupBy("source").agg(
        F.count_if(F.col("lang") == "en").alias("_en"), F.count(F.lit(1)).alias("_n"),
        F.min("doc_id").alias("_min"))
    docs = d.select(
        F.col("source").alias("url"), F.upper("source").alias("name"),
        F.when(F.col("_en") * 2 > F.col("_n"), "Neutral").otherwise("Oppose-SAF").alias("bias"),
        F.concat(F.lit("owner of "), F.col("source")).alias("owner"),
        F.col("_min").cast("string").alias("founded_at"),
        F.lit(None).cast("string").alias("hq_location"))
    none = F.lit(None).cast("string")
    hosts = _hosts(t).select("url", none.alias("name"), none.alias("bias"), none.alias("owner"),
                             none.alias("founded_at"), none.alias("hq_location"))
    return docs.unionByName(hosts)


@query("source_details_update", "WITH " + _DETAILS_SQL + """
select s.id, s.url,
  case when d.url is not null then d.name else s.name end as name,
  case when d.url is not null then d.bias else s.bias end as bias,
  case when d.url is not null then d.owner else null end as owner,
  case when d.url is not null then d.founded_at else null end as founded_at,
  case when d.url is not null then d.hq_location else null end as hq_location
from v_sources s left join details d on d.url = s.url""")
def source_details_update(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    none = F.lit(None).cast("string")
    s = t.sources.select("id", "url", "name", "bias", none.alias("owner"), none.alias("founded_at"),
                         none.alias("hq_location"))
    # the same urls sent before with other values: the last row of a url counts as a whole
    last = _details(t).withColumn("seq", F.lit(2))
    sent = last.select("url", F.lit("zz").alias("name"), F.lit("zz").alias("bias"), F.lit("zz").alias("owner"),
                       F.lit(None).cast("string").alias("founded_at"), F.lit("zz").alias("hq_location"), F.lit(1).alias("seq"))
    return upserts.update_source_details(s, sent.unionByName(last), order="seq")


@query("source_details_not_found", "WITH " + _DETAILS_SQL + """
select url from details where url not in (select url from v_sources)""")
def source_details_not_found(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return upserts.details_not_found(t.sources, _details(t)).select("url")


_REGS_SQL = """
regs AS (
  select user_id, 'dev' || user_id as device_id, 'tok' || (event_id % 60) as token,
    case when event_id % 2 = 0 then 'ios' else 'android' end as platform, ts, event_id as seq
  from events where event_type = 'click'),
per AS (
  select token, arg_max(user_id, (ts, seq)) as u, arg_max(device_id, (ts, seq)) as d,
    arg_max(platform, (ts, seq)) as p, arg_max(ts, (ts, seq)) as last_ts,
    arg_min(ts, (ts, seq)) as first_ts, count(*) as n
  from regs group by token),
first_row AS (select token, min(id) as fid from v_tokens group by token)
"""


@query("token_upsert", "WITH " + _REGS_SQL + """,
u AS (select per.*, f.fid from per join first_row f on f.token = per.token)
select t.id,
  case when u.fid is not null then u.u else t.user_id end as user_id,
  case when u.fid is not null then u.d else t.device_id end as device_id,
  t.token,
  case when u.fid is not null then u.p else t.platform end as platform,
  t.created_at,
  case when u.fid is not null then u.last_ts else t.updated_at end as updated_at
from v_tokens t left join u on u.fid = t.id
union all
select (select max(id) from v_tokens) + row_number() over (order by token) as id, u as user_id,
  d as device_id, token, p as platform, first_ts as created_at,
  case when n > 1 then last_ts end as updated_at
from per where token not in (select token from v_tokens)""")
def token_upsert(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    ev = t.raw("events").filter(F.col("event_type") == "click")
    regs = ev.select(
        "user_id", F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("device_id"),
        F.concat(F.lit("tok"), (F.col("event_id") % 60).cast("string")).alias("token"),
        F.when(F.col("event_id") % 2 == 0, "ios").otherwise("android").alias("platform"),
        "ts", F.col("event_id").alias("seq"))
    return upserts.upsert_tokens(t.tokens, regs)


@query("token_expiry", """
select id, token, updated_at from v_tokens
where not coalesce(updated_at < (select max(ts) from events) - INTERVAL 7 DAY, false)""")
def token_expiry(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    as_of = t.raw("events").agg(F.max("ts")).scalar()
    kept, _ = upserts.expire_tokens(t.tokens, as_of, days=7)
    return kept.select("id", "token", "updated_at")


@query("token_expiry_count", """
select count(*) as deleted from v_tokens
where coalesce(updated_at < (select max(ts) from events) - INTERVAL 7 DAY, false)""")
def token_expiry_count(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    as_of = t.raw("events").agg(F.max("ts")).scalar()
    _, gone = upserts.expire_tokens(t.tokens, as_of, days=7)
    return gone.agg(F.count(F.lit(1)).alias("deleted"))


# ---------------------------------------------------------------------------
# Notifications
# ---------------------------------------------------------------------------
_POP_SQL = """
newest AS (
  select *, row_number() over (order by published_at desc nulls last, id desc) as recent_rank
  from v_clusters order by published_at desc nulls last, id desc limit 100),
cnt AS (select cluster_id, count(*) as article_count from v_links group by cluster_id),
popular AS (
  select n.id, n.title from newest n join cnt on cnt.cluster_id = n.id
  where n.created_at >= (select as_of from v_asof) - INTERVAL 48 HOUR and cnt.article_count >= 2
  order by cnt.article_count desc, n.recent_rank asc limit 10),
x AS (select l.cluster_id, a.id as article_id, a.headline, try_cast(a.published_at as timestamp) as t
      from v_links l join v_articles a on a.id = l.article_id where l.cluster_id in (select id from popular)),
g AS (select cluster_id, count(*) as article_count,
        arg_min(headline, (t, article_id)) filter (where t is not null) as h, min(t) as t
      from x group by cluster_id),
msg AS (
  select p.id as cluster_id,
    case when g.t is not null then substr(coalesce(g.h, p.title), 1, 50) else substr(p.title, 1, 50) end as title,
    case when g.t is not null then 'خبر متطور: ' || g.article_count || ' مصادر - ' || strftime(g.t, '%Y-%m-%d %H:%M')
         else 'مجموعة أخبار تحتوي على ' || g.article_count || ' مقالة' end as body,
    g.article_count, 'popular_cluster' as type
  from popular p join g on g.cluster_id = p.id)
"""


def _popular_msgs(t: DriverTables):
    pop = serving.popular_clusters(t.clusters, t.links, t.as_of())
    return notify.popular_messages(pop, t.links, t.articles)


@query("popular_messages", "WITH " + _POP_SQL + """
select *, '{"clusterId":"' || cluster_id || '","type":"popular_cluster","articleCount":"' || article_count || '"}' as data from msg""")
def popular_messages(spark, sf_dir):
    return _popular_msgs(DriverTables(spark, sf_dir)).withColumn("data", F.to_json("data"))


@query("new_cluster_messages", """
select id as cluster_id, 'خبر جديد' as title, 'تم نشر مجموعة أخبار جديدة: ' || substr(title, 1, 50) || '...' as body,
  'new_cluster' as type, '{"clusterId":"' || id || '","type":"new_cluster"}' as data from v_clusters""")
def new_cluster_messages(spark, sf_dir):
    return notify.new_cluster_messages(DriverTables(spark, sf_dir).clusters).withColumn("data", F.to_json("data"))


@query("notification_outbox", "WITH " + _POP_SQL + """
select m.cluster_id, t.token, t.platform, m.title, m.body, m.type
from msg m cross join (select token, platform from v_tokens where token is not null) t""")
def notification_outbox(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return notify.outbox(_popular_msgs(t), t.tokens).select(
        "cluster_id", "token", "platform", "title", "body", "type")


@query("token_delete", """
select id, token from v_tokens
where token not in (select 'tok' || (event_id % 50) from events where event_type = 'error' and value > 300)""")
def token_delete(spark, sf_dir):
    """H-7 delete by value: tokens reported by error events with an unusually large value."""
    t = DriverTables(spark, sf_dir)
    ev = t.raw("events").filter((F.col("event_type") == "error") & (F.col("value") > 300))
    values = ev.select(F.concat(F.lit("tok"), (F.col("event_id") % 50).cast("string")).alias("token"))
    return upserts.delete_tokens(t.tokens, values).select("id", "token")

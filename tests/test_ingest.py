"""Landed RSS files → articles; re-delivery adds nothing; streaming ≡ batch."""
import os

from pyspark.sql import functions as F

from eventlens.operators import entities, upserts
from eventlens.operators.relevance import Lexicon
from eventlens.plans.run_once import ingest
from eventlens.schema import ARTICLES, SOURCES
from eventlens.sources import feeds
from eventlens.streaming import jobs

FEED_A = """

   <?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/">
<channel><title>A</title>
<item><title>Sudan: talks resume</title><description><![CDATA[<p>Army <b>and</b> RSF &amp; mediators</p><img src="http://img/d.jpg">]]></description>
<pubDate>Tue, 02 Dec 2025 10:30:00 +0000</pubDate><link>http://a/1</link><media:content url="http://m/1.jpg" medium="image"/></item>
<item><title>Second item</title><description/><pubDate>12:18 | 25-11-2025</pubDate><link>http://a/2</link>
<content:encoded><![CDATA[<div><img src="http://enc/2.png"/></div>]]></content:encoded></item>
<item><description>Khartoum without title</description></item>
<item><title>broken <b>item</title></item>
</channel></rss>
"""
FEED_B = """<?xml version="1.0"?><rss><channel>
<item><title>Sudan: talks resume</title><description><![CDATA[<p>Army <b>and</b> RSF &amp; mediators</p>]]></description><pubDate>2025-12-02T11:00:00+00:00</pubDate><link>http://b/9</link></item>
<item><title>Gaza update</title><description>Sudan mentioned</description><pubDate>Tue, 02 Dec 2025 12:00:00 GMT</pubDate><link>http://b/10</link></item>
</channel></rss>
"""
LEX = Lexicon(definitive=["Sudan", "Khartoum"], strong=[], exclusion=["Gaza"], context=["army"])


def _land(root):
    for key, text in (("feedA", FEED_A), ("feedB", FEED_B)):
        os.makedirs(f"{root}/{key}", exist_ok=True)
        with open(f"{root}/{key}/items.xml", "w") as f:
            f.write(text)


def test_items_parse_and_rejects(spark, tmp_dir):
    _land(f"{tmp_dir}/land")
    items = feeds.items_from_text(feeds.read_feed_files(spark, f"{tmp_dir}/land"))
    parsed = {r.article_url: r for r in feeds.parse_items(items).collect()}
    a1 = parsed["http://a/1"]
    assert a1.description == "ArmyandRSF & mediators"             # nodes stripped, joined with no gap
    assert a1.image_url == "http://m/1.jpg"                         # media:content first
    assert a1.published_at == "2025-12-02 12:30:00"                 # +0000 shown in Africa/Khartoum
    a2 = parsed["http://a/2"]
    assert a2.description == "" and a2.published_at == "N/A"       # empty description, bad date
    assert a2.image_url == "http://enc/2.png"                       # content:encoded image
    assert parsed["N/A"].headline == "N/A"                          # missing title and link
    assert parsed["http://b/9"].published_at == "2025-12-02 13:00:00"
    assert feeds.item_rejects(items).count() == 1                   # the broken item only


def test_files_without_items_and_large_feeds(spark, tmp_dir):
    """An empty file, a feed without items and a feed of many items with one malformed one."""
    root = f"{tmp_dir}/land"
    os.makedirs(f"{root}/feedA")
    for name, text in (("empty", ""), ("none", "<rss><channel><title>A</title></channel></rss>"), ("cut", "<rss><channel><item><title>never closed")):
        with open(f"{root}/feedA/{name}.xml", "w") as f:
            f.write(text)
    n = 20_000
    with open(f"{root}/feedA/large.xml", "w") as f:
        f.write("<rss><channel>\n")
        for k in range(n):
            f.write("<item><title>broken <b>item</title></item>\n" if k == 777 else
                    f"<item><title>t{k}</title><description>{'word ' * 100}</description><link>http://a/{k}</link></item>\n")
        f.write("</channel></rss>")
    items = feeds.items_from_text(feeds.read_feed_files(spark, root))
    parsed = feeds.parse_items(items)
    assert parsed.count() == n - 1 and parsed.select("article_url").distinct().count() == n - 1
    bad = feeds.item_rejects(items).collect()  # an item that is never closed is one, too
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in bad) == [("cut.xml", "malformed item"), ("large.xml", "malformed item")]
    order = [r.headline for r in parsed.orderBy("path", "item_no").limit(3).collect()]
    assert order == ["t0", "t1", "t2"]
    rejects = feeds.file_rejects(feeds.landed_files(spark, root), items).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rejects) == ["empty.xml", "none.xml"]
    assert {r.reason for r in rejects} == {"no item"}


def test_ingest_dedup_and_rerun(spark, tmp_dir):
    _land(f"{tmp_dir}/land")
    reg = feeds.feed_registry(spark, [("feedA", "https://www.aljazeera.net"), ("feedB", "https://sudanile.com/")])
    parsed = feeds.parse_items(feeds.items_from_text(feeds.read_feed_files(spark, f"{tmp_dir}/land")))
    as_of = F.lit("2025-12-02 13:00:00").cast("timestamp_ntz")
    empty_a, empty_s = spark.createDataFrame([], ARTICLES), spark.createDataFrame([], SOURCES)
    res = ingest(parsed, reg, empty_s, empty_a, as_of, LEX)
    new = res.new_articles.collect()
    # international feed A: a/1 (tier A in title) and the untitled Khartoum item (tier A in body);
    # local feed B: both items; the repeated headline+description of b/9 is a duplicate of a/1
    urls = sorted(r.article_url for r in new)
    assert urls == ["N/A", "http://a/1", "http://b/10"]
    assert sorted(r.id for r in new) == [1, 2, 3]
    assert res.sources.count() == 2
    table = spark.createDataFrame(new, ARTICLES)
    again = ingest(parsed, reg, res.sources, table, as_of, LEX)
    assert again.new_articles.count() == 0                          # re-run adds 0 rows
    assert again.sources.count() == 2


def test_streaming_ingest_idempotent(spark, tmp_dir):
    _land(f"{tmp_dir}/land")
    reg = feeds.feed_registry(spark, [("feedA", "https://www.aljazeera.net"), ("feedB", "https://sudanile.com/")])
    q = jobs.start_ingest(spark, f"{tmp_dir}/land", f"{tmp_dir}/tables", f"{tmp_dir}/ckpt", reg, LEX)
    q.awaitTermination(300)
    n1 = spark.read.parquet(f"{tmp_dir}/tables/articles").count()
    assert n1 == 3
    # the same content delivered again in a new file: nothing new
    os.makedirs(f"{tmp_dir}/land/feedB2", exist_ok=True)
    with open(f"{tmp_dir}/land/feedB2/again.xml", "w") as f:
        f.write(FEED_B)
    reg2 = reg.unionByName(feeds.feed_registry(spark, [("feedB2", "https://sudanile.com/")]))
    q = jobs.start_ingest(spark, f"{tmp_dir}/land", f"{tmp_dir}/tables", f"{tmp_dir}/ckpt", reg2, LEX)
    q.awaitTermination(300)
    assert spark.read.parquet(f"{tmp_dir}/tables/articles").count() == n1


def test_windowed_coverage_stream(spark, tmp_dir):
    import datetime as dt
    rows = [(1, dt.datetime(2025, 1, 1, h, 0)) for h in (0, 1, 2, 7, 8, 13)] + [(2, dt.datetime(2025, 1, 1, 3))]
    spark.createDataFrame(rows, "cluster_id long, created_at timestamp_ntz") \
        .withColumn("created_at", F.col("created_at").cast("timestamp")) \
        .write.parquet(f"{tmp_dir}/links")
    src = spark.readStream.schema("cluster_id long, created_at timestamp").parquet(f"{tmp_dir}/links")
    q = jobs.windowed_coverage(src).writeStream.format("memory").queryName("cov_test") \
        .outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r.cluster_id, r.window_start.hour): r.n for r in spark.table("cov_test").collect()}
    assert got[(1, 0)] == 3 and got[(1, 6)] == 2 and got[(1, 12)] == 1 and got[(2, 0)] == 1


def test_upserts_twice_equals_once(spark):
    import datetime as dt
    tok = spark.createDataFrame(
        [(1, 10, "d1", "t1", "android", dt.datetime(2025, 1, 1), None),
         (2, 11, "d2", "t1", "ios", dt.datetime(2025, 1, 2), None)],
        "id long, user_id long, device_id string, token string, platform string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz")
    regs = spark.createDataFrame(
        [(12, "d3", "t1", "ios", dt.datetime(2025, 2, 1), 1), (13, "d4", "t9", "android", dt.datetime(2025, 2, 2), 2),
         (14, "", "t8", "ios", dt.datetime(2025, 2, 3), 3)],
        "user_id long, device_id string, token string, platform string, ts timestamp_ntz, seq long")
    once = upserts.upsert_tokens(tok, regs)
    twice = upserts.upsert_tokens(once, regs)
    rows = {r.id: r for r in once.collect()}
    assert rows[1].user_id == 12 and rows[1].updated_at == dt.datetime(2025, 2, 1)   # first row updated
    assert rows[2].user_id == 11                                                    # other row untouched
    assert rows[3].token == "t9" and rows[3].updated_at is None                    # inserted once
    assert 4 not in rows                                                            # invalid registration
    # applying the same registrations again changes nothing but updated_at of the row
    # inserted the first time (a known token now: the registration refreshes it)
    again = {r.id: r for r in twice.collect()}
    assert set(again) == set(rows)
    for i in rows:
        assert rows[i][:6] == again[i][:6]
    assert again[3].updated_at == dt.datetime(2025, 2, 2)
    src = spark.createDataFrame([(1, "https://x", "Old", "ar", None)],
                                "id long, url string, name string, language string, bias string")
    inc = spark.createDataFrame([("https://x", "New", None, None), ("https://y", None, None, None)],
                                "url string, name string, language string, bias string")
    out = {r.url: r for r in upserts.get_or_create_sources(src, inc).collect()}
    assert out["https://x"].name == "Old" and out["https://y"].name == "https://y" and out["https://y"].id == 2


def test_response_validation(spark):
    raws = [
        '```json\n{"people": ["A"], "cities": [], "regions": [], "countries": ["Sudan"], "organizations": [],'
        ' "political_parties_and_militias": [], "brands": [], "job_titles": [], "category": "سياسة"}\n```',
        '{"people": "x", "cities": [], "regions": [], "countries": [], "organizations": [],'
        ' "political_parties_and_militias": [], "brands": [], "job_titles": [], "category": 7}',
        '{"people": []}',
        'not json',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id long, raw string")
    got = {r.id: r for r in entities.parse_responses(df).collect()}
    assert got[0].valid and got[0].people == ["A"] and got[0].countries == ["Sudan"] and got[0].category == "سياسة"
    assert got[1].valid and got[1].people == [] and got[1].category == ""
    assert not got[2].valid and got[2].people == [] and got[2].category == ""
    assert not got[3].valid

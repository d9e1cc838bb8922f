"""Hard cases of single operators: hashed rows, repeated change keys, Arabic text, many messages."""
from pyspark.sql import functions as F

from eventlens.functions import dates, text
from eventlens.operators import dedup, entities, notify, serving, upserts
from eventlens.operators.relevance import is_relevant
from eventlens.plans.run_once import cluster_new, tfidf_embeddings


def test_rows_with_a_hash_are_left_alone(spark):
    rows = [(1, "H", "same", "stored"), (2, "H", "same", None), (3, "H", "same", None)]
    df = spark.createDataFrame(rows, "id long, headline string, description string, content_hash string")
    got = {r.id: r.is_duplicate for r in dedup.mark_duplicates(df).collect()}
    assert got == {2: False, 3: True}


def test_repeated_change_keys_do_not_multiply_rows(spark):
    table = spark.createDataFrame([(1, "u1", "a", None), (2, "u2", "b", None)], "id long, url string, name string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, "x"), (1, "y"), (1, None)], "id long, name string")
    assert {r.id: r.name for r in upserts.update_partial(table, changes, "id", ["name"]).collect()} == {1: "y", 2: "b"}
    assert upserts.update_partial(table, changes, "id", ["name"]).count() == 2
    details = spark.createDataFrame([("u1", "x"), ("u1", "z")], "url string, name string")
    assert sorted(r.name for r in upserts.update_source_details(table, details, columns=("name",)).collect()) == ["b", "z"]


def test_conflicting_changes_of_a_key_are_applied_in_order(spark):
    """The last call wins, and no row comes out that nobody sent."""
    table = spark.createDataFrame([(1, "u", "old", "o"), (2, "w", "kept", "k")], "id long, url string, name string, owner string")
    details = spark.createDataFrame([(1, "u", "z", "aa"), (3, "u", "b", "zz"), (2, "u", "zzz", None)], "seq int, url string, name string, owner string")
    got = upserts.update_source_details(table, details, columns=("name", "owner"), order="seq")
    assert {(r.url, r.name, r.owner) for r in got.collect()} == {("u", "b", "zz"), ("w", "kept", "k")}
    last = upserts.update_source_details(table, details.filter("seq < 3"), columns=("name", "owner"), order="seq")
    assert last.filter("url = 'u'").select("name", "owner").collect() == [("zzz", None)]  # nulls of the last row included
    changes = spark.createDataFrame([(1, 1, "c", "x"), (1, 2, "a", None), (1, 3, None, None)], "id long, seq int, name string, owner string")
    got = upserts.update_partial(table, changes, "id", ["name", "owner"], order="seq")
    assert {(r.id, r.name, r.owner) for r in got.collect()} == {(1, "a", "x"), (2, "kept", "k")}
    unordered = spark.createDataFrame([("u", "z", "aa"), ("u", "b", "zz")], "url string, name string, owner string")
    row = upserts.update_source_details(table, unordered, columns=("name", "owner")).filter("url = 'u'").first()
    assert (row.name, row.owner) in {("z", "aa"), ("b", "zz")}


def test_a_hot_hash_is_marked_in_chunks(spark):
    n = 3 * dedup.CHUNK
    df = spark.range(n).select("id", F.lit("same").alias("headline"), F.when(F.col("id") % 3 == 0, "one").otherwise(F.col("id").cast("string")).alias("description"))
    got = dedup.mark_duplicates(df)
    counts = got.groupBy("is_duplicate").count().collect()
    assert {r["is_duplicate"]: r["count"] for r in counts} == {False: n - n // 3 + 1, True: n // 3 - 1}
    assert got.filter("is_duplicate and content_hash <> 'DUPLICATE_OF_0'").count() == 0


def test_terms_of_the_trie_equal_all_n_grams(spark):
    import random
    rng = random.Random(4)
    words = ["port", "sudan", "red", "sea", "a.b", "north", "portal", "x+y"]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(40)})
    docs = [(k, " ".join(rng.choice([*words, "the", "ports"]) for _ in range(rng.randrange(0, 25)))) for k in range(60)]
    tok = spark.createDataFrame(docs, "_doc long, _w string")
    lex = spark.createDataFrame([(t, "k") for t in terms], "term string, kind string")
    got = {(r["_doc"], r["term"]) for r in entities.term_hits(tok, lex).collect()}
    want = {(k, t) for k, text in docs for t in terms for w in [text.split(" ")] for n in [len(t.split(" "))]
            for i in range(len(w) - n + 1) if " ".join(w[i:i + n]) == t}
    assert got == want and len(want) > 100


def test_repeated_ids_of_processed_rows_do_not_multiply_them(spark):
    table = spark.createDataFrame([(1, "u1", "a", None), (2, "u2", "b", None)], "id long, url string, name string, updated_at timestamp_ntz")
    ids = spark.createDataFrame([(1,), (1,)], "id long")
    assert upserts.mark_processed(table, ids, F.current_timestamp().cast("timestamp_ntz")).count() == 2


def test_arabic_text_has_a_vector(spark):
    df = spark.createDataFrame([(1, "الخرطوم اليوم أخبار"), (2, "بورتسودان غدا"), (3, "plain words")], "id long, text string")
    assert all(any(r.embedding) for r in tfidf_embeddings(df).collect())


def test_outbox_has_no_message_bound(spark):
    messages = spark.range(1500).select(F.col("id").alias("cluster_id"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit("new").alias("type"))
    tokens = spark.createDataFrame([("a", "ios"), ("b", "web"), (None, "web")], "token string, platform string")
    assert notify.outbox(messages, tokens).count() == 3000


def _map(spark, values, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in df.select("k", fn(F.col("v")).alias("out")).orderBy("k").collect()]


def test_exclusions_hold_in_both_modes(spark):
    df = spark.createDataFrame([("أخبار غزة", "السودان")], "headline string, description string")
    for parity in (True, False):
        assert df.select(is_relevant("international", parity=parity).alias("r")).first().r is False


def test_dates_do_not_depend_on_the_session_zone(spark):
    values = ["2025-12-02 11:00:00+00:00", "2025-12-02T11:00Z", "2025-12-02T11:00:00.123456Z", "2025-12-02T14:00:00+0300",
              "2025-12-02 13:00:00", "2025-12-02", "Dec 2, 2025 11:00 AM", "December 2, 2025", "Tue, 02 Dec 2025 11:00:00 GMT",
              "02 Dec 2025 11:00:00 +0000", "nonsense", "", None]
    want = ["2025-12-02 13:00:00"] * 5 + ["2025-12-02 00:00:00", "2025-12-02 11:00:00", "2025-12-02 00:00:00"] \
        + ["2025-12-02 13:00:00"] * 2 + ["N/A"] * 3
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert _map(spark, values, dates.standardize_feed_date) == want
            iso = _map(spark, values[:5], lambda c: F.date_format(dates.parse_iso(c), dates.STORE_FMT))
            assert iso == want[:5]
            naive = F.lit("2025-12-02 10:00:00").cast("timestamp_ntz")
            instant = F.timestamp_seconds(F.lit(1764669600))  # 10:00 UTC
            row = spark.range(1).select(*[F.date_format(c, dates.STORE_FMT).alias(n) for n, c in (
                ("a", dates.to_app_zone(naive)), ("b", dates.to_app_zone(naive, naive_is_app=False)), ("c", dates.to_app_zone(instant)))]).first()
            assert (row.a, row.b, row.c) == ("2025-12-02 10:00:00", "2025-12-02 12:00:00", "2025-12-02 12:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_html_text_decodes_references_once(spark):
    values = ["a &mdash; b&#8217;s &hellip;", "&amp;lt; &amp;#39; AT&T &unknown; &#0; &#x1F600;", "one <!-- c --> two", "&#146;&nbsp;x&nbsp;", None]
    want = ["a \u2014 b\u2019s \u2026", "&lt; &#39; AT&T &unknown; &#0; \U0001F600", "onetwo", "\u2019\u00a0x", None]
    assert _map(spark, values, text.html_to_text) == want


def test_first_image_is_the_one(spark):
    values = ['<p><img data-src="lazy" src="a.png">', "<IMG alt='>' src=b.png width=1>", "<img alt=x><img src='c.png'>",
              "<img src='d.png?a=1&amp;b=2'/>", "no image", None]
    got = _map(spark, values, lambda c: text.image_url(F.lit(None), F.lit(None), c))
    assert got == ["a.png", "b.png", "N/A", "d.png?a=1&b=2", "N/A", "N/A"]


def test_messages_carry_their_data(spark):
    clusters = spark.createDataFrame([(7, "t" * 60)], "id long, title string")
    links = spark.createDataFrame([(7, 1), (7, 2)], "cluster_id long, article_id long")
    articles = spark.createDataFrame([(1, "h", "2025-12-02 11:00:00"), (2, "g", "bad")], "id long, headline string, published_at string")
    assert notify.new_cluster_messages(clusters).first().data == {"clusterId": "7", "type": "new_cluster"}
    popular = notify.popular_messages(clusters, links, articles)
    assert popular.first().data == {"clusterId": "7", "type": "popular_cluster", "articleCount": "2"}
    tokens = spark.createDataFrame([("a", "ios")], "token string, platform string")
    assert notify.outbox(popular, tokens).first().data["articleCount"] == "2"


def test_articles_without_a_vector_are_rejects(spark):
    articles = spark.createDataFrame(
        [(1, 1, "h", "d", "2025-12-02 11:00:00"), (2, 2, "h", "d", "2025-12-02 12:00:00")],
        "id long, source_id long, headline string, description string, published_at string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    sources = spark.createDataFrame([(1, None)], "id long, bias string")
    links = spark.createDataFrame([], "cluster_id long, article_id long")
    _, new_links, rejects = cluster_new(articles, links, vectors, sources, F.current_timestamp().cast("timestamp_ntz"))
    assert [r.article_id for r in new_links.collect()] == [1]
    assert [(r.id, r.reason) for r in rejects.collect()] == [(2, "no vector")]


def test_location_sets_are_whole(spark):
    links = spark.createDataFrame([(7, 1), (7, 2)], "cluster_id long, article_id long")
    ent = spark.createDataFrame([(1, ["b", "a"], ["S"]), (2, ["c"], None)], "article_id long, cities array<string>, countries array<string>")
    r = serving.location_sets(links, ent).first()
    assert (r.country_city, r.cities, r.countries) == ("S/a", ["a", "b", "c"], ["S"])

"""Boundary rows for blindspot, bias distribution, trending and relevance."""
import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from eventlens.functions import text as T
from eventlens.operators import bias, relevance, trending


def _tables(spark, sides):
    """sides: list of (cluster_id, bias or None) → links, articles, sources."""
    links, arts, srcs = [], [], []
    for i, (cid, b) in enumerate(sides):
        links.append((cid, i))
        arts.append((i, i))
        srcs.append((i, b))
    return (spark.createDataFrame(links, "cluster_id long, article_id long"),
            spark.createDataFrame(arts, "id long, source_id long"),
            spark.createDataFrame(srcs, "id long, bias string"))


@pytest.mark.parametrize("pro,neu,opp,expected", [
    (0, 1, 3, "PRO_SAF_BLINDSPOT"),      # oppose 75 > 70, pro 0 < 15
    (0, 3, 7, "BALANCED"),               # oppose exactly 70: not > 70; neutral 30
    (7, 3, 0, "BALANCED"),               # pro exactly 70
    (8, 2, 0, "OPPOSE_SAF_BLINDSPOT"),
    (0, 5, 0, "NEUTRAL_ONLY"),
    (1, 4, 0, "BALANCED"),               # neutral exactly 80
    (2, 0, 2, "PARTISAN_STORY"),         # neutral 0 < 20, total 4 > 3
    (1, 0, 2, "BALANCED"),               # total 3 is not > 3
])
def test_blindspot_boundaries(spark, pro, neu, opp, expected):
    sides = [(1, "Pro-SAF")] * pro + [(1, "Neutral")] * neu + [(1, "Oppose-SAF")] * opp + [(1, None), (1, "")]
    m = bias.blindspot_metrics(*_tables(spark, sides)).collect()
    assert m[0].blindspot_type == expected
    assert (m[0].pro_count, m[0].neutral_count, m[0].oppose_count) == (pro, neu, opp)


def test_blindspot_balance_and_unrated(spark):
    sides = [(1, "Pro-SAF"), (1, "Neutral"), (1, "Oppose-SAF"), (2, None)]
    m = {r.cluster_id: r for r in bias.blindspot_metrics(*_tables(spark, sides)).collect()}
    assert 2 not in m                       # no rated article → no metrics row
    assert m[1].balance_score == 1.0        # 3 × |33.333 - 33.33| ≈ 0.01 → 0.9999 → 1.0
    d = {r.cluster_id: r for r in bias.bias_distribution(*_tables(spark, sides)).collect()}
    assert d[2].total_articles == 1 and d[2].pro_pct == 0.0


def test_coverage_velocity_edges(spark):
    as_of = dt.datetime(2025, 1, 2, 12, 0, 0)
    ts = [as_of - dt.timedelta(hours=6),                  # exactly 6 h: previous, not recent
          as_of - dt.timedelta(hours=12),                 # exactly 12 h: neither
          as_of - dt.timedelta(hours=1), as_of - dt.timedelta(hours=2), as_of - dt.timedelta(hours=3),
          as_of - dt.timedelta(hours=7)]
    arts = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id long, created_at timestamp_ntz")
    links = spark.createDataFrame([(1, i) for i in range(len(ts))], "cluster_id long, article_id long")
    cl = spark.createDataFrame([(1, 3, dt.datetime(2025, 1, 1))],
                               "id long, number_of_sources long, created_at timestamp_ntz")
    r = trending.coverage_velocity(cl, links, arts, F.lit(as_of).cast("timestamp_ntz")).collect()[0]
    assert (r.recent_count, r.previous_count) == (3, 2)
    assert r.coverage_velocity == 1.5 and r.is_trending is False   # 1.5 is not > 1.5


def test_text_parity_with_python():
    samples = ["  إِنَّ الْقُرْآنَ  ", " Café – déjà vu!\n", "ةىأإآ ـ", "", "x\x1cy　"]
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(s, s[::-1]) for s in samples], "h string, d string")
    got = df.select(T.content_hash("h", "d").alias("c"), T.normalize_text("h").alias("n"),
                    T.strip("h").alias("s")).collect()

    def norm1(t):
        t = re.sub(r"[ً-ٰٟ]", "", t or "")
        t = re.sub(r"[أإآ]", "ا", t)
        return t.replace("ة", "ه").replace("ى", "ي")

    for (h, d), r in zip([(s, s[::-1]) for s in samples], got):
        exp = hashlib.sha256(f"{norm1(h).strip().lower()}|{norm1(d).strip().lower()}".encode()).hexdigest()
        assert r.c == exp
        assert r.n == re.sub(r"[^\w\s]", "", h).lower()
        assert r.s == h.strip()


def test_relevance_branches(spark):
    lex = relevance.Lexicon(definitive=["Sudan"], strong=["Kassala"], exclusion=["Gaza"],
                            context=["army", "talks", "famine"])
    rows = [("Sudan news", "x", "international", True),          # tier A in title
            ("Gaza and more", "Sudan", "international", False),  # exclusion in title, tier A only in body
            ("Report", "about sudan", "international", True),     # tier A in body, no exclusion
            ("army talks", "", "international", True),            # 3 + 3 >= 4
            ("army", "famine", "international", True),            # 3 + 1 = 4
            ("army", "", "international", False),                 # 3 < 4
            ("x", "kassala", "local", True),                      # local: tier A anywhere
            ("x", "famine", "local", True),                       # local: one tier B
            ("x", "y", "local", False)]
    df = spark.createDataFrame([r[:3] for r in rows], "headline string, description string, category string")
    got = [r.k for r in df.select(relevance.is_relevant(F.col("category"), lex=lex).alias("k")).collect()]
    assert got == [r[3] for r in rows]

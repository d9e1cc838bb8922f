"""The key index: a batch reads its own prefixes, replays and lost runs add nothing."""
import datetime as dt

from pyspark.sql import functions as F

from eventlens.schema import ARTICLES
from eventlens.streaming.keys import PREFIX, KeyIndex


def _articles(spark, first, hashes):
    base = {f.name: None for f in ARTICLES.fields}
    return spark.createDataFrame([tuple({**base, "id": first + k, "source_id": 1, "headline": "h", "content_hash": h,
                                         "created_at": dt.datetime(2025, 1, 1)}[f.name] for f in ARTICLES.fields) for k, h in enumerate(hashes)], ARTICLES)


def _hashes(spark, n, salt):
    return [r.h for r in spark.range(n).select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h")).collect()]


def test_a_batch_reads_its_prefixes_only(spark, tmp_dir):
    index, old = KeyIndex(spark, f"{tmp_dir}/t"), _hashes(spark, 3000, "a")
    _articles(spark, 1, old).write.mode("append").parquet(f"{tmp_dir}/t/articles")
    index.refresh()
    assert index.mark()[1] == 3000
    batch = [*old[:5], *_hashes(spark, 5, "b")]
    stored = index.stored(spark.createDataFrame([(h,) for h in batch], "content_hash string"))
    got = {r.content_hash for r in stored.collect()} - {None}
    assert set(old[:5]) <= got
    assert {h[:PREFIX] for h in got} <= {h[:PREFIX] for h in batch}  # no other prefix was read
    assert len(got) < 60 and stored.agg(F.max("id")).first()[0] == 3000
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan.replace("isnotnull(prefix), ", "").replace("#", " ").replace("[prefix ", "[prefix") or "prefix" in plan


def test_files_that_were_not_indexed_still_count(spark, tmp_dir):
    """A run is lost after its articles were written: the replay sees them, ids go on after them, and the next run indexes them."""
    index, first, second = KeyIndex(spark, f"{tmp_dir}/t"), _hashes(spark, 20, "a"), _hashes(spark, 20, "b")
    _articles(spark, 1, first).write.mode("append").parquet(f"{tmp_dir}/t/articles")
    index.refresh()
    _articles(spark, 21, second).write.mode("append").parquet(f"{tmp_dir}/t/articles")  # no refresh
    hashes = spark.createDataFrame([(h,) for h in [*first, *second]], "content_hash string")
    stored = index.stored(hashes)
    assert hashes.join(stored.filter("content_hash is not null"), "content_hash", "left_anti").count() == 0
    assert stored.agg(F.max("id")).first()[0] == 40
    index.refresh()
    index.refresh()  # nothing new: nothing is written
    assert index.mark()[1] == 40
    keys = spark.read.parquet(f"{tmp_dir}/t/keys")
    assert keys.count() == 40
    index.compact(f"{tmp_dir}/t/compacted")
    assert spark.read.parquet(f"{tmp_dir}/t/compacted").count() == 40


def test_key_files_are_as_large_as_their_keys(spark, tmp_dir):
    """a Bloom filter took a megabyte in each of up to 4,096 files, whatever it held."""
    index = KeyIndex(spark, f"{tmp_dir}/t")
    _articles(spark, 1, _hashes(spark, 30, "a")).write.mode("append").parquet(f"{tmp_dir}/t/articles")
    index.refresh()
    sizes = [r.length for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load(f"{tmp_dir}/t/keys").select("length").collect()]
    assert len(sizes) >= 20 and max(sizes) < 50_000

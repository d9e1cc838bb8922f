"""D-J11 / L-1: an index of the stored content hashes, of which a micro-batch reads only its part.

The index is a Parquet table partitioned by the hashes' first ``PREFIX`` hexadecimal digits, with a Bloom filter per file; a
batch reads the prefixes of its own hashes.  ``marks`` says up to which file time the article table is indexed, and the
largest id until then.  Article files that are newer are read themselves, so a run that was
lost between writing articles and indexing them leaves nothing out: its files are still newer than the mark, and a
replay of its batch finds its own rows.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ARTICLES

PREFIX = 3
KEYS, MARKS = "content_hash string, prefix string", "upto timestamp, last_id long"
#: A Bloom filter of 16 to 256 kB, as the keys of a file need (a megabyte in every file otherwise, whatever it holds).
BLOOM = {"parquet.bloom.filter.enabled#content_hash": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "262144"}
_NEVER = dt.datetime(1970, 1, 1)


def prefix_of(content_hash="content_hash"):
    return F.substring(content_hash, 1, PREFIX)


class KeyIndex:
    """The key index beside an article table: ``root/articles``, ``root/keys`` and ``root/marks``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        for name, schema in (("articles", ARTICLES), ("keys", KEYS), ("marks", MARKS)):  # a no-op but for the first time
            writer = spark.createDataFrame([], schema).write.mode("ignore")
            (writer.partitionBy("prefix") if name == "keys" else writer).parquet(f"{self.root}/{name}")

    def mark(self) -> tuple[dt.datetime, int]:
        """(file time up to which articles are indexed, largest id among them); one small row per batch is read."""
        r = self.spark.read.schema(MARKS).parquet(f"{self.root}/marks").agg(F.max("upto").alias("upto"), F.max("last_id").alias("last_id")).first()
        return r["upto"] or _NEVER, r["last_id"] or 0

    def unindexed(self, upto: dt.datetime) -> DataFrame:
        """(content_hash, id, written) of articles in files newer than the mark; older files are not opened."""
        return self.spark.read.schema(ARTICLES).parquet(f"{self.root}/articles").select(
            "content_hash", "id", F.col("_metadata.file_modification_time").alias("written")).filter(F.col("written") > F.lit(upto))

    def stored(self, hashes: DataFrame) -> DataFrame:
        """(content_hash, id) that decides about ``hashes`` (content_hash): stored hashes of their prefixes, without
        ids, and a row without a hash that holds the largest id."""
        upto, last = self.mark()
        wanted = [r["p"] for r in hashes.select(prefix_of().alias("p")).distinct().collect() if r["p"] is not None]  # 16 ** PREFIX at most
        keys = self.spark.read.schema(KEYS).parquet(f"{self.root}/keys").filter(F.col("prefix").isin(wanted))
        top = self.spark.createDataFrame([(None, last)], "content_hash string, id long")
        return keys.select("content_hash", F.lit(None).cast("long").alias("id")).unionByName(
            self.unindexed(upto).select("content_hash", "id")).unionByName(top)

    def refresh(self) -> None:
        """Indexes the article files that are newer than the mark."""
        upto, last = self.mark()
        new = self.unindexed(upto)
        r = new.agg(F.max("written").alias("upto"), F.max("id").alias("last_id")).first()
        if r["upto"] is None:
            return
        keys = new.filter("content_hash is not null").select("content_hash", prefix_of().alias("prefix")).distinct()
        keys.repartition("prefix").write.mode("append").options(**BLOOM) \
            .partitionBy("prefix").parquet(f"{self.root}/keys")
        self.spark.createDataFrame([(r["upto"], max(last, r["last_id"] or 0))], MARKS).write.mode("append").parquet(f"{self.root}/marks")

    def compact(self, into: str) -> None:
        """Writes the keys once each, a file per prefix, under another folder, to be swapped in by the user."""
        keys = self.spark.read.schema(KEYS).parquet(f"{self.root}/keys")
        keys.distinct().repartition("prefix").write.options(**BLOOM).partitionBy("prefix").parquet(into)

"""Helpers shared by the corpus operators: column selection, connected components."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.session import materialize

__all__ = ["table", "columns", "connected_components", "hash_sample", "materialize"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (local folder or remote store alike)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **picked: str) -> DataFrame:
    """Only the columns an operator works on, under its own names: ``columns(df, id="doc_id")``.

    Everything else stays out of the plan, so extra columns of the input, whatever
    they are called, cannot clash with working columns."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in picked.items()])


def hash_sample(df: DataFrame, id_col: str, wanted: int, rows: int) -> DataFrame:
    """About ``wanted`` of the ``rows`` rows, chosen by a hash of the id (a null id never is); all
    of them if there are no more.  Needs no shuffle and is repeatable."""
    kept = df.filter(F.col(id_col).isNotNull())
    return kept if rows <= wanted else kept.filter(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1_000_003)) < int(1_000_003 * wanted / rows))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): the smallest node reachable.

    Two alternating steps (large-star, small-star) hang every node on smaller
    neighbours until the edges are stars.  Each step is one grouping over the edges
    and its result is written to the shared folder, so lineage stays short; only a
    changed-edge count reaches the driver.  Isolated nodes are not in ``edges`` and
    not in the result."""
    e = materialize(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    signature = None
    while True:
        # large-star: larger neighbours of u move to u's smallest neighbour (u included)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u").filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large, "cc")
        # small-star: the smaller neighbours of u, and u itself, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        e = materialize(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        signature = now

"""Operator 4: shards of near equal bytes by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together.  Groups, largest first,
go to the least loaded bin through a heap.  One heap over all groups would not scale,
so scheduling is hierarchical: groups are dealt to lots of bounded size, each lot is
scheduled on its own into as many bins as there are shards, and the bins of all lots
are the groups of the next level, until one lot is left, whose bins are the shards.
A group larger than a shard's fair share ends up alone in its bin on every level.
"""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Groups of one lot, rows of one numbered part of a shard.
LOT, PART = 50_000, 20_000
ROW_BYTES = 16


def lpt(sizes: list[int], bins: int) -> list[int]:
    """The bin of each size; ``sizes`` must be in descending order."""
    heap = [(0, b) for b in range(bins)]
    out = []
    for size in sizes:
        load, b = heap[0]
        heapq.heapreplace(heap, (load + size, b))
        out.append(b)
    return out


def _schedule(bins: int):
    def run(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
        base = int(lot["lot"].iloc[0]) * bins
        return pd.DataFrame({"item": lot["item"], "bytes": lot["bytes"], "bin": [base + b for b in lpt(lot["bytes"].tolist(), bins)]})
    return run


def assign(groups: DataFrame, shards: int, lot_rows: int = LOT) -> DataFrame:
    """(item string, bytes long), one row per group -> (item, shard)."""
    n = groups.count()
    level, chain = groups, None
    while True:
        lots = max(1, -(-n // lot_rows))
        dealt = level.withColumn("lot", F.pmod(F.xxhash64("item"), F.lit(lots)))
        bins = common.materialize(dealt.groupBy("lot").applyInPandas(_schedule(shards), "item string, bytes long, bin long"), "lpt-bins")
        step = bins.select(F.col("item").alias("at"), F.col("bin").cast("string").alias("next"))
        if chain is None:
            chain = bins.select("item", F.col("bin").cast("string").alias("at"))
        else:
            chain = chain.join(step, "at").select("item", F.col("next").alias("at"))
        if lots == 1:
            return chain.select("item", F.col("at").cast("int").alias("shard"))
        level = bins.groupBy(F.col("bin").cast("string").alias("item")).agg(F.sum("bytes").alias("bytes"))
        n = lots * shards


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    ``size`` is the text's UTF-8 bytes plus 16; a null text has no bytes and null texts
    form one group, apart from empty texts.  ``slot`` numbers a shard's rows from 0
    without gaps, by id within parts of bounded size.  The law is ``bytes``, so
    ``grown_shard`` is null.  Rows that repeat an id are rows of their own."""
    text = F.col("text")
    rows = common.columns(docs, id=id_col, text=text_col).select(
        "id", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.concat(F.md5(text.cast("binary")), F.lit("-"), F.octet_length(text)), F.lit("null")).alias("item"))
    rows = common.materialize(rows, "lpt-rows")
    placed = assign(rows.groupBy("item").agg(F.sum("size").alias("bytes")), shards)
    n = rows.count()
    out = common.materialize(
        rows.join(placed, "item").withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.lit(1 + n // (shards * part_rows)))), "lpt-placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = out.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size"))
    return out.withColumn("within", within).join(starts, ["shard", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""What the operators on vectors share: usable rows under a row key, and searches of shards by streamed queries."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def finite(v) -> "F.Column":
    """Condition: the array ``v`` is there, not empty, and every component is a finite number."""
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good, F.lit(False))


def usable(vectors: DataFrame, name: str, **picked: str) -> tuple[DataFrame, int, int]:
    """The rows whose vector (``v`` of ``picked``) is finite, written under a row key ``row`` -> (rows, their number, dimension).

    Vectors are compared with vectors of their own length only: the rows of the commonest length
    (of the shortest, if several are as common) take part.  Rows that repeat stay separate rows."""
    x = common.columns(vectors, **picked).withColumn("v", F.col("v").cast("array<double>"))
    x = common.materialize(x.filter(finite(F.col("v"))).withColumn("row", F.monotonically_increasing_id()), name)
    lengths = x.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "dim").first()
    if first is None:
        return x, 0, 0
    return x.filter(F.size("v") == first["dim"]), first["n"], first["dim"]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def visit(points: DataFrame, queries: DataFrame, search: Callable, schema: str) -> DataFrame:
    """Every query visits the shards that it names: both sides have a column ``shard``.

    The rows of a shard come first and make up its ``index = search(table)``; then its
    queries stream past in batches, ``index(table)`` giving a record batch each.  So a
    task holds one shard and one batch, however many queries a shard has, and a row
    is shuffled once however many there are."""
    points, queries = points.withColumn("tag", F.lit(0)), queries.withColumn("tag", F.lit(1))
    both = points.unionByName(queries, allowMissingColumns=True)
    return both.repartition("shard").sortWithinPartitions("shard", "tag").mapInArrow(_streamed(search), schema)


def _streamed(search: Callable):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in it:
            shards, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "tag"))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(tags) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if shards[s] != at:
                    at, held, index = shards[s], [], None
                if tags[s] == 0:
                    held.append(part)
                elif held or index is not None:
                    if index is None:
                        index, held = search(pa.Table.from_batches(held)), []
                    yield index(pa.Table.from_batches([part]))
    return run

"""Operator 11: short codes for vectors by Lloyd rounds whose members live with their codebook entry.

A vector becomes integers, floor(scale * x), and is cut into consecutive parts.  Each part
position has a codebook of a few entries.  A part is a member of its nearest entry and
lives with the entry's owners, which are the partitions of (position, entry, salt): the salt
follows the row and spreads the members of one entry, be they all rows, over as many
owners as there are salts.  A round:

1. owners sum their resident members; the sums meet in a tree and make the new codebook,
   the only thing that reaches the driver (entries x dimension integers);
2. owners find each member's nearest new entry; members that keep theirs stay in the partition
   (a narrow dependency), and only members with a new entry go through the shuffle.

All arithmetic is on integers and exact: in float64 where no value passes 2**53, else in
Python's integers.  Members are kept on the executors' memory and disk and written to the
checkpoint folder every ``CUT`` rounds; a lost executor's partitions are computed again from there.
"""
from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors as vec

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bytes of the members that one owner may hold if one entry has all rows (8 bytes a component).
OWNER_BYTES = 16 << 20
CUT = 3
SALTS_LEAST = 2
LONG = (1 << 63) - 1


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v), as float64 where that is exact for every sum of squares, else as Python's integers."""
    z = np.floor(scale * v)
    if z.size and 4 * z.shape[1] * float(np.abs(z).max()) ** 2 >= 2.0 ** 53:
        with np.errstate(over="ignore"):
            z = np.array([[int(scale * int(x)) if x == int(x) else int(np.floor(scale * x)) for x in row] for row in v.tolist()], dtype=object)
    return z


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and squared distance of every part."""
    largest = max((abs(m.min()), abs(m.max())) for m in (parts, book) if m.size) if parts.size else (0, 0)
    if parts.dtype == object or book.dtype == object or 4 * parts.shape[1] * float(max(largest)) ** 2 >= 2.0 ** 53:
        parts, book = (np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (parts, book))
    best, entry = None, np.zeros(len(parts), np.int64)
    for e in range(len(book)):
        d = np.square(parts - book[e]).sum(axis=1) if parts.shape[1] else np.zeros(len(parts))
        if best is None:
            best = d
        else:
            closer = (d < best).astype(bool)
            entry[closer] = e
            best = np.where(closer, d, best)
    return entry, best


class Layout:
    """Which partition owns the members of (position, entry) with a row's salt."""

    def __init__(self, parts: int, salts: int):
        self.parts, self.salts = parts, salts

    def owners(self, position: int, entry: np.ndarray, rows: np.ndarray) -> np.ndarray:
        salt = (rows >> 10) + (rows >> 33) * 7919  # runs of rows share one, so that blocks are few
        return position * self.salts + (entry + salt) % self.salts

    def position(self, owner: int) -> int:
        return owner // self.salts

    def blocks(self, position: int, entry: np.ndarray, rows: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """(owner, (rows, entry, parts)): the members, sorted by their owner."""
        owner = self.owners(position, entry, rows)
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for at in np.split(order, cuts):
            if len(at):
                yield int(owner[at[0]]), (rows[at], entry[at], parts[at])


def _deal(layout: Layout, books: list[np.ndarray], scale: int):
    """Rows (row, v) -> (owner, block): parts with their first entry, cut out by owner."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            rows, z = batch.column(0).to_numpy(), integers(vec.matrix(batch.column(1)), scale)
            found = [b for p, part in enumerate(np.array_split(z, layout.parts, axis=1))
                     for b in layout.blocks(p, nearest(part, books[p])[0], rows, part)]
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in found], pa.int64()),
                                              pa.array([pickle.dumps(b) for _, b in found], pa.binary())], names=["owner", "block"])
    return run


def _merged(it: Iterator) -> Iterator:
    """One block of each owner of a partition: residents and arrivals."""
    held: dict[int, list] = {}
    for owner, block in it:
        held.setdefault(owner, []).append(block)
    for owner, blocks in held.items():
        yield owner, tuple(np.concatenate(x) for x in zip(*blocks))


def _sums(layout: Layout):
    """Members -> per (position, entry): their number and the sum of their parts, as Python's integers."""
    def run(it: Iterator) -> Iterator[dict]:
        out: dict = {}
        for owner, (_, entry, parts) in it:
            for e in np.unique(entry).tolist():
                mine = parts[entry == e]
                total = [sum(map(int, c)) for c in mine.T] if mine.dtype == object else mine.astype(np.int64).sum(axis=0).tolist()
                _add(out, {(layout.position(owner), e): (len(mine), total)})
        yield out
    return run


def _add(a: dict, b: dict) -> dict:
    for key, (n, total) in b.items():
        m, other = a.get(key, (0, [0] * len(total)))
        a[key] = (m + n, [x + y for x, y in zip(other, total)])
    return a


def _book(rows: list[list[int]]) -> np.ndarray:
    """A codebook as float64, or as Python's integers where float64 would round."""
    large = any(abs(x) >= 1 << 53 for row in rows for x in row)
    return np.array(rows, dtype=object if large else np.float64).reshape(len(rows), -1)


def _owner(key: int) -> int:
    return key


def _migrate(home: RDD, layout: Layout, books: list[np.ndarray], partitions: int) -> RDD:
    """Members under new codebooks: those that keep their owner stay, the others are shuffled to theirs."""
    def moved(stay: bool):
        def run(it: Iterator) -> Iterator:
            for owner, (rows, _, parts) in it:
                p = layout.position(owner)
                for to, block in layout.blocks(p, nearest(parts, books[p])[0], rows, parts):
                    if (to == owner) == stay:
                        yield to, block
        return run

    stays = home.mapPartitions(moved(True), preservesPartitioning=True)
    goes = home.mapPartitions(moved(False)).partitionBy(partitions, _owner)
    return stays.union(goes).mapPartitions(_merged, preservesPartitioning=True)


def train(x: DataFrame, n: int, dim: int, parts: int, entries: int, rounds: int, scale: int) -> tuple[RDD, list, Layout]:
    """Members (owner, (rows, entry, parts)) under the final codebooks, and these: per position rows of integers."""
    from eventlens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(x.sparkSession)
    first = x.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = integers(np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), dim), scale)
    plain = [[[int(c) for c in row] for row in part.tolist()] for part in np.array_split(start, parts, axis=1)]
    books = [_book(b) for b in plain]
    per = max(1, OWNER_BYTES // (8 * max(1, -(-dim // parts))))
    layout = Layout(parts, max(SALTS_LEAST, -(-n // per)))
    partitions = parts * layout.salts
    dealt = x.select("row", "v").mapInArrow(_deal(layout, books, scale), "owner long, block binary")
    home = (dealt.rdd.map(lambda r: (r[0], pickle.loads(r[1]))).partitionBy(partitions, _owner)
            .mapPartitions(_merged, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK))
    before = None
    for k in range(rounds):
        sums = home.mapPartitions(_sums(layout)).treeAggregate({}, _add, _add)  # this job makes the members of ``home``
        if before is not None:
            before.unpersist()
        plain = [[[t // sums[p, e][0] for t in sums[p, e][1]] if (p, e) in sums else row for e, row in enumerate(b)] for p, b in enumerate(plain)]
        books, before = [_book(b) for b in plain], home
        home = _migrate(home, layout, books, partitions).persist(StorageLevel.MEMORY_AND_DISK)
        if k % CUT == CUT - 1:
            home.checkpoint()
    return home, plain, layout


def _coded(layout: Layout, books: list[np.ndarray]):
    def run(it: Iterator) -> Iterator[tuple]:
        for owner, (rows, entry, parts) in it:
            p = layout.position(owner)
            at, d = nearest(parts, books[p])
            yield p, pickle.dumps((rows, at, [int(x) if int(x) <= LONG else None for x in d.tolist()]))
    return run


def _exploded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for p, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, entry, error = pickle.loads(packed)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.full(len(rows), p, np.int32)),
                                              pa.array(entry, pa.int64()), pa.array(error, pa.int64())], names=["row", "part", "entry", "error"])


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
          id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a finite vector.

    Rows with a null or empty vector, or one with null or non-finite components, are dropped, as are
    rows whose vector has not the commonest length.  A length that ``parts`` does not divide is cut
    into parts of which the first are one longer.  Rows that repeat an id are rows of their own; a row with
    a null id is coded too, and its id comes last among the first codebooks' ids.  With fewer rows than
    ``entries`` the codebooks are as short.  An error beyond a long is null.  Equal labels' errors
    are summed, nulls together.  An empty table gives an empty result."""
    x, n, dim = vec.usable(vectors, "lloyd-vectors", id=id_col, v=vector_col, label=label_col)
    spark = x.sparkSession
    if n == 0:
        return x.filter("false").select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                        F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    home, books, layout = train(x, n, dim, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(str(c) for b in books for row in b for c in row).encode()).hexdigest()
    packed = spark.createDataFrame(home.mapPartitions(_coded(layout, [_book(b) for b in books])), "part int, packed binary")
    members = packed.mapInArrow(_exploded, "row long, part int, entry long, error long")
    one = F.array_sort(F.collect_list(F.struct("part", "entry")))
    coded = common.materialize(members.groupBy("row").agg(
        F.concat_ws("", F.transform(one, lambda m: F.lower(F.lpad(F.hex(m["entry"]), 2, "0")))).alias("code"),
        F.when(F.count("error") == parts, F.try_sum("error")).alias("error")), "lloyd-codes")
    home.unpersist()
    out = common.materialize(x.select("row", "id", "label").join(coded, "row").drop("row"), "lloyd-rows")
    by_label = out.groupBy(F.col("label").alias("of")).agg(
        F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    return out.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows in DuckDB SQL, by plain grouping, for a table ``embeddings`` of one length and no repeated ids."""
    head = f"""with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as z
  from embeddings where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select vec_id, (k - 1) // (len(z) // {parts}) as p, (k - 1) % (len(z) // {parts}) as c, z[k] as x
  from (select vec_id, z, unnest(range(1, len(z) + 1)) as k from kept)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < {entries}),
book0 as materialized (select p, e, c, x from parts join first using (vec_id)),
"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} as materialized (
  select vec_id, p, arg_min(e, d * {entries} + e) as e, min(d) as d from (
    select vec_id, a.p, b.e, cast(sum((a.x - b.x) * (a.x - b.x)) as bigint) as d
    from parts a join book{r} b on a.p = b.p and a.c = b.c group by vec_id, a.p, b.e)
  group by vec_id, p)""")
        if r < rounds:
            steps.append(f"""book{r + 1} as materialized (
  select b.p, b.e, b.c, coalesce(m.x, b.x) as x from book{r} b left join (
    select a.p, n.e, a.c, cast(floor(cast(sum(a.x) as bigint) / count(*)) as bigint) as x
    from parts a join near{r} n using (vec_id, p) group by a.p, n.e, a.c) m using (p, e, c))""")
    return head + ",\n".join(steps) + f""",
coded as (
  select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near{rounds} group by vec_id),
books as (select sha256(string_agg(cast(x as varchar), ',' order by p, e, c)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (vec_id), books"""

"""Operator 9: near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch.  Round after round hashes every shingle to a random bin; a bin keeps the
smallest (round, hash) it has seen, and the rounds end when every bin is filled.
Should bins stay empty after as many rounds as there are bins, the next rounds fill
them one by one.  So all coordinates are always filled, most documents need a few
rounds, and the share of equal coordinates of two sketches concentrates around the
similarity of their sets.

Banding.  250 coordinates form 50 bands of 5.  Two sets of similarity 0.75 share no
band with probability (1 - 0.75**5)**50 = 1.3e-6.

Verification, without all pairs of a group:

1. Rows with equal shingle sets collapse to one node, which remembers their smallest id.
2. In every band bucket each member is compared with the bucket's smallest member
   only (linear in the bucket), on full sets.  Links give components.
3. Buckets that still hold several components are searched completely, in blocks of
   bounded size: an inverted index over the full sets of one block gives the exact
   intersections with each member of another.  Only links that join components leave
   the task, fewer than its members, so no link is lost that matters and no list of
   pairs is ever made.
4. Components of all links are final.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words
from .words import U64

BANDS, ROWS = 50, 5
BINS = BANDS * ROWS
PERCENT = 75
#: Shingles of one block of a bucket's complete search (8 bytes each).
BLOCK = 500_000
_ROUND_BITS = U64(48)
_LOW = U64((1 << 48) - 1)


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The filled bins: smallest (round << 48 | hash) per bin.  ``shingles`` must not be empty."""
    out = np.full(bins, np.iinfo(np.uint64).max, dtype=U64)
    n, done = len(shingles), 0
    step = max(1, -(-8 * bins // n))  # several rounds at once for small sets
    while done < bins:
        rounds = np.arange(done, min(bins, done + step), dtype=U64)
        x = words.mix(shingles[None, :] + words.mix(rounds + U64(0x51ED270B))[:, None])
        where = ((x >> _ROUND_BITS) * U64(bins)) >> U64(16)
        np.minimum.at(out, where.ravel().astype(np.intp), ((rounds[:, None] << _ROUND_BITS) | (x & _LOW)).ravel())
        done += len(rounds)
        if out.max() >> _ROUND_BITS < U64(0xFFFF):
            break
    for k in np.flatnonzero(out >> _ROUND_BITS == U64(0xFFFF)):  # rounds bins .. 2 * bins - 1: one bin each
        x = words.mix(shingles + words.mix(np.full(1, bins + k, dtype=U64)))
        out[k] = (U64(bins + k) << _ROUND_BITS) | (x & _LOW).min()
    return out


def band_keys(filled: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands never meeting by construction of the key."""
    rows = words.mix(filled.reshape(BANDS, ROWS))
    key = np.arange(1, BANDS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        key = words.mix(key + rows[:, k])
    return key


def _profiles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in it for part in words.slices(whole, 1)):
        ids, sizes, sets, bands = batch.column(0), [], [], []
        for text in batch.column(1).to_pylist():
            s = words.shingle_set(text)
            sizes.append(len(s))
            if len(s):
                sets.append(set_key(s.tobytes()))
                bands.append(band_keys(sketch(s)).view(np.int64))
            else:
                sets.append(None), bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column(2)],
            names=["id", "n", "set_key", "bands", "text_key"])


def set_key(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in it for part in words.slices(whole, 0)):
        sets = [words.shingle_set(t).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "shingles"])


def _verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, set_a, set_b) with 100 |intersection| >= 75 |union|."""
    for batch in it:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
            if 100 * min(len(p), len(q)) < PERCENT * max(len(p), len(q)):
                keep.append(False)
                continue
            both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _cross_links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, block, id, component, shingles), one (bucket, i, j) after the other ->
    links between members of block i and members of block j that lie in different components,
    without those that earlier ones of the group imply: fewer links than members."""
    def links(rows: dict) -> pa.RecordBatch:
        component, ids, sets = rows["component"], rows["id"], rows["shingles"]
        left, right = (np.flatnonzero(rows["block"] == rows[c][0]) for c in "ij")
        sizes = np.array([len(x) // 8 for x in sets])
        # inverted index of the right side: shingle -> members, as one sorted array
        flat = np.frombuffer(b"".join(sets[k] for k in right), dtype=U64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(right)), sizes[right])[order]
        parent = {c: c for c in component.tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        a, b = [], []
        for k in left.tolist():
            own = np.frombuffer(sets[k], dtype=U64)
            lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
            both = np.bincount(owner[at], minlength=len(right))
            for r in right[100 * both >= PERCENT * (sizes[right] + sizes[k] - both)].tolist():
                x, y = root(int(component[k])), root(int(component[r]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(min(ids[k], ids[r])), b.append(max(ids[k], ids[r]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ("bucket", "i", "j", "block", "id", "component")
    held: dict | None = None  # the group that the last batch may have cut
    for batch in it:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns} | {"shingles": batch.column("shingles").to_pylist()}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in columns} | {"shingles": held["shingles"] + rows["shingles"]}
        new = np.flatnonzero((np.diff(rows["bucket"]) != 0) | (np.diff(rows["i"]) != 0) | (np.diff(rows["j"]) != 0)) + 1
        starts = [0, *new.tolist()]
        for s, e in zip(starts, starts[1:]):
            yield links({c: v[s:e] for c, v in rows.items()})
        held = {c: v[starts[-1]:] for c, v in rows.items()}
    if held is not None:
        yield links(held)


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The verified ones of distinct pairs (a, b).  Both joins are sort-merge joins whose hot keys AQE splits."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(_verified, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    ``component_id`` is the smallest id reachable over links (100 |A n B| >= 75 |A u B| on
    5-word shingle sets), ``kept`` says id = component_id.  A null or empty text has no
    shingles and is linked with nothing.  Rows that repeat an id are rows of their own: each has
    the component of its own text, so no text is lost with another one's.  A row with a null id
    is linked with nothing, has a null component and is kept.  An empty table gives an empty result."""
    placed = _placed(common.columns(docs, id=id_col, text=text_col))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``components`` keeps.

    Rows that repeat an id are judged each by its own text; rows of the same id and text stay or go together."""
    text_key = f"text_key_{id(docs)}"
    keyed = docs.withColumn(text_key, F.sha2(F.col(f"`{text_col}`"), 256))
    placed = _placed(keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), F.sha2("text", 256))
    dropped = placed.filter("not kept").select(F.col("id").alias(id_col), F.col("text_key").alias(text_key)).distinct()
    return keyed.join(dropped, [id_col, text_key], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _placed(src: DataFrame, text_key: Column | None = None) -> DataFrame:
    """(id, n, text_key, component_id, kept) for rows (id, text)."""
    read = src.withColumn("text_key", F.lit(None).cast("string") if text_key is None else text_key)
    profiles = read.select("id", "text", "text_key").mapInArrow(_profiles, "id long, n long, set_key binary, bands array<long>, text_key string")
    profiles = common.materialize(profiles.withColumn("row", F.monotonically_increasing_id()), "near-profiles")
    usable = profiles.filter("id is not null and set_key is not null")
    # a set is one node, whatever rows have it; its number is that of a row
    reps = common.materialize(usable.groupBy("set_key").agg(
        F.min("row").alias("rep"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-reps")
    members = reps.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"), "n")
    shared = (members.groupBy("bucket").agg(F.min("id").alias("center"), F.max("id").alias("last"), F.sum("n").alias("weight"))
              .filter("center <> last").select("bucket", "center", "weight"))
    crowded = common.materialize(members.drop("n").join(shared, "bucket"), "near-buckets")

    star = crowded.filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    star = common.materialize(star, "near-star")
    involved = common.materialize(reps.join(crowded.select(F.col("id").alias("rep")).distinct(), "rep").select("set_key", "rep", "least"), "near-involved")
    texts = src.filter("id is not null").join(involved.select(F.col("least").alias("id")).distinct(), "id", "left_semi").select("text")
    sets = common.materialize(texts.mapInArrow(_sets, "set_key binary, shingles binary").groupBy("set_key").agg(F.first("shingles").alias("shingles"))
                              .join(involved, "set_key").select(F.col("rep").alias("id"), "shingles"), "near-sets")
    links = common.materialize(_links(star, sets), "near-links")
    first = common.connected_components(links)

    mixed = crowded.select("bucket", "id", "weight").join(first.withColumnRenamed("node", "id"), "id", "left")
    mixed = mixed.withColumn("component", F.coalesce("component", "id"))
    open_ = (mixed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo <> hi").select("bucket"))
    # a block holds BLOCK shingles on average, and every two blocks of a bucket meet in one group
    left = (mixed.join(open_, "bucket", "left_semi")
            .withColumn("blocks", F.ceil(F.col("weight") / BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .join(sets, "id")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    "block", "id", "component", "shingles"))
    more = common.materialize(left.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
                              .mapInArrow(_cross_links, "a long, b long"), "near-links")
    final = common.connected_components(
        more.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    by_set = (reps.select("set_key", "rep", "least").join(final.withColumnRenamed("node", "rep"), "rep", "left")
              .select("set_key", "least", F.coalesce("component", "rep").alias("component")))
    smallest = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = by_set.join(smallest, "component").select("set_key", "component_id")
    out = profiles.select("id", "n", "text_key", "set_key").join(by_set, "set_key", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id"))
    return out.select("id", "n", "text_key", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

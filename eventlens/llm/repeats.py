"""Operator 2: removal of word passages that repeat across documents, by fixed-block anchors.

Every run of 50 words holds a whole 25-word block of its document's grid (blocks start
at words 0, 25, 50, ...).  So:

1. Anchors.  Each document's grid blocks are indexed by hash, and every rolling 25-word
   window of every document probes the index.  A probe hits if a smaller document
   holds the block; a block is hit if a larger document probes it.
2. Extension.  Around hits, and only there, every 50-word window is a candidate.  Candidates
   meet by a 96-bit hash; one that also starts in a smaller document is a repeat, and
   overlapping repeats merge into maximal passages.
3. The words covered by repeats are removed.

Windows never travel as rows, and finds come back packed by chunks of documents: a task packs the hashes of a slice of its documents by
bucket, so step 1 moves about 5 bytes a word.  The number of buckets follows the
corpus' characters, which keeps a bucket's arrays at a few MB at every size.  One hash
held by a third of all documents is a small part of a bucket, since a document spreads
its windows over all buckets.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import common, words
from .words import U64

WINDOW, BLOCK = 50, 25
#: Characters of one packed slice of documents, and of the corpus for one bucket.
SLICE_CHARS = 4_000_000
BUCKET_CHARS = 2_000_000
#: Buckets' worth of characters whose documents get their finds back as one chunk.
CHUNK_BUCKETS = 8
_LOW32 = U64(0xFFFFFFFF)


def _slices(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The rows of a batch, cut so that a slice has about SLICE_CHARS characters."""
    out, size = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns)):
        out.append(row)
        size += len(row[1] or "")
        if size >= SLICE_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


def text_key(text: str) -> int:
    """Tells apart different texts that share a document id."""
    return xxh3_64_intdigest(text.encode()) >> 1


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket from a hash's upper half; the lower half tells entries of a bucket apart."""
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _pack(bucket: np.ndarray, owner: np.ndarray, docs: np.ndarray, keys: np.ndarray, parts: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket: the owners (document ids, text keys, entries each) and the packed parts, owner by owner."""
    order = np.argsort(bucket, kind="stable")  # entries come owner by owner, and stay so in a bucket
    bucket, owner = bucket[order], owner[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    ends = [*starts[1:].tolist(), len(bucket)]
    cols: dict[str, list] = {c: [] for c in ("docs", "keys", "counts", *parts)}
    for s, e in zip(starts.tolist(), ends):
        who, first = np.unique(owner[s:e], return_index=True)
        cols["docs"].append(docs[who].tobytes())
        cols["keys"].append(keys[who].tobytes())
        cols["counts"].append(np.diff([*first, e - s]).astype("<i4").tobytes())
        for c, v in parts.items():
            cols[c].append(v[order[s:e]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), *(pa.array(v, pa.binary()) for v in cols.values())],
                                      names=["bucket", *cols])


def _unpack(rows: pd.DataFrame, parts: dict[str, str]) -> tuple:
    docs = np.frombuffer(b"".join(rows["docs"]), "<i8")
    keys = np.frombuffer(b"".join(rows["keys"]), "<i8")
    counts = np.frombuffer(b"".join(rows["counts"]), "<i4")
    return np.repeat(docs, counts), np.repeat(keys, counts), *(np.frombuffer(b"".join(rows[c]), t) for c, t in parts.items())


def _anchors(buckets: int):
    """Documents -> packed 25-word windows: their lower hash halves and whether they are grid blocks."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in _slices(batch):
                ids, keys, hs, grids = [], [], [], []
                for doc, text in rows:
                    w = words.split(text)
                    if len(w) >= WINDOW:
                        h = words.windows(words.hashes(w), BLOCK)
                        grid = np.zeros(len(h), dtype=np.uint8)
                        grid[::BLOCK] = 1
                        ids.append(doc), keys.append(text_key(text)), hs.append(h), grids.append(grid)
                if ids:
                    h = np.concatenate(hs)
                    owner = np.repeat(np.arange(len(ids)), [len(x) for x in hs])
                    # the lowest bit of the hash gives way to the grid mark
                    low = (h & U64(0xFFFFFFFE) | np.concatenate(grids).astype(U64)).astype("<u4")
                    yield _pack(_bucket(h, buckets), owner, np.array(ids, "<i8"), np.array(keys, "<i8"), {"h": low})
    return run


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of rows that are equal in all columns."""
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)] if len(columns[0]) else np.empty(0, bool)
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], len(columns[0])]))


def _by_chunk(doc: np.ndarray, key: np.ndarray, value: np.ndarray, chunks: int) -> pd.DataFrame:
    """One row per chunk of documents, with owners and values packed."""
    chunk = (words.mix(doc.astype(U64)) % U64(chunks)).astype(np.int64)
    order = np.lexsort((key, doc, chunk))
    chunk, doc, key, value = chunk[order], doc[order], key[order], value[order]
    runs = _runs(chunk)
    return pd.DataFrame({"chunk": np.array([chunk[s] for s, _ in runs], np.int64),
                         **{c: np.array([v[s:e].tobytes() for s, e in runs] + [b""], object)[:-1] for c, v in (("docs", doc), ("keys", key), ("packed", value))}})


def _by_text(dtype: str):
    """A chunk's rows -> one row per (document, text) with its packed values."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        doc, key, value = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("docs", "<i8"), ("keys", "<i8"), ("packed", dtype)))
        order = np.lexsort((key, doc))
        doc, key, value = doc[order], key[order], value[order]
        runs = _runs(doc, key)
        at = np.array([s for s, _ in runs], np.int64)
        return pd.DataFrame({"id": doc[at], "key": key[at], "packed": np.array([value[s:e].tobytes() for s, e in runs] + [b""], object)[:-1]})
    return run


def _hits(rows: pd.DataFrame, chunks: int) -> pd.DataFrame:
    """A bucket's windows -> by text the hashes (bucket << 32 | lower half) of its hits and of its blocks that were hit."""
    bucket = int(rows["bucket"].iloc[0])
    doc, key, h = _unpack(rows, {"h": "<u4"})
    grid, h = (h & 1).astype(bool), h & np.uint32(0xFFFFFFFE)
    entries, where = np.unique(h[grid], return_inverse=True)
    if not len(entries):
        return _by_chunk(doc[:0], key[:0], h[:0], chunks)
    low = np.full(len(entries), np.iinfo(np.int64).max)
    np.minimum.at(low, where, doc[grid])  # smallest document that holds the block
    at = np.searchsorted(entries, h)
    at[at == len(entries)] = 0
    known = np.flatnonzero(entries[at] == h)
    at, doc, key, h, grid = at[known], doc[known], key[known], h[known], grid[known]
    high = np.full(len(entries), np.iinfo(np.int64).min)
    np.maximum.at(high, at, doc)  # largest document that probes the block
    keep = (low[at] < doc) | (grid & (high[at] > doc))
    return _by_chunk(doc[keep], key[keep], (np.uint64(bucket) << U64(32)) | h[keep].astype(U64), chunks)


def _candidates(buckets: int):
    """Texts with their hits -> packed 50-word windows that hold a hit: hash (64 + 32 bits) and start."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for rows in _slices(batch):
                ids, keys, hs, gs, ps = [], [], [], [], []
                for doc, text, hits in rows:
                    w = words.hashes(words.split(text))
                    h = words.windows(w, BLOCK)
                    mark = (_bucket(h, buckets).astype(U64) << U64(32)) | (h & U64(0xFFFFFFFE))
                    hit = np.isin(mark, np.unique(np.frombuffer(b"".join(hits), "<u8")))
                    # a window starting at s holds the hits at s .. s + 25
                    sums = np.r_[0, np.cumsum(hit)]
                    n = len(w) - WINDOW + 1
                    start = np.flatnonzero(sums[WINDOW - BLOCK + 1 :][:n] > sums[:n])
                    if len(start):
                        ids.append(doc), keys.append(text_key(text)), ps.append(start.astype("<u4"))
                        hs.append(words.windows(w, WINDOW)[start])
                        gs.append((words.windows(words.mix(w + U64(1)), WINDOW)[start] & _LOW32).astype("<u4"))
                if ids:
                    h = np.concatenate(hs)
                    owner = np.repeat(np.arange(len(ids)), [len(x) for x in hs])
                    yield _pack(_bucket(h, buckets), owner, np.array(ids, "<i8"), np.array(keys, "<i8"),
                                {"h": h, "g": np.concatenate(gs), "p": np.concatenate(ps)})
    return run


def _repeats(rows: pd.DataFrame, chunks: int) -> pd.DataFrame:
    """A bucket's candidates -> by text the starts of those that also start in a smaller document."""
    doc, key, h, g, p = _unpack(rows, {"h": "<u8", "g": "<u4", "p": "<u4"})
    order = np.lexsort((doc, g, h))
    d, same = doc[order], np.r_[False, (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(d))))
    keep = order[d > d[first]]
    return _by_chunk(doc[keep], key[keep], p[keep], chunks)


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text, starts) -> (id, key, n_removed, kept text)."""
    for batch in it:
        ids, keys, removed, kept = [], [], [], []
        for doc, key, text, starts in zip(*(c.to_pylist() for c in batch.columns)):
            w = words.split(text)
            s = np.frombuffer(b"".join(starts), "<u4").astype(np.int64)
            edge = np.zeros(len(w) + 1, dtype=np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + WINDOW, -1)
            covered = np.cumsum(edge)[:-1] > 0
            ids.append(doc), keys.append(key), removed.append(int(covered.sum()))
            kept.append(b" ".join([x for x, c in zip(w, covered.tolist()) if not c]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=["id", "key", "n_removed", "kept"])


def _plain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, key, n_words, SHA-256 of all words)."""
    for batch in it:
        keys, counts, digests = [], [], []
        for text in batch.column(1).to_pylist():
            w = words.split(text)
            keys.append(text_key(text) if text is not None else None)
            counts.append(len(w))
            digests.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                                         names=["id", "key", "n_words", "sha"])


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets in proportion to the corpus: one per BUCKET_CHARS characters."""
    chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")).cast("long"))).first()[0]
    return 1 + (chars or 0) // BUCKET_CHARS


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, key long, n_removed long, kept string) for each distinct (id, text) that loses words.

    A word goes if a 50-word window that covers it also starts in a document with a
    smaller id; windows are judged on the input.  Texts of fewer than 50 words, null
    texts and rows with a null id lose nothing and match nothing.  Rows that repeat an
    id are texts of one document: they do not make each other repeats."""
    src = common.columns(docs, id=id_col, text=text_col).filter("id is not null and text is not null")
    src = src.select(F.col("id").cast("long").alias("id"), "text")
    n = buckets_for(src)
    chunks = 1 + n // CHUNK_BUCKETS
    returned = "chunk long, docs binary, keys binary, packed binary"
    packed = "bucket long, docs binary, keys binary, counts binary"
    hits = (src.mapInArrow(_anchors(n), f"{packed}, h binary").groupBy("bucket")
            .applyInPandas(lambda rows: _hits(rows, chunks), returned))
    hits = hits.groupBy("chunk").applyInPandas(_by_text("<u8"), "id long, key long, packed binary").withColumnRenamed("packed", "hits")
    hits = common.materialize(hits, "repeat-hits").groupBy("id").agg(F.collect_list("hits").alias("hits"))
    texts = common.materialize(src.join(hits, "id"), "repeat-texts")
    starts = (texts.mapInArrow(_candidates(n), f"{packed}, h binary, g binary, p binary").groupBy("bucket")
              .applyInPandas(lambda rows: _repeats(rows, chunks), returned))
    starts = starts.groupBy("chunk").applyInPandas(_by_text("<u4"), "id long, key long, packed binary").withColumnRenamed("packed", "starts")
    starts = common.materialize(starts, "repeat-starts").groupBy("id", "key").agg(F.collect_list("starts").alias("starts"))
    keyed = texts.select("id", "text").mapInArrow(_keyed, "id long, key long, text string")
    return (keyed.join(starts, ["id", "key"]).select("id", "key", "text", "starts")
            .mapInArrow(_cut, "id long, key long, n_removed long, kept string").dropDuplicates(["id", "key"])
            .withColumnRenamed("id", id_col))


def _keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keys = [text_key(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), batch.column(1)], names=["id", "key", "text"])


def digests(docs: DataFrame) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed, kept_sha256.  A null text has no words."""
    plain = common.columns(docs, id="doc_id", text="text").mapInArrow(_plain, "id long, key long, n_words long, sha string")
    cut = repeated_passages(docs).select(F.col("doc_id").alias("id"), "key", "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    return plain.join(cut, ["id", "key"], "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"))

"""Operator 1: byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be
merged across, so it marks a certain cut.  Two kinds of certain cut are used:

* between a non-space and a white-space character of the text (the pre-tokeniser
  starts a piece there in every context, and no token holds such a pair);
* inside the pre-tokeniser's pieces, wherever the 256 x 256 table of byte pairs,
  built from the vocabulary, says that the pair occurs in no token.

Fragments are encoded independently of each other (equal fragments once per worker,
through a bounded cache) and their ids concatenated.  The second kind keeps long runs
of unusual bytes short; what remains is merged with a heap, so a fragment of n bytes
costs O(n log n) however long it is.

The vocabulary file's path is a parameter.  It is parsed once on the driver and
broadcast: its size is bounded by the vocabulary (about 4 MB for 50,000 tokens).
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Fixed value: the pre-tokeniser pattern of the vocabulary's format.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space (Unicode's; Python's adds four control characters), then anything else: both ends are certain cuts.
FRAGMENTS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
SPACE_RUN = re.compile(r"[^\S\x1c-\x1f] ")
#: Bound on a worker's cache: two generations of so many fragments of at most so many characters.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64
NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1
    bytes stand for themselves, the others take code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Parse a byte-level BPE file into plain tables (id -> bytes, pair -> merged id, cuts)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, model = byte_alphabet(), spec["model"]
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    if any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that strip or match whole words only are not supported")
    ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    token_bytes = [b""] * (max([*ids.values(), *added.values()]) + 1)
    for t, i in ids.items():
        token_bytes[i] = t
    for t, i in added.items():
        token_bytes[i] = t.encode()
    inside = np.zeros((256, 256), dtype=bool)
    for t in ids:
        for a, b in zip(t, t[1:]):
            inside[a, b] = True
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = (bytes(letters[c] for c in p) for p in (pair.split(" ") if isinstance(pair, str) else pair))
        merges.setdefault((ids[left], ids[right]), rank << 24 | ids[left + right])
    return {"bytes": token_bytes, "single": [ids[bytes([b])] for b in range(256)], "merges": merges,
            "cut": frozenset(zip(*(x.tolist() for x in np.nonzero(~inside)))), "added": added}


class FragmentCache(dict):
    """Value of the fragment ``prefix + key`` for each key.

    Bounded: when the young generation is full it becomes the old one, and what is
    not asked for again goes with the next turn."""

    def __init__(self, compute, prefix: str = " "):
        super().__init__()
        self.compute, self.prefix, self.old = compute, prefix, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.compute(self.prefix + key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def values_of(self, text: str):
        """The value of every fragment of ``text``, in order."""
        if SPACE_RUN.search(text):
            return [self[f[1:]] if f[0] == " " else self.compute(f) for f in FRAGMENTS.findall(text)]
        head, *rest = text.split(" ")  # each space follows a non-space: a certain cut
        return [*map(self.compute, FRAGMENTS.findall(head)), *map(self.__getitem__, rest)]


class Codec:
    """Encodes and decodes one text at a time; lives in a Python worker."""

    def __init__(self, vocabulary: dict):
        self.bytes, self.single, self.merges = vocabulary["bytes"], vocabulary["single"], vocabulary["merges"]
        self.cut, self.added = vocabulary["cut"], vocabulary["added"]
        self.pieces = regex.compile(PIECES).findall
        names = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.fragments, self.parts = FragmentCache(self.encode_fragment), FragmentCache(self.encode_piece, "")

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not any(s in text for s in self.added):
            return b"".join(self.fragments.values_of(text))
        out = []
        for k, part in enumerate(self.specials.split(text)):
            out.append(np.uint32(self.added[part]).tobytes() if k % 2 else b"".join(self.fragments.values_of(part)))
        return b"".join(out)

    def encode_fragment(self, fragment: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.pieces(fragment)))

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        if len(raw) == 1:
            out = [self.single[raw[0]]]
        elif any(map(self.cut.__contains__, zip(raw, raw[1:]))):
            ends = [k for k, pair in enumerate(zip(raw, raw[1:]), 1) if pair in self.cut]
            out = [i for a, b in zip([0, *ends], [*ends, len(raw)]) for i in self.merge(raw[a:b])]
        else:
            out = self.merge(raw)
        return struct.pack(f"<{len(out)}I", *out)

    def merge(self, raw: bytes) -> list[int]:
        """Apply the merges of ``raw`` in order of rank, leftmost first."""
        if len(raw) > 48:
            return self.merge_long(raw)
        ids, rules = [self.single[b] for b in raw], self.merges
        ranks = [rules[p] if p in rules else NEVER for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            k = ranks.index(best)
            ids[k] = new = best & 0xFFFFFF
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                pair = new, ids[k + 1]
                ranks[k] = rules[pair] if pair in rules else NEVER
            if k:
                pair = ids[k - 1], new
                ranks[k - 1] = rules[pair] if pair in rules else NEVER
        return ids

    def merge_long(self, raw: bytes) -> list[int]:
        """``merge`` with a heap over a linked list."""
        ids = [self.single[b] for b in raw]
        n, rules = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rules[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in rules]
        heapq.heapify(heap)
        while heap:
            rule, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue  # one side was merged away in the meantime
            new = rule & 0xFFFFFF
            ids[k], ids[j] = new, -1
            after[k] = nxt = after[j]
            if nxt >= 0:
                before[nxt] = k
                if (rule := rules.get((new, ids[nxt]))):
                    heapq.heappush(heap, (rule, k, new, ids[nxt]))
            if (prev := before[k]) >= 0 and (rule := rules.get((ids[prev], new))):
                heapq.heappush(heap, (rule, prev, ids[prev], new))
        return [i for i in ids if i >= 0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens; ids outside the vocabulary are an error."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _batches(spark: SparkSession, path: str, work):
    """``work(codec, record batch)`` over Arrow batches, one codec per Python worker."""
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in it:
            for part in words.slices(batch, 1):
                yield work(codec, part)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): one row per input row.

    ``ids`` packs the token ids as little-endian unsigned 32-bit integers.  A null text
    counts as empty and gives 0 tokens; repeated rows stay repeated; an empty table
    gives an empty result; other columns are not read."""
    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
            names=["id", "n_tokens", "ids"])

    src = common.columns(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_batches(docs.sparkSession, path, work), f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of packed ids, special tokens included, invalid UTF-8 replaced.
    Null ids decode to the empty text."""
    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [codec.decode(i or b"").decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    src = common.columns(encoded, id=id_col, ids=ids_col)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_batches(encoded.sparkSession, path, work), f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids binary, decoded_sha256): ``encode``, then ``decode`` of those ids, in one
    Python pass over the text, so that the decoded texts need not travel back to the JVM."""
    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
        back = [hashlib.sha256(codec.decode(i).decode("utf-8", "replace").encode()).hexdigest() for i in ids]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back)],
            names=["id", "n_tokens", "ids", "decoded_sha256"])

    src = common.columns(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(_batches(docs.sparkSession, path, work), f"id {kind}, n_tokens long, ids binary, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its packed ids and of the decoded text."""
    return round_trip(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")

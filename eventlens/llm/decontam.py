"""Operator 5: benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents: a fixed-width vector
   in each task, its entries summed by word after the shuffle.
2. Items of more than LONGEST words are cut into passages of equal length; a shorter item is
   one passage.  The passages, as TF-IDF rows, are reduced by a randomised SVD: a random
   projection, power rounds and the final Gram matrix are products A'(A X) over the
   distributed passages; the driver only orthogonalises narrow matrices.
3. Every window of every document is a query.  Windows have about the length of the passages
   they are held against: their stride is the power of two next below a passage's length, and
   a window is two strides long.  Its cosine with a passage is taken in the latent space
   against the window's whole TF-IDF norm.  Words outside the benchmark's vocabulary
   have no latent coordinates, so the norm share of the benchmark's words bounds the cosine;
   windows below the bound are settled without a projection.
4. Candidates are checked on the words around the window: longest common subsequence with the
   whole item, however long, and the same for the item's answer, its last words.  A paraphrase that keeps most
   of the item in order passes although words were changed, dropped or put in.

Passages are worked off in blocks of about ITEM_BLOCK.  Each block has a latent space of
its own with as many dimensions as the block has passages, so the space spans every passage and
keeps its whole energy, however large the benchmark is.  Documents are read once per
PASS_BLOCKS blocks, so what the driver holds and the tasks carry has a fixed bound.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import common
from .words import slices

#: Hashed vocabulary, passages of one block on average, blocks of one pass over the documents, extra dimensions of the projection.
DIMENSIONS, ITEM_BLOCK, PASS_BLOCKS, EXTRA, POWER_ROUNDS = 1 << 18, 128, 8, 16, 2
#: Words of the longest passage.
LONGEST = 32
COSINE, SURE, LIKELY, ANSWER = 0.3, 0.8, 0.6, 0.6
#: Bytes of the documents that a task works on at once; tasks that cut the items, and so files that every product reads.
SLICE_BYTES, CUT_TASKS = 60_000, 8
#: Letters, digits and bytes over 127 make words; the rest separates them.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_WORD_BYTES).split() if text else []


def dims(words: Collection[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[bytes, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def inverse_document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log(1 + documents / (1 + documents with the word)) per hashed word, over all documents."""
    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in (part for whole in it for part in slices(whole, 0)):
            for text in batch.column(0).to_pylist():
                total[dims(set(tokens(text)))] += 1  # an entry that is named twice is still raised once
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[at].tolist(), n], pa.int64())], names=["dim", "n"])

    summed = (common.columns(docs, text=text_col).mapInArrow(counts, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))
              .toArrow())  # DIMENSIONS rows at most, whatever the corpus
    dim, count = summed["dim"].to_numpy(), summed["n"].to_numpy()
    df = np.zeros(DIMENSIONS, dtype=np.int64)
    df[dim[dim >= 0]] = count[dim >= 0]
    return np.log1p(count[dim < 0].sum() / (1.0 + df)).astype(np.float32)


def passages(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(offset, words) of an item's passages: consecutive, near equal, LONGEST words at most."""
    n = -(-len(words) // LONGEST)
    for k in range(n):
        first, end = len(words) * k // n, len(words) * (k + 1) // n
        yield first, words[first:end]


def stride_of(length: int) -> int:
    """Half the window that a passage of ``length`` words is held against."""
    return 1 << max(1, length * 10 // 11).bit_length() - 1


def _passages(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = [(item, whole, first, stride_of(len(words)), b" ".join(words).decode())
                for item, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for first, words in passages(tokens(whole))]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)],
                                         names=["item", "whole", "first", "stride", "text"])


def _tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct dimensions of a passage and its unit TF-IDF weights."""
    d, n = np.unique(dims(tokens(text)), return_counts=True)
    x = n * idf[d].astype(np.float64)
    return d, x / max(1e-12, np.sqrt((x * x).sum()))


def latent_space(items: DataFrame, idf: np.ndarray, vocabulary: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the TF-IDF passages ``items`` (text), by randomised SVD.

    With a rank of at least the number of passages the vectors span them all."""
    weight = idf[vocabulary].astype(np.float64)

    def product(x: np.ndarray) -> np.ndarray:
        """A'(A x), summed over the distributed passages."""
        def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, any_ = np.zeros_like(x), False
            for batch in it:
                for text in batch.column(0).to_pylist():
                    d, n = np.unique(dims(tokens(text)), return_counts=True)
                    if len(d):
                        at = np.searchsorted(vocabulary, d)
                        v = n * weight[at]
                        v /= max(1e-12, np.sqrt((v * v).sum()))
                        out[at] += v[:, None] * (v @ x[at])[None, :]
                        any_ = True
            if any_:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["packed"])

        total = np.zeros_like(x)
        for r in items.select("text").mapInArrow(partial, "packed binary").toLocalIterator():  # one matrix at a time
            total += np.frombuffer(r["packed"], np.float64).reshape(x.shape)
        return total

    k = min(rank + EXTRA, len(vocabulary))
    q = np.random.default_rng(7).standard_normal((len(vocabulary), k))
    for _ in range(1 + POWER_ROUNDS):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    for part in slices(batch, 1, SLICE_BYTES):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


class _Block:
    """A block's passages, each as (its item's place among the items, first word), and the latent product
    of every word of the vocabulary with every passage."""

    def __init__(self, stride: int, parts: list[tuple[int, int, str]], vocabulary: np.ndarray, basis: np.ndarray, idf: np.ndarray):
        self.stride, self.parts = stride, [(source, first) for source, first, _ in parts]
        self.row_of = np.full(DIMENSIONS, -1, dtype=np.int32)
        self.row_of[vocabulary] = np.arange(len(vocabulary))
        q = np.zeros((len(parts), basis.shape[1]), dtype=np.float32)
        for k, (*_, text) in enumerate(parts):
            d, x = _tfidf(text, idf)
            q[k] = x.astype(np.float32) @ basis[np.searchsorted(vocabulary, d)]
        # a window's latent product with a passage is the sum of its words' products
        self.product = (basis * idf[vocabulary][:, None]) @ q.T


class _Strides:
    """Strides of the documents of a slice: first word, document, whether the next one belongs to the same
    document, TF-IDF norm of the window of the two, and the stride of every word."""

    def __init__(self, stride: int, lengths: np.ndarray, ends: np.ndarray, w2: np.ndarray):
        at = [np.arange(e - n, e, stride) for n, e in zip(lengths, ends) if n]
        self.start = np.concatenate(at)
        self.owner = np.repeat(np.flatnonzero(lengths), [len(x) for x in at])
        same = self.owner[1:] == self.owner[:-1]
        self.paired, self.first = np.r_[same, False], np.r_[True, ~same]
        self.norm = self.window_norm(w2)
        self.of_word = np.repeat(np.arange(len(self.start)), np.diff(np.r_[self.start, len(w2)]))

    def window_norm(self, w2: np.ndarray) -> np.ndarray:
        x = np.add.reduceat(w2, self.start)
        return np.sqrt(x + np.where(self.paired, np.r_[x[1:], 0.0], 0.0))


def _search(shared):
    """Documents -> verified (doc, item, cosine, lcs share, answer share)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, items, packed = shared.value
        idf2 = idf.astype(np.float64) ** 2
        blocks = [_Block(*b, idf) for b in packed]
        words_of = [tokens(t) for _, t in items]
        counts_of = [Counter(w) for w in words_of]
        for batch in it:
            out: dict[tuple[int, int], tuple[float, float, float]] = {}
            for ids, texts in _slices(batch):
                tokened = [tokens(t) for t in texts]
                lengths = np.array([len(w) for w in tokened])
                d = dims([w for ws in tokened for w in ws])
                ends = np.cumsum(lengths)
                if not len(d):
                    continue
                w2 = idf2[d]
                strides = {n: _Strides(n, lengths, ends, w2) for n in {b.stride for b in blocks}}
                seen: dict[tuple[int, int], tuple[list, list]] = {}
                for b in blocks:
                    at = strides[b.stride]
                    row = b.row_of[d]
                    bound = at.window_norm(np.where(row >= 0, w2, 0.0))
                    # a window that a longer one of its document contains is left out
                    some = np.flatnonzero((bound >= COSINE * at.norm) & (at.norm > 0) & (at.paired | at.first))
                    if not len(some):
                        continue
                    paired = at.paired[some]
                    needed = np.unique(np.r_[some, some[paired] + 1])
                    rank = np.full(len(at.start), -1)
                    rank[needed] = np.arange(len(needed))
                    words = np.flatnonzero((row >= 0) & (rank[at.of_word] >= 0))
                    own, count = np.unique(rank[at.of_word[words]], return_counts=True)
                    sums = np.zeros((len(needed) + 1, len(b.parts)), dtype=np.float32)
                    sums[own] = np.add.reduceat(b.product[row[words]], np.r_[0, np.cumsum(count)[:-1]], axis=0) if len(own) else 0
                    following = np.where(paired, rank[np.minimum(some + 1, len(at.start) - 1)], len(needed))
                    cosine = (sums[rank[some]] + sums[following]) / at.norm[some][:, None]
                    for k, j in np.argwhere(cosine >= COSINE).tolist():
                        doc, (source, offset) = int(at.owner[some[k]]), b.parts[j]
                        start, found = int(at.start[some[k]] - ends[doc] + lengths[doc]), float(cosine[k, j])
                        key, item = (ids[doc], items[source][0]), words_of[source]
                        best = out.get(key)
                        if best and best[0] >= found and best[1] == best[2] == 1:
                            continue
                        begin, words_here = start - offset, tokened[doc]
                        if len(item) <= LONGEST:
                            _verify(out, key, words_here[max(0, begin - len(item)) : max(0, begin + 2 * b.stride + len(item))], item, counts_of[source], found)
                            continue
                        margin, quarter = len(item) + len(item) // 2, len(item) // 4
                        hits, blank = seen.setdefault((doc, source), ([], []))
                        # on a stretch where the item was found, other windows, also by other passages, need no check of their own
                        if any(abs(begin - x) <= quarter for x in hits):
                            out[key] = max(out[key], (found, *out[key][1:]))
                            continue
                        # nor do those within a stretch with too short a common subsequence: any part of it has no longer one
                        lo, hi = begin - margin, begin + 2 * b.stride + margin
                        if any(x <= lo and hi <= y for x, y in blank):
                            continue
                        if _hopeless(words_here[max(0, lo - quarter) : max(0, hi + quarter)], item, counts_of[source]):
                            blank.append((lo - quarter, hi + quarter))
                        elif _verify(out, key, words_here[max(0, lo) : max(0, hi)], item, counts_of[source], found):
                            hits.append(begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], batch.schema.field(0).type), pa.array([k[1] for k in out], pa.int64()),
                 *(pa.array([v[c] for v in out.values()], pa.float64()) for c in range(3))],
                names=["id", "item", "cosine", "lcs", "answer"])

    def _hopeless(around, item, counts):
        # a common subsequence of any passage has no more words than item and surroundings share,
        # and is no longer than that of all the surroundings
        both = counts.keys() & set(around)
        return sum(map(counts.__getitem__, both)) < LIKELY * len(item) or lcs(item, around) < LIKELY * len(item)

    def _verify(out, key, around, item, counts, cosine):
        if _hopeless(around, item, counts):
            return False
        answer = item[-max(3, len(item) // 4):]
        # the passage with the best common subsequence, not longer than half as long again as the item
        span = max(len(item) + 8, len(item) * 3 // 2)
        best = (0, 0)
        for s in range(0, max(1, len(around) - span // 2), max(1, len(item) // 8)):
            part = around[s : s + span]
            found = lcs(item, part)
            if found > best[0]:
                best = (found, lcs(answer, part))
        same, told = best[0] / len(item), best[1] / len(answer)
        if same >= SURE or (same >= LIKELY and told >= ANSWER):
            out[key] = max(out.get(key, (0.0, 0.0, 0.0)), (cosine, same, told))
            return True
        return False

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs, answer), one row per document and benchmark item found in it.

    A null or empty text has no windows and a null, empty or wordless item matches nothing;
    rows with a null id are out.  Rows that repeat an id are texts of one document, rows that
    repeat an item id texts of one item: the best find counts.  Without documents or items
    the result is empty."""
    spark = docs.sparkSession
    src = common.columns(docs, id=id_col, text=text_col).filter("id is not null")
    kind = src.schema["id"].dataType.simpleString()
    all_items = common.columns(benchmark, item=item_col, text=item_text_col).filter("item is not null and text is not null").distinct()
    idf = inverse_document_frequencies(docs, text_col)
    cut = common.materialize(all_items.coalesce(CUT_TASKS).select(F.col("item").cast("long").alias("item"), "text").mapInArrow(
        _passages, "item long, whole string, first int, stride int, text string"), "leak-passages")
    sizes = sorted((r["stride"], r["count"]) for r in cut.groupBy("stride").count().collect())  # a few strides
    todo = [(stride, n, b) for stride, count in sizes for n in [1 + count // ITEM_BLOCK] for b in range(n)]
    found = None
    for at in range(0, len(todo), PASS_BLOCKS):
        items, blocks = {}, []
        for stride, n, b in todo[at : at + PASS_BLOCKS]:
            part = cut.filter((F.col("stride") == stride) & (F.pmod(F.xxhash64("item", "whole", "first"), F.lit(n)) == b))
            rows = sorted((r["item"], r["whole"], r["first"], r["text"]) for r in part.collect())  # about ITEM_BLOCK passages
            if rows:
                vocabulary = np.unique(np.concatenate([dims(tokens(t)) for *_, t in rows]))
                parts = [(items.setdefault((item, whole), len(items)), first, t) for item, whole, first, t in rows]
                blocks.append((stride, parts, vocabulary, latent_space(part, idf, vocabulary, len(rows))))
        if blocks:
            shared = spark.sparkContext.broadcast((idf, list(items), blocks))
            hits = src.mapInArrow(_search(shared), f"id {kind}, item long, cosine double, lcs double, answer double")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], f"id {kind}, item long, cosine double, lcs double, answer double")
    best = found.groupBy("id", "item").agg(F.max(F.struct("lcs", "answer", "cosine")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.cosine", "b.lcs", "b.answer")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no benchmark item was found.

    Every row is judged by its own text, whatever its id: a null id, or one that other rows repeat, decides nothing."""
    key = f"text_key_{id(docs)}"
    keyed = docs.withColumn(key, F.sha2(F.col(f"`{text_col}`"), 256))
    return keyed.join(leaks(keyed, benchmark, id_col=key, text_col=text_col).select(key).distinct(), key, "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])

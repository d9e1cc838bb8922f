"""Operator 8: document quality by a weak-label model.

1. Heuristic labellers vote on every document: reject (0), accept (1) or abstain (-1).  They
   overlap and err; none sees a label.
2. Expectation-maximisation over the counts of vote patterns estimates each labeller's
   vote probabilities given the unseen quality, and the share of good documents.  The
   counts cover all documents; there are at most 3**labellers patterns.
3. The posterior labels of a bounded sample train a hashed linear scorer (logistic
   regression on hashed word shapes and buckets of statistics), which then scores
   every whole text, in place, without a shuffle.

A document is kept if its score reaches 0.5.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from . import common

#: Bound on the labelled sample that the scorer is fitted on, and its hashed dimensions.
SAMPLE_ROWS, DIMENSIONS = 20_000, 1 << 12
#: Texts of the sample that a task turns into features at once.
SLICE_ROWS = 200
#: Words below which the labellers abstain, and characters from which those of characters vote whatever the words.
FEW, FEW_CHARS = 10, 50
#: Frequent short words of the languages served; their share tells prose from lists.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for on was with as be by are der die das und ist nicht ein eine zu den von mit auf "
    b"le la les de des et un une du en que qui dans pour est el los las y se con por su para al del lo".split())
#: Shapes: digits, upper-case and lower-case letters (all bytes over 127 count as lower case); the rest as it is.
_SHAPE = bytes(57 if 48 <= b <= 57 else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else b for b in range(256))


def statistics(text: str | None) -> tuple[dict[str, float], Counter]:
    """Statistics of a whole text, and how often each word shape occurs."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    shaped = raw.translate(_SHAPE)
    shapes = Counter(shaped.split())
    upper, lower = shaped.count(b"A"), shaped.count(b"a")
    dense = len(raw) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    symbols = dense - upper - lower - shaped.count(b"9")
    tailed = bars = 0
    for shape, k in shapes.items():
        if len(shape) > 2 and shape[-1] == shape[-2] and shape[-1] not in b"Aa9":
            tailed += k
        if len(shape) == 1 and shape not in b"Aa9":
            bars += k
    some = max(1, n)
    return {
        "n": n, "symbols": symbols / max(1, dense), "upper": upper / max(1, upper + lower),
        "doubled": sum(map(eq, words, words[1:])) / some, "tailed": tailed / some, "bars": bars / some,
        "distinct": len(set(words)) / some, "length": dense / some,
        "function": sum(map(FUNCTION_WORDS.__contains__, raw.lower().split())) / some,
        "dense": dense, "letters": upper + lower,
    }, shapes


#: Labellers: statistic, reject at or above, accept below (a statistic between the two abstains).
ABOVE = [("symbols", 0.14, 0.07), ("upper", 0.5, 0.2), ("doubled", 0.3, 0.05), ("tailed", 0.3, 0.05), ("bars", 0.15, 0.05), ("length", 25.0, 12.0)]
#: Labellers: statistic, reject below, accept at or above.
BELOW = [("function", 0.01, 0.1), ("distinct", 0.2, 0.4)]
LABELLERS = len(ABOVE) + len(BELOW)


#: What statistics of characters are taken over; the others need words.
CHARACTERS = {"symbols": "dense", "upper": "letters", "length": "dense"}


def votes(stats: dict[str, float]) -> list[int]:
    """A labeller abstains if its statistic has too little evidence: of words, or of characters."""
    known = lambda s: stats["n"] >= FEW or s in CHARACTERS and stats[CHARACTERS[s]] >= FEW_CHARS
    return ([-1 if not known(s) else 0 if stats[s] >= r else 1 if stats[s] < a else -1 for s, r, a in ABOVE]
            + [-1 if not known(s) else 0 if stats[s] < r else 1 if stats[s] >= a else -1 for s, r, a in BELOW])


def shape_parts(shape: bytes) -> tuple[int, int]:
    """Hashed features of a word shape: its first and last character, and its tail of symbols."""
    tail = shape.lstrip(b"Aa9")
    return tuple(xxh3_64_intdigest(part) % DIMENSIONS for part in (b"w" + shape[:1] + shape[-1:], b"t" + tail[-3:]))


_STEPS = {name: [xxh3_64_intdigest(f"{name}:{k}".encode()) % DIMENSIONS for k in range(21)]
          for name in ("n", "symbols", "upper", "doubled", "tailed", "bars", "distinct", "length", "function")}


def buckets(stats: dict[str, float]) -> list[int]:
    """Hashed features of the statistics: every step of a scale that a statistic has reached."""
    return [i for name, steps in _STEPS.items() for v in [stats[name]]
            for i in steps[: 1 + min(20, int(np.log2(v + 1)) if name in ("n", "length") else int(v * 20))]]


def features(stats: dict[str, float], shapes: Counter) -> tuple[list[int], list[float]]:
    """Hashed features: share of each part of a word shape, and the statistics' steps."""
    n, found = max(1, stats["n"]), Counter()
    for shape, k in shapes.items():
        for i in shape_parts(shape):
            found[i] += k / n
    for i in buckets(stats):
        found[i] += 1.0
    at = sorted(found)
    return at, [float(found[i]) for i in at]


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over the patterns: class shares, P(accept | class) as [labeller, class], and each pattern's posterior of good.

    Class 0 is good; junk comes in kinds that most labellers cannot see, so each labeller
    also stands for one kind of junk, which it tends to reject (pseudo-counts below).
    Given the class, votes are independent; an abstention says nothing."""
    labellers = patterns.shape[1]
    said_yes, said_no = (patterns == 1).astype(float), (patterns == 0).astype(float)
    rejects = said_no.sum(axis=1)
    belief = np.full((len(patterns), labellers + 1), 1e-3)
    belief[:, 0] = np.where(rejects == 0, 1.0, 0.05)
    belief[:, 1:] += said_no / np.maximum(1, rejects)[:, None]
    belief /= belief.sum(axis=1, keepdims=True)
    yes_prior, no_prior = np.full((labellers, labellers + 1), 1.0), np.full((labellers, labellers + 1), 1.0)
    yes_prior[:, 0] = 20.0
    no_prior[np.arange(labellers), np.arange(1, labellers + 1)] = 20.0
    for _ in range(rounds):
        weight = belief * counts[:, None]
        share = (weight.sum(axis=0) + 0.1) / (counts.sum() + 0.1 * (labellers + 1))
        yes, no = said_yes.T @ weight + yes_prior, said_no.T @ weight + no_prior
        accept = yes / (yes + no)
        logs = np.log(share) + said_yes @ np.log(accept) + said_no @ np.log(1 - accept)
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        done, belief = np.abs(new - belief).max() < 1e-9, new
        if done:
            break
    return share, accept, belief[:, 0]


def _vote_column(text):
    @F.pandas_udf("string")
    def cast(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ",".join(map(str, votes(statistics(t)[0]))))
    return cast(text)


def weak_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, dict[str, float]]:
    """Rows counted, and the posterior of good of each vote pattern that occurs."""
    src = common.columns(docs, id=id_col, text=text_col)
    found = src.groupBy(_vote_column(F.col("text")).alias("votes")).count().collect()  # at most 3**LABELLERS rows
    if not found:
        return 0, {}
    found = sorted(found, key=lambda r: r["votes"])
    patterns = np.array([[int(v) for v in r["votes"].split(",")] for r in found])
    good = fit_labellers(patterns, np.array([float(r["count"]) for r in found]))[2]
    return sum(r["count"] for r in found), {r["votes"]: float(g) for r, g in zip(found, good)}


class Scorer:
    """A hashed linear model: probability of good, from a whole text."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights.tolist(), bias, prior
        self.parts: dict[bytes, float] = {}

    def weight_of(self, shape: bytes) -> float:
        found = self.parts.get(shape)
        if found is None:
            if len(self.parts) >= 100_000:
                self.parts.clear()
            found = self.parts[shape] = sum(self.weights[i] for i in shape_parts(shape))
        return found

    def score(self, text: str | None) -> float:
        stats, shapes = statistics(text)
        if not stats["n"]:
            return self.prior
        total = self.bias + sum(k * self.weight_of(s) for s, k in shapes.items()) / stats["n"]
        total += sum(self.weights[i] for i in buckets(stats))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Fits the scorer on the posterior labels of about ``sample_rows`` rows, chosen by a hash of the id.

    A table whose posteriors are all on one side gives a constant scorer."""
    rows_in, posterior = weak_labels(docs, id_col, text_col)
    if not posterior:
        return Scorer(np.zeros(DIMENSIONS), 1.0, 1.0)
    prior = posterior.get(",".join(["-1"] * LABELLERS), 1.0)
    sample = common.hash_sample(common.columns(docs, id=id_col, text=text_col), "id", sample_rows, rows_in)

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for first in range(0, len(part), SLICE_ROWS):
                out = []
                for text in part["text"].iloc[first : first + SLICE_ROWS]:
                    stats, shapes = statistics(text)
                    good = posterior.get(",".join(map(str, votes(stats))), 0.5)
                    at, values = features(stats, shapes)
                    at, values = np.array(at, np.int32), np.array(values)
                    out += [(at, values, label, w) for label, w in ((1.0, good), (0.0, 1 - good)) if w > 0.001]
                yield pd.DataFrame(out, columns=["at", "vals", "label", "weight"])

    vector = F.udf(lambda at, values: SparseVector(DIMENSIONS, at, values), VectorUDT())
    train = common.materialize(sample.select("text").mapInPandas(rows, "at array<int>, vals array<double>, label double, weight double"), "quality-sample")
    classes = train.groupBy("label").agg(F.sum("weight").alias("w")).collect()
    mass = {r["label"]: r["w"] for r in classes}
    if min(mass.get(0.0, 0), mass.get(1.0, 0)) < 1:
        return Scorer(np.zeros(DIMENSIONS), 1.0 if mass.get(1.0, 0) >= mass.get(0.0, 0) else -1.0, prior)
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60, standardization=False).fit(
        train.select(vector("at", "vals").alias("features"), "label", "weight"))
    return Scorer(model.coefficients.toArray(), float(model.intercept), prior)


def score_column(scorer: Scorer, text):
    """The score of a text column, as a column of the same rows; the weights (32 kB) travel with the tasks."""
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(scorer.score).astype("float64")
    return score(text)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, keep), one row per input row.

    A null, empty or blank text has no votes and gets the posterior of that pattern; every
    other text is scored, however short.  Repeated rows stay repeated; an empty table gives none."""
    scorer = fit(docs, id_col, text_col)
    src = common.columns(docs, id=id_col, text=text_col)
    out = src.select(F.col("id").alias(id_col), score_column(scorer, F.col("text")).alias("score"))
    return out.withColumn("keep", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    score = score_column(fit(docs, text_col=text_col), F.col(f"`{text_col}`"))
    return docs.filter(score >= 0.5)

"""Operator 7: personal data by candidate generation and gradient boosting.

1. Generators propose spans of four kinds with high recall: everything that the kinds'
   patterns match, whether or not it passes the kind's check, and looser forms (addresses spelt
   out or without a top-level domain, telephone numbers without a plus, defanged IP
   addresses, card numbers with unusual marks).  Proposals may overlap.
2. Boosted trees score a proposal by its format and its context.  They learn from ``EXAMPLES``
   labelled texts of each kind and label (``pii_examples``), personal data in such forms and
   look-alikes.  Neither labels nor features hold a check's verdict, and no text of the corpus
   takes part: a text has the same spans whatever table it is in.
3. On held-out examples each kind's threshold is set to the lowest score that keeps the
   wanted precision.

Matches that pass their check (the base) are always spans; proposals at or above their
kind's threshold that touch no chosen span are added, best first.
"""
from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, pii_examples

KINDS = ("email", "ip", "card", "phone")
#: Labelled texts of each kind and label; every so many is held out; trees and their depth; wanted precision.
EXAMPLES, HELD, TREES, DEPTH, PRECISION = 600, 4, 25, 4, 0.99
#: The kinds' patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED = re.compile(r"[0-9][0-9.]*")
ADDRESS_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
BARE_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+")
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}")
DEFANGED = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])")
MARKED_CARD = re.compile(r"[0-9]{4}(?:(?:[./_]|\x20\x20)[0-9]{4}){3}(?![0-9])")
LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
CUES = {"email": re.compile(r"mail|contact|write"), "ip": re.compile(r"\b(?:ip|host|addr|server)"), "card": re.compile(r"card|visa|\bpay|credit"),
        "phone": re.compile(r"phone|\btel|\bcall|\bfax|mobile")}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passed): the patterns' leftmost non-overlapping matches and whether each passes its check."""
    at = text.find("@")
    while at >= 0:  # an address lies within a run of address characters
        lo, hi = at, at + 1
        while lo and text[lo - 1] in ADDRESS_CHARS:
            lo -= 1
        while hi < len(text) and text[hi] in ADDRESS_CHARS:
            hi += 1
        for m in EMAIL.finditer(text, lo, hi):
            yield "email", *m.span(), True
        at = text.find("@", hi)
    digits = False
    for m in DOTTED.finditer(text):
        digits = True
        if m.group().count(".") < 3:
            continue
        parts, start, k = m.group().split("."), m.start(), 0
        while k < len(parts):  # four neighbouring numbers, from the left
            four = parts[k : k + 4]
            step = 4 if len(four) == 4 and all(four) else 1
            if step == 4:
                yield "ip", start, start + len(".".join(four)), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            start += sum(len(p) + 1 for p in parts[k : k + step])
            k += step
    if not digits:
        return
    for m in CARD.finditer(text):
        number = m.group().replace(" ", "").replace("-", "")
        if len(number) >= 8:
            yield "card", *m.span(), 12 <= len(number) <= 19 and luhn(number)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield "phone", *m.span(), 9 <= sum(c.isdigit() for c in m.group()) <= 15


def looser(text: str) -> Iterator[tuple[str, int, int]]:
    """Proposals that no check can label."""
    if "@" in text:
        for m in re.finditer("@", text):
            lo = m.start()
            while lo and m.start() - lo < 64 and text[lo - 1] in ADDRESS_CHARS and text[lo - 1] != "@":
                lo -= 1
            if (found := BARE_ADDRESS.match(text, lo)):
                yield "email", *found.span()
    if " dot " in text or "dot)" in text or "dot]" in text:
        for m in re.finditer(r"\(at\)|\[at\]| at ", text):
            lo = m.start()
            while lo and m.start() - lo < 64 and text[lo - 1] in ADDRESS_CHARS:
                lo -= 1
            if (found := SPELT.match(text, lo)):
                yield "email", *found.span()
    for kind, pattern in (("phone", LOCAL_PHONE), ("ip", DEFANGED), ("card", MARKED_CARD)):
        for m in pattern.finditer(text):
            yield kind, *m.span()


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a proposal; nothing that a kind's check computes."""
    span, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 1]
    digits = sum("0" <= c <= "9" for c in span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    last = re.split(r"[^A-Za-z]+", span.rstrip(")]"))[-1]
    edge = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalnum() else 3.0
    return [float(x) for x in (
        *(float(kind == k) for k in KINDS), min(len(span), 99), min(digits, 40), len(span) - digits - sum(c.isalpha() for c in span),
        min(len(groups), 20), min(max(groups, default=0), 99), min(min(groups, default=0), 99), float(span[:1] == "+"), float("(" in span), float("[" in span),
        float("@" in span), span.count("."), span.count("-"), span.count(" "), edge(before[-1:]), edge(after),
        float(last.islower()), min(len(last), 30), float(last in pii_examples.TOPS), float(bool(CUES[kind].search(before))),
        float(any(c in before for c in pii_examples.THINGS)),
    )]


def tree_of(node) -> tuple:
    """A trained tree as nested tuples: (feature, threshold, left, right) or (value,)."""
    if node.subtreeDepth() == 0:
        return (float(node.prediction()),)
    return int(node.split().featureIndex()), float(node.split().threshold()), tree_of(node.leftChild()), tree_of(node.rightChild())


class Detector:
    """Trees, their weights and each kind's threshold; plain data that travels with the tasks."""

    def __init__(self, trees: list[tuple], weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, x: list[float]) -> float:
        margin = 0.0
        for tree, weight in zip(self.trees, self.weights):
            while len(tree) > 1:
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            margin += weight * tree[0]
        return 1 / (1 + math.exp(-2 * margin))

    def spans(self, text: str | None) -> list[tuple[str, int, int, bool]]:
        """(kind, start, end, base) by start, then kind as listed."""
        if not text:
            return []
        found = list(matches(text))
        chosen = [(k, s, e, True) for k, s, e, passed in found if passed]
        rest = {p for p in {(k, s, e) for k, s, e, passed in found if not passed} | set(looser(text)) if self.thresholds.get(p[0], 2.0) <= 1}
        scored = sorted(((self.score(features(text, *p)), p) for p in rest), key=lambda x: (-x[0], x[1]))
        begins, ends = _union(chosen)  # what is taken, as separate stretches in order
        for score, (k, s, e) in scored:
            at = bisect.bisect_right(begins, s)
            if score >= self.thresholds[k] and (at == 0 or ends[at - 1] <= s) and (at == len(begins) or e <= begins[at]):
                chosen.append((k, s, e, False))
                begins.insert(at, s), ends.insert(at, e)
        return sorted(chosen, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _union(spans: list[tuple]) -> tuple[list[int], list[int]]:
    begins, ends = [], []
    for s, e in sorted((s, e) for _, s, e, _ in spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s), ends.append(e)
    return begins, ends


def proposals(rows: list[tuple]) -> list[tuple[str, float, bool, list[float]]]:
    """(kind, label, held out, features) of every proposal in the labelled texts that is not base: personal if it
    is of the text's kind, covers most of what is marked there and the text is marked as personal."""
    out = []
    for n, (text, kind, start, end, personal) in enumerate(rows):
        found = {(k, s, e) for k, s, e, passed in matches(text) if not passed} | set(looser(text))
        for k, s, e in sorted(found):
            shared = min(e, end) - max(s, start)
            out.append((k, float(personal and k == kind and 5 * shared >= 4 * (max(e, end) - min(s, start))), n % HELD == 0, features(text, k, s, e)))
    return out


@functools.lru_cache(maxsize=4)
def fit(spark: SparkSession, each: int = EXAMPLES) -> Detector:
    """Boosted trees and thresholds from ``each`` labelled texts of each kind and label; always the same."""
    rows = proposals(pii_examples.examples(KINDS, each))
    train = spark.createDataFrame([(x, y) for _, y, held, x in rows if not held], "x array<double>, label double").coalesce(1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(train.select(array_to_vector("x").alias("features"), "label"))
    detector = Detector([tree_of(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), {})
    for kind in KINDS:
        good, total, best = 0.0, 0, 2.0
        scored = sorted(((detector.score(x), y) for k, y, held, x in rows if held and k == kind), reverse=True)
        for at, (score, label) in enumerate(scored):
            good, total = good + label, total + 1
            if good / total >= PRECISION and (at + 1 == len(scored) or scored[at + 1][0] < score):
                best = score
        detector.thresholds[kind] = best
    return detector


def span_column(detector: Detector, text: Column) -> Column:
    """The spans of a text column; offsets count code points, the end is exclusive."""
    @F.pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "start", "end", "base"), s)) for s in detector.spans(t)])
    return spans(text)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans), one row per input row; a null or empty text has no spans."""
    detector = fit(docs.sparkSession)
    src = common.columns(docs, id=id_col, text=text_col)
    return src.select(F.col("id").alias(id_col), span_column(detector, F.col("text")).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: base matches by kind, the digest of the base spans, and all spans as text."""
    found = detect(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one."""
    detector = fit(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if not text:
                return text
            out, end = [], 0
            for kind, s, e, _ in detector.spans(text):
                if s >= end:
                    out += [text[end:s], f"[{kind.upper()}]"]
                end = max(end, e)
            return "".join([*out, text[end:]])
        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))

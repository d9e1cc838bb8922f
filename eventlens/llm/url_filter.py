"""Operator 3: URL verdicts by rules, else by the ratio of two character language models.

Two smoothed variable-order Markov models, one of the URLs that the rules allow and
one of those that they block, give each character given up to four before it:
P_k(c) = (n(context c) + LAMBDA * P_{k-1}(c)) / (n(context) + LAMBDA), from order 0 up.  The
score of a URL is the mean over its characters of log P_allowed - log P_blocked; the
threshold is the score that separates the classes best on a held-out fifth of the
distinct URLs.

Everything is DataFrame expressions.  Counts run over all pages, through the distinct
URLs with their multiplicity; model tables are joined, never collected.  The driver
sees two totals and one histogram of fixed width.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Verdict, host, path of each rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER, LAMBDA = 4, 2.0
#: Score histogram: half width and steps per unit.
REACH, STEPS = 8, 50
START, END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower-case A-Z and path; both empty where the URL is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of each URL (and its end): the character after its four predecessors."""
    chars = F.concat(F.array(*[F.lit(START)] * ORDER), F.filter(F.split("url", ""), lambda c: c != ""), F.array(F.lit(END)))
    gram = F.transform(F.sequence(F.lit(1), F.size("chars") - ORDER),
                       lambda i: F.concat(*[F.element_at("chars", (i + k).cast("int")) for k in range(ORDER + 1)]))
    return urls.withColumn("chars", chars).select("key", "weight", "seen", F.explode(gram).alias("gram"))


def _model(counts: DataFrame) -> DataFrame:
    """(gram, allow, block) counts -> (gram, ratio): log P_allowed - log P_blocked of the last character."""
    totals = counts.agg(F.sum("allow"), F.sum("block"), F.countDistinct(F.substr("gram", F.lit(ORDER + 1)))).first()
    letters = float(totals[2] or 1)
    below = None
    for k in range(ORDER + 1):
        suffix = F.substr("gram", F.lit(ORDER + 1 - k))
        now = counts.groupBy(suffix.alias("s")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        if k == 0:
            p = {c: (F.col(c) + LAMBDA / letters) / (F.lit(float(n or 0)) + LAMBDA) for c, n in zip(("allow", "block"), totals)}
            below = now.select("s", *[p[c].alias(f"p_{c}") for c in p])
            continue
        context = F.substr("s", F.lit(1), F.lit(k))
        sums = now.groupBy(context.alias("context")).agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"))
        joined = (now.withColumn("context", context).withColumn("shorter", F.substr("s", F.lit(2))).join(sums, "context")
                  .join(below.withColumnRenamed("s", "shorter"), "shorter"))
        below = joined.select("s", *[((F.col(c) + LAMBDA * F.col(f"p_{c}")) / (F.col(f"n_{c}") + LAMBDA)).alias(f"p_{c}") for c in ("allow", "block")])
    return below.select(F.col("s").alias("gram"), (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """The score that separates the held-out URLs of both classes best (largest true minus false
    share of allowed; ties: nearest to 0); 0 where a class is missing."""
    slot = F.greatest(F.lit(-REACH * STEPS), F.least(F.lit(REACH * STEPS), F.floor(F.col("score") * STEPS)))
    rows = (scored.filter("held and seen is not null").groupBy(slot.cast("int").alias("slot"))
            .agg(F.sum(F.when(F.col("seen") == "allow", F.col("weight")).otherwise(0)).alias("a"),
                 F.sum(F.when(F.col("seen") == "block", F.col("weight")).otherwise(0)).alias("b")).collect())
    good, bad = sum(r.a for r in rows), sum(r.b for r in rows)
    if not good or not bad:
        return 0.0
    cuts = [(sum(r.a for r in rows if r.slot >= s) / good - sum(r.b for r in rows if r.slot >= s) / bad, -abs(s), s)
            for s in range(-REACH * STEPS, REACH * STEPS + 1)]
    return max(cuts)[2] / STEPS


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score), one row per input row.

    ``rule`` is null where none fits; then the verdict is ``allow`` if the score reaches the
    threshold, else ``block``.  A null or empty URL has host and path empty and the score
    of an empty text.  Repeated rows stay repeated; without labelled URLs of both
    classes the threshold is 0."""
    src = common.columns(pages, id=id_col, url=url_col)
    key = F.md5(F.coalesce("url", F.lit("")))
    host, path = host_and_path(F.col("url"))
    urls = src.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.count("*").alias("weight"))
    urls = common.materialize(urls.withColumn("key", key).withColumn("seen", rule_of(host, path, rules)[1])
                              .withColumn("held", F.pmod(F.xxhash64("url"), F.lit(5)) == 0), "url-distinct")
    grams = _grams(urls.withColumn("seen", F.when(~F.col("held"), F.col("seen"))))
    counts = common.materialize(grams.groupBy("gram").agg(*[
        F.sum(F.when(F.col("seen") == c, F.col("weight")).otherwise(0)).alias(c) for c in ("allow", "block")]), "url-counts")
    scores = (grams.select("key", "gram").join(_model(counts), "gram").groupBy("key")
              .agg(F.round(F.avg("ratio"), 6).alias("score")))
    scored = common.materialize(urls.join(scores, "key"), "url-scores")
    cut = _threshold(scored)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (src.withColumn("key", key).join(scored.select("key", "score"), "key", "left")
            .withColumn("host", host).withColumn("path", path)
            .select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score"))

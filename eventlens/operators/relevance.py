"""Keyword relevance classifier (B-10) and the category gate (B-11).

The lexicon is a parameter.  Its lists become literal OR-chains of
``contains`` over the normalised title/body, i.e. a single projection with
no UDF and no join; the work per row is linear in the lexicon size.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.text import arabic_normalize_v1, normalize_text


def _py_norm_ar(s: str) -> str:
    """The v1 Arabic normaliser applied to a keyword literal (driver-side, lexicon only)."""
    s = re.sub("[\u064B-\u065F\u0670]", "", s)
    s = re.sub("[أإآ]", "ا", s)
    return s.replace("ة", "ه").replace("ى", "ي")


@dataclass(frozen=True)
class Lexicon:
    definitive: list[str] = field(default_factory=lambda: list(fx.TIER_A_DEFINITIVE))
    strong: list[str] = field(default_factory=lambda: list(fx.TIER_A_STRONG))
    exclusion: list[str] = field(default_factory=lambda: list(fx.EXCLUSION_KEYWORDS))
    context: list[str] = field(default_factory=lambda: list(fx.TIER_B_CONTEXT))
    title_weight: int = fx.TITLE_WEIGHT
    body_weight: int = fx.BODY_WEIGHT
    min_score: int = fx.MIN_CONTEXT_SCORE


def _variants(kw: str, raw_too: bool) -> list[str]:
    low = kw.lower()
    out = [_py_norm_ar(low)]
    if raw_too and low not in out:
        out.append(low)
    return out


def _any(col: Column, needles: list[str]) -> Column:
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [col.contains(F.lit(n)) for n in needles])


def zones(headline, description, parity: bool = False) -> tuple[Column, Column, Column]:
    """(title, body, full) text zones, Arabic normalised like the keywords (Q-11).
    ``parity=True`` leaves the text's Arabic as it is, as the reference does."""
    h = F.col(headline) if isinstance(headline, str) else headline
    d = F.col(description) if isinstance(description, str) else description
    title, body = normalize_text(h), normalize_text(d)
    if not parity:
        title, body = arabic_normalize_v1(title), arabic_normalize_v1(body)
    return title, body, F.concat(title, F.lit(" "), body)


def _parts(title: Column, body: Column, lex: Lexicon, parity: bool) -> dict[str, Column]:
    full = F.concat(title, F.lit(" "), body)
    a_any = [v for kw in lex.definitive + lex.strong for v in _variants(kw, True)]
    a_def = [v for kw in lex.definitive for v in _variants(kw, True)]
    # exclusions are spelt as the text is: raw in parity mode, normalised where the text is
    excl = [kw.lower() if parity else _py_norm_ar(kw.lower()) for kw in lex.exclusion]
    ctx = [_py_norm_ar(kw.lower()) for kw in lex.context]
    score = reduce(lambda a, b: a + b, [
        F.when(title.contains(F.lit(k)), F.lit(lex.title_weight))
        .when(body.contains(F.lit(k)), F.lit(lex.body_weight)).otherwise(F.lit(0))
        for k in ctx], F.lit(0))
    ctx_hits = reduce(lambda a, b: a + b,
                      [F.when(full.contains(F.lit(k)), 1).otherwise(0) for k in ctx], F.lit(0))
    p = {
        "local_tier_a": _any(full, a_any),
        "local_context_hits": ctx_hits,
        "has_exclusion": _any(title, excl),
        "tier_a_title": _any(title, a_def),
        "tier_a_body": _any(body, a_def),
        "context_score": score,
    }
    p["rel_local"] = p["local_tier_a"] | (p["local_context_hits"] >= 1)
    p["rel_international"] = (
        F.when(p["tier_a_title"], True)
        .when(p["tier_a_body"] & ~p["has_exclusion"], True)
        .when(p["has_exclusion"], False)
        .otherwise(p["context_score"] >= lex.min_score))
    return p


def relevance_struct(headline="headline", description="description", lex: Lexicon = Lexicon(),
                     parity: bool = False) -> Column:
    """All relevance parts as one struct.  The normalised zones are bound once as a lambda
    variable (``transform`` over a one-element array), so each text is normalised once
    however many keyword tests read it — common-subexpression elimination does not reach
    into the conditional branches of the rule."""
    title, body, _ = zones(headline, description, parity)
    z = F.array(F.struct(title.alias("t"), body.alias("b")))
    return F.element_at(F.transform(z, lambda r: F.struct(*[
        c.alias(k) for k, c in _parts(r["t"], r["b"], lex, parity).items()])), 1)


def relevance_parts(headline="headline", description="description", lex: Lexicon = Lexicon(),
                    parity: bool = False) -> dict[str, Column]:
    st = relevance_struct(headline, description, lex, parity)
    return {k: st[k] for k in ("local_tier_a", "local_context_hits", "has_exclusion", "tier_a_title",
                               "tier_a_body", "context_score", "rel_local", "rel_international")}


def is_relevant(source_type: Column | str, headline="headline", description="description",
                lex: Lexicon = Lexicon(), parity: bool = False) -> Column:
    """B-10 as one boolean expression; ``source_type`` is 'local' or 'international'."""
    st = F.col(source_type) if isinstance(source_type, str) and source_type not in ("local", "international") \
        else (F.lit(source_type) if isinstance(source_type, str) else source_type)
    r = relevance_struct(headline, description, lex, parity)
    return F.when(st == "local", r["rel_local"]).otherwise(r["rel_international"])


def relevance_gate(articles: DataFrame, lex: Lexicon = Lexicon(), filter_local: bool = False,
                   parity: bool = False) -> DataFrame:
    """B-11: local rows pass unless ``filter_local``; international rows must pass B-10."""
    rel = is_relevant(F.col("category"), "headline", "description", lex, parity)
    keep = rel if filter_local else ((F.col("category") == "local") | rel)
    return articles.filter(keep)

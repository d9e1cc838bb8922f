"""Entities (I-1 … I-3, B-14, E-22, E-23, G-8, D-J5).

The hosted extraction model is not part of the engine.  Two ways in:

(a) ``parse_responses``: stored raw model responses → the eight entity lists
    and a topic, with the reference's validation rules, through Spark's
    VARIANT type (``try_parse_json`` / ``try_variant_get``), JVM-side.
(b) ``gazetteer_entities``: a dictionary extractor.  Text is cut into word
    n-grams (n up to the longest term) and *equi-joined* with a term table
    (term, kind), so the work is linear in text size and the term table can
    be large; no containment theta join.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import ENTITY_CATEGORY_KEY, ENTITY_LIST_KEYS
from ..functions.text import WS, clean_model_response, normalize_text



def _empty() -> Column:
    return F.array().cast("array<string>")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_responses(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """E-22 + E-23: adds the 8 list columns, ``category`` and ``valid``.

    Invalid JSON, a non-object, or a missing key → the empty structure (all lists
    empty, category ''); a non-list value → []; a non-string category → ''."""
    v = F.try_parse_json(clean_model_response(raw_col))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    keys = ENTITY_LIST_KEYS + [ENTITY_CATEGORY_KEY]
    has_all = is_obj
    for k in keys:
        has_all = has_all & F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    cols = {"valid": has_all}
    for k in ENTITY_LIST_KEYS:
        item = F.try_variant_get(v, f"$.{k}", "variant")
        is_list = F.coalesce(F.schema_of_variant(item).startswith("ARRAY"), F.lit(False))
        lst = F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), _empty())
        cols[k] = F.when(has_all & is_list, lst).otherwise(_empty())
    cat = F.try_variant_get(v, f"$.{ENTITY_CATEGORY_KEY}", "variant")
    is_str = F.coalesce(F.schema_of_variant(cat) == "STRING", F.lit(False))
    cols[ENTITY_CATEGORY_KEY] = F.when(has_all & is_str, F.try_variant_get(v, f"$.{ENTITY_CATEGORY_KEY}", "string")) \
        .otherwise(F.lit(""))
    return df.withColumns(cols)


def store_entities(rows: DataFrame, order_col: str = "id") -> DataFrame:
    """I-2 (Q-5): one entity row per article — the first by ``order_col`` — with
    empty lists for missing values (B-14)."""
    w = Window.partitionBy("article_id").orderBy(order_col)
    first = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first.withColumns({k: F.coalesce(F.col(k), _empty()) for k in ENTITY_LIST_KEYS if k in rows.columns})


def article_with_entities(articles: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """I-3 / D-J5: article + source + its first entity row as a nested struct (null when none)."""
    ent = store_entities(entities)
    kinds = [k for k in ENTITY_LIST_KEYS if k in ent.columns]
    e = ent.select("article_id", F.struct(*kinds, F.col("category").alias("nlp_category")).alias("entities"))
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"),
                       F.col("url").alias("source_url"))
    return articles.join(s, "source_id", "left").join(e, articles.id == e.article_id, "left").drop("article_id")


def spaced_words(text: Column) -> Column:
    """Normalised text with every white-space run collapsed to one space, trimmed."""
    return F.trim(F.regexp_replace(normalize_text(text), f"[{WS}]+", " "))


def ngrams(spaced: Column, max_n: int) -> Column:
    """Distinct word n-grams (1 … max_n) of a ``spaced_words`` column.

    n ≥ 2 grams come from one regex pass each: the match consumes one word and a
    lookahead group captures it with the next n-1 words, so every word start yields
    its n-gram (JVM regex, linear in the text, no per-element lambdas)."""
    grams = [F.filter(F.split(spaced, " "), lambda w: w != "")]
    for n in range(2, max_n + 1):
        grams.append(F.regexp_extract_all(spaced, F.lit(f"(?=((?:[^ ]+ ){{{n - 1}}}[^ ]+))[^ ]+"), F.lit(1)))
    return F.array_distinct(F.flatten(F.array(*grams)))


#: Terms of a lexicon, and characters of a term, that are matched by one pattern; other lexicons meet the n-grams in a join.
TRIE_TERMS, TRIE_CHARS = 20_000, 200


def trie_pattern(terms: list[str]) -> str:
    """A pattern whose first group is the longest term that starts at a word and ends with one.

    The terms form a trie, so a word that begins no term fails at its first differing character."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def part(node: dict) -> str:
        ways = [re.escape(c) + part(child) for c, child in sorted(node.items()) if c]
        if "" in node:
            ways.append("(?![^ ])")  # tried last: the longest term wins
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return f"(?<![^ ])(?=({part(root)}))[^ ]+"


def term_hits(tok: DataFrame, lex: DataFrame) -> DataFrame:
    """(_doc, lexicon columns), one row per document and lexicon row whose term it holds; ``tok`` is (_doc, _w)."""
    terms = [r.term for r in lex.select("term").filter("term <> ''").distinct().limit(TRIE_TERMS + 1).collect()]
    if not terms:
        return tok.select("_doc").filter("false").crossJoin(lex)
    if len(terms) > TRIE_TERMS or max(map(len, terms)) > TRIE_CHARS:
        max_n = lex.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
        return tok.select("_doc", F.explode(ngrams(F.col("_w"), max_n)).alias("term")).join(lex, "term")
    found = tok.select("_doc", F.explode(F.array_distinct(F.regexp_extract_all("_w", F.lit(trie_pattern(terms)), F.lit(1)))).alias("found"))
    # the longest term at a word stands for the shorter ones that begin it
    known = set(terms)
    begins = [(t, " ".join(w[:k])) for t in terms for w in [t.split(" ")] for k in range(1, len(w) + 1) if " ".join(w[:k]) in known]
    implied = tok.sparkSession.createDataFrame(begins, "found string, term string")
    return found.join(implied, "found").select("_doc", "term").distinct().join(lex, "term")


def gazetteer_entities(docs: DataFrame, gazetteer: DataFrame, topics: DataFrame | None = None,
                       text_col: str = "text", id_col: str = "id",
                       kinds: list[str] = ENTITY_LIST_KEYS) -> DataFrame:
    """I-1 (b): per document the 8 sorted entity lists and a topic.

    ``gazetteer``: (term, kind) with normalised terms; ``topics``: (term, topic, rank) —
    the topic with most distinct keyword hits wins, lower rank breaks ties."""
    lex = gazetteer.select("term", "kind", F.lit(None).cast("string").alias("topic"),
                           F.lit(None).cast("int").alias("rank"))
    if topics is not None:
        lex = lex.unionByName(topics.select("term", F.lit(None).cast("string").alias("kind"),
                                            "topic", F.col("rank").cast("int")))
    tok = docs.select(F.col(id_col).alias("_doc"), spaced_words(F.col(text_col)).alias("_w"))
    # one pass over the texts, a single aggregation per document (entity lists + topic hits)
    hits = term_hits(tok, lex)
    agg = hits.groupBy("_doc").agg(
        *[F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("kind") == k, F.col("term"))))).alias(k)
          for k in kinds],
        F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("topic", "rank"))).alias("_th"))
    th = F.col("_th")
    scored = F.transform(F.array_distinct(th), lambda t: F.struct(
        F.size(F.filter(th, lambda x: x["topic"] == t["topic"])).alias("score"),
        (-t["rank"]).alias("nr"), t["topic"].alias("topic")))
    best = F.when(F.size(th) > 0, F.array_max(scored)["topic"])
    out = docs.select(F.col(id_col).alias("_doc")).join(agg, "_doc", "left")
    out = out.select("_doc", *[F.coalesce(F.col(k), _empty()).alias(k) for k in kinds],
                     (best if topics is not None else F.lit(None).cast("string")).alias("category"))
    return out.withColumnRenamed("_doc", id_col)

"""Driver-bound queries: text normalisers, content hash, dedup, HTML, relevance."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup
from ..operators.relevance import Lexicon, _py_norm_ar, _variants, is_relevant, relevance_gate, relevance_parts
from ..sources.tables import DriverTables
from . import sqlgen as S
from .registry import query


@query("text_normalize", f"select doc_id, {S.normalize_text('text')} as text_norm from documents")
def text_normalize(spark, sf_dir):
    d = DriverTables(spark, sf_dir).raw("documents")
    return d.select("doc_id", T.normalize_text("text").alias("text_norm"))


@query("arabic_normalize_v1", f"select doc_id, {S.norm_v1('text')} as text_norm from documents")
def arabic_normalize_v1(spark, sf_dir):
    d = DriverTables(spark, sf_dir).raw("documents")
    return d.select("doc_id", T.arabic_normalize_v1("text").alias("text_norm"))


@query("arabic_normalize_v2", f"select doc_id, {S.norm_v2('text')} as text_norm from documents")
def arabic_normalize_v2(spark, sf_dir):
    d = DriverTables(spark, sf_dir).raw("documents")
    return d.select("doc_id", T.arabic_normalize_v2("text").alias("text_norm"))


@query("content_hash", f"select id, {S.content_hash('headline', 'description')} as content_hash from v_articles")
def content_hash(spark, sf_dir):
    return dedup.with_content_hash(DriverTables(spark, sf_dir).articles).select("id", "content_hash")


_HASHED = f"hashed AS (select id, {S.content_hash('headline', 'description')} as h from v_articles)"


@query("dedup_articles", f"""
WITH {_HASHED}
select id, h as content_hash from hashed where id in (select min(id) from hashed group by h)
""")
def dedup_articles(spark, sf_dir):
    return dedup.dedup_batch(DriverTables(spark, sf_dir).articles).select("id", "content_hash")


@query("mark_duplicates", f"""
WITH {_HASHED}, k AS (select h, min(id) as keep_id from hashed group by h)
select hashed.id,
  case when hashed.id <> k.keep_id then 'DUPLICATE_OF_' || k.keep_id else hashed.h end as content_hash,
  hashed.id <> k.keep_id as is_duplicate
from hashed join k on k.h = hashed.h
""")
def mark_duplicates(spark, sf_dir):
    return dedup.mark_duplicates(DriverTables(spark, sf_dir).articles)


@query("mark_duplicates_report", f"""
WITH {_HASHED}, k AS (select h, min(id) as keep_id from hashed group by h)
select count(*) filter (where hashed.id = k.keep_id) as updated,
       count(*) filter (where hashed.id <> k.keep_id) as duplicates,
       0::BIGINT as remaining
from hashed join k on k.h = hashed.h
""")
def mark_duplicates_report(spark, sf_dir):
    return dedup.mark_duplicates_report(dedup.mark_duplicates(DriverTables(spark, sf_dir).articles))


@query("html_to_text", f"select page_id, {S.html_to_text('html')} as text from pages")
def html_to_text(spark, sf_dir):
    p = DriverTables(spark, sf_dir).raw("pages")
    return p.select("page_id", T.html_to_text("html").alias("text"))


@query("image_url", f"select page_id, {S.image_url_from_html('html')} as image_url from pages")
def image_url(spark, sf_dir):
    p = DriverTables(spark, sf_dir).raw("pages")
    return p.select("page_id", T.image_url(F.lit(None), F.lit(None), F.col("html")).alias("image_url"))


# Test lexicon: the driver's prose is not Arabic, so the tiers are bound to
# words that occur in it.  The production lexicon is the default Lexicon().
TEST_LEXICON = Lexicon(
    definitive=["attion", "thanedble", "Sudan"],
    strong=["anea"],
    exclusion=["que", "und"],
    context=["ther", "thre", "thor", "ble", "wh"],
)


def _sql_parts(lex: Lexicon, parity: bool = False) -> str:
    title, body = S.normalize_text("headline"), S.normalize_text("description")
    if not parity:
        title, body = S.norm_v1(title), S.norm_v1(body)
    a_any = [v for kw in lex.definitive + lex.strong for v in _variants(kw, True)]
    a_def = [v for kw in lex.definitive for v in _variants(kw, True)]
    excl = [kw.lower() if parity else _py_norm_ar(kw.lower()) for kw in lex.exclusion]
    ctx = [_py_norm_ar(kw.lower()) for kw in lex.context]
    score = " + ".join(
        f"(case when contains(title, {S.lit(k)}) then {lex.title_weight} "
        f"when contains(body, {S.lit(k)}) then {lex.body_weight} else 0 end)" for k in ctx)
    hits = " + ".join(f"(case when contains(title || ' ' || body, {S.lit(k)}) then 1 else 0 end)" for k in ctx)
    return f"""
z AS (select id, category, {title} as title, {body} as body from v_articles),
parts AS (
  select id, category,
    {S.any_contains("title || ' ' || body", a_any)} as local_tier_a,
    ({hits}) as local_context_hits,
    {S.any_contains('title', excl)} as has_exclusion,
    {S.any_contains('title', a_def)} as tier_a_title,
    {S.any_contains('body', a_def)} as tier_a_body,
    ({score}) as context_score
  from z),
rel AS (
  select *, (local_tier_a or local_context_hits >= 1) as rel_local,
    case when tier_a_title then true when tier_a_body and not has_exclusion then true
         when has_exclusion then false else context_score >= {lex.min_score} end as rel_intl
  from parts)
"""


@query("relevance_local", "WITH " + _sql_parts(TEST_LEXICON) + " select id, rel_local as is_relevant from rel")
def relevance_local(spark, sf_dir):
    a = DriverTables(spark, sf_dir).articles
    return a.select("id", is_relevant("local", lex=TEST_LEXICON).alias("is_relevant"))


@query("relevance_international",
       "WITH " + _sql_parts(TEST_LEXICON) + " select id, rel_intl as is_relevant from rel")
def relevance_international(spark, sf_dir):
    a = DriverTables(spark, sf_dir).articles
    return a.select("id", is_relevant("international", lex=TEST_LEXICON).alias("is_relevant"))


@query("relevance_raw_text", "WITH " + _sql_parts(TEST_LEXICON, parity=True) + " select id, rel_local, rel_intl from rel")
def relevance_raw_text(spark, sf_dir):
    """B-10 in the mode that leaves the text's Arabic as it is (Q-11)."""
    p = relevance_parts(lex=TEST_LEXICON, parity=True)
    return DriverTables(spark, sf_dir).articles.select(
        "id", p["rel_local"].alias("rel_local"), p["rel_international"].alias("rel_intl"))


@query("relevance_score", "WITH " + _sql_parts(TEST_LEXICON) + """
select id, context_score, has_exclusion, tier_a_title, tier_a_body from rel""")
def relevance_score(spark, sf_dir):
    a = DriverTables(spark, sf_dir).articles
    p = relevance_parts(lex=TEST_LEXICON)
    return a.select("id", *[p[k].alias(k) for k in
                            ("context_score", "has_exclusion", "tier_a_title", "tier_a_body")])


@query("relevance_gate", "WITH " + _sql_parts(TEST_LEXICON) + """
select id, category from rel where category = 'local' or rel_intl""")
def relevance_gate_q(spark, sf_dir):
    a = DriverTables(spark, sf_dir).articles
    return relevance_gate(a, TEST_LEXICON).select("id", "category")

"""SQL surface: the SQL-expressible scalar functions as temporary SQL functions
(``CREATE TEMPORARY FUNCTION … RETURN expr``), so they can be called from
``spark.sql``.  Bodies are built from the same constants as the Column API."""
from __future__ import annotations

from pyspark.sql import SparkSession

from .. import fixed_values as fx
from . import text as T


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(m: dict) -> str:
    return "map(" + ", ".join(f"{_lit(k)}, {_lit(v)}" for k, v in m.items()) + ")"


def definitions() -> dict[str, str]:
    strip = f"btrim(x, {_lit(T.WS_CHARS)})"
    norm1 = f"translate(regexp_replace(coalesce(x, ''), {_lit(T.MARKS_V1_RE)}, ''), 'أإآةى', 'اااهي')"
    norm2 = f"translate(regexp_replace(coalesce(x, ''), {_lit(T.MARKS_V2_RE)}, ''), 'إأآةى', 'اااهي')"
    return {
        "el_strip": f"(x STRING) RETURNS STRING RETURN {strip}",
        "el_arabic_normalize": f"(x STRING) RETURNS STRING RETURN {norm1}",
        "el_arabic_normalize_v2": f"(x STRING) RETURNS STRING RETURN {norm2}",
        "el_normalize_text": f"(x STRING) RETURNS STRING RETURN lower(regexp_replace(coalesce(x, ''), "
                             f"{_lit(T.PUNCT_RE)}, ''))",
        "el_content_hash": "(h STRING, d STRING) RETURNS STRING RETURN sha2(concat("
                           "lower(el_strip(el_arabic_normalize(h))), '|', "
                           "lower(el_strip(el_arabic_normalize(d)))), 256)",
        "el_bias_side": "(b STRING) RETURNS STRING RETURN CASE WHEN b IS NULL OR b = '' THEN NULL "
                        "WHEN lower(b) LIKE '%pro%' THEN 'pro' WHEN lower(b) LIKE '%oppose%' THEN 'oppose' "
                        "ELSE 'neutral' END",
        "el_bias_label": f"(b STRING) RETURNS STRING RETURN coalesce(try_element_at({_map(fx.BIAS_LABELS)}, b), "
                         f"{_lit(fx.BIAS_LABEL_UNKNOWN)})",
        "el_blindspot_caption": f"(t STRING) RETURNS STRING RETURN try_element_at({_map(fx.BLINDSPOT_CAPTIONS)}, t)",
        "el_topic": f"(k STRING) RETURNS STRING RETURN coalesce(try_element_at({_map(fx.TOPIC_MAP)}, k), k)",
        "el_truncate": "(x STRING, n INT) RETURNS STRING RETURN substring(x, 1, n)",
        "el_bias_css": f"(b STRING) RETURNS STRING RETURN coalesce(try_element_at({_map(fx.BIAS_CSS)}, b), 'unknown')",
        "el_language_label": f"(c STRING) RETURNS STRING RETURN CASE WHEN c = 'ar' THEN {_lit(fx.LANGUAGE_AR_LABEL)} ELSE c END",
        "el_local_label": f"(c STRING) RETURNS STRING RETURN CASE WHEN c = 'local' THEN {_lit(fx.LABEL_LOCAL)} ELSE {_lit(fx.LABEL_INTERNATIONAL)} END",
        "el_page_numbers": "(page BIGINT, total BIGINT, per_page BIGINT) RETURNS ARRAY<BIGINT> RETURN "
                           "CASE WHEN least((total + per_page - 1) div per_page, page + 2) >= greatest(1, page - 2) "
                           "THEN sequence(greatest(1, page - 2), least((total + per_page - 1) div per_page, page + 2)) ELSE CAST(array() AS ARRAY<BIGINT>) END",
        # functions that return tables
        "el_feed_items": "(feed STRING) RETURNS TABLE(item_no INT, title STRING, description STRING, link STRING, pub_date STRING) RETURN "
                         "SELECT i.item_no, i.x.title, i.x.description, i.x.link, i.x.pubDate FROM (SELECT item_no, from_xml(item, "
                         "'title STRING, description STRING, link STRING, pubDate STRING') AS x FROM (SELECT posexplode(regexp_extract_all("
                         "el_feed_items.feed, '(?s)<item\\\\b.*?</item>', 0)) AS (item_no, item))) i",
        "el_entities": "(response STRING) RETURNS TABLE(kind STRING, term STRING) RETURN SELECT e.kind, e.term FROM (SELECT kind, explode(terms) AS term FROM "
                       "(SELECT explode(map(" + ", ".join(
                           f"{_lit(k)}, try_variant_get(try_parse_json(el_entities.response), '$.{k}', 'array<string>')" for k in fx.ENTITY_LIST_KEYS)
                       + ")) AS (kind, terms))) e",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    names = []
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
        names.append(name)
    return names

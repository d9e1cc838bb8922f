"""Driver-bound queries: model-response parsing and the gazetteer extractor."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import ENTITY_LIST_KEYS
from ..functions.text import WS
from ..operators import entities as E
from ..sources.tables import DriverTables
from . import sqlgen as S
from .registry import query

# Raw responses are built from the entity table, with one defect per id % 10
# class: fenced, truncated, missing key, non-list value, non-string topic,
# top-level array; the rest are clean.
_LISTS_SQL = ", ".join(
    f'"{k}": \' || {"cities_json" if k == "cities" else chr(39) + "[]" + chr(39)} || \'' for k in ENTITY_LIST_KEYS)


def _raw_spark(e):
    cities = F.when(F.size("cities") == 0, F.lit("[]")) \
        .otherwise(F.concat(F.lit('["'), F.array_join("cities", '", "'), F.lit('"]')))
    cat = F.when(F.col("category").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), "category", F.lit('"')))

    def obj(people, cat_json, drop_brands=False):
        parts = []
        for k in ENTITY_LIST_KEYS:
            if drop_brands and k == "brands":
                continue
            val = cities if k == "cities" else (people if k == "people" else F.lit("[]"))
            parts += [F.lit(f'"{k}": '), val, F.lit(", ")]
        return F.concat(F.lit("{"), *parts, F.lit('"category": '), cat_json, F.lit("}"))

    clean = obj(F.lit("[]"), cat)
    r = F.col("id") % 10
    raw = (F.when(r == 0, F.concat(F.lit("```json\n"), clean, F.lit("\n```")))
           .when(r == 1, F.expr("substr(__c, 1, length(__c) - 5)".replace("__c", "_clean")))
           .when(r == 2, obj(F.lit("[]"), cat, drop_brands=True))
           .when(r == 3, obj(F.lit('"Ali"'), cat))
           .when(r == 4, obj(F.lit("[]"), F.lit("5")))
           .when(r == 5, F.concat(F.lit("["), clean, F.lit("]")))
           .otherwise(clean))
    return e.withColumn("_clean", clean).select(F.col("article_id"), raw.alias("raw"))


def _obj_sql(people: str, cat: str, drop_brands: bool = False) -> str:
    parts = []
    for k in ENTITY_LIST_KEYS:
        if drop_brands and k == "brands":
            continue
        val = "cities_json" if k == "cities" else (people if k == "people" else "'[]'")
        parts.append(f"'\"{k}\": ' || {val} || ', '")
    return "'{' || " + " || ".join(parts) + " || '\"category\": ' || " + cat + " || '}'"


_CLEAN = _obj_sql("'[]'", "cat_json")
_RAW_SQL = f"""
base AS (
  select article_id, id,
    case when len(cities) = 0 then '[]' else '["' || array_to_string(cities, '", "') || '"]' end as cities_json,
    case when category is null then 'null' else '"' || category || '"' end as cat_json
  from v_entities),
raws AS (
  select article_id, case id % 10
    when 0 then '```json' || chr(10) || {_CLEAN} || chr(10) || '```'
    when 1 then substr({_CLEAN}, 1, length({_CLEAN}) - 5)
    when 2 then {_obj_sql("'[]'", "cat_json", True)}
    when 3 then {_obj_sql(S.lit('"Ali"'), "cat_json")}
    when 4 then {_obj_sql("'[]'", "'5'")}
    when 5 then '[' || {_CLEAN} || ']'
    else {_CLEAN} end as raw
  from base),
c AS (select article_id, {S.strip('raw')} as s from raws),
c2 AS (select article_id, case when starts_with(s, '```json') then substr(s, 8) else s end as s from c),
c3 AS (select article_id, {S.strip("case when ends_with(s, '```') then left(s, length(s) - 3) else s end")} as s
       from c2),
j AS (select article_id, try_cast(s as json) as j from c3),
v AS (select article_id, j, coalesce(json_type(j) = 'OBJECT', false)
  {''.join(f" and coalesce(json_exists(j, '$.{k}'), false)" for k in ENTITY_LIST_KEYS + ['category'])} as valid
  from j)
"""


@query("entity_response_clean", "WITH " + _RAW_SQL + "select article_id, valid, " + ", ".join(
    f"case when valid and json_type(j, '$.{k}') = 'ARRAY' then json_extract_string(j, '$.{k}[*]') "
    f"else []::VARCHAR[] end as {k}" for k in ENTITY_LIST_KEYS) + """,
  case when valid and json_type(j, '$.category') = 'VARCHAR' then json_extract_string(j, '$.category')
       else '' end as category
from v""")
def entity_response_clean(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return E.parse_responses(_raw_spark(t.entities)).select("article_id", "valid", *ENTITY_LIST_KEYS, "category")


TEST_GAZETTEER = [("de", "cities"), ("der", "cities"), ("elle", "people"), ("the", "people"),
                  ("of the", "organizations"), ("de la", "organizations")]
TEST_TOPICS = [("the", "politics", 1), ("and", "politics", 1), ("de", "economy", 2), ("la", "economy", 2),
               ("der", "sports", 3), ("und", "sports", 3)]


def _values_sql(rows, cols):
    vals = ", ".join("(" + ", ".join(S.lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(values {vals}) as t({', '.join(cols)})"


@query("gazetteer_entities", f"""
WITH gaz AS (select * from {_values_sql(TEST_GAZETTEER, ['term', 'kind'])}),
top AS (select * from {_values_sql(TEST_TOPICS, ['term', 'topic', 'rank'])}),
w AS (select id, list_filter(regexp_split_to_array({S.normalize_text("headline || ' ' || description")},
        '[{WS}]+'), lambda x: x <> '') as words from v_articles),
g AS (select id, unnest(list_distinct(words || case when len(words) >= 2 then
        list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) else [] end)) as term
      from w),
m AS (select g.id, z.kind, z.term from g join gaz z on z.term = g.term),
agg AS (select id, {", ".join(f"list_sort(list_distinct(list(term) filter (where kind = '{k}'))) as {k}"
                              for k in ENTITY_LIST_KEYS)} from m group by id),
th AS (select g.id, t.topic, t.rank, count(*) as score from g join top t on t.term = g.term
       group by g.id, t.topic, t.rank),
best AS (select id, arg_max(topic, (score, -rank)) as category from th group by id)
select a.id, {", ".join(f"coalesce(agg.{k}, []::VARCHAR[]) as {k}" for k in ENTITY_LIST_KEYS)}, best.category
from v_articles a left join agg on agg.id = a.id left join best on best.id = a.id""")
def gazetteer_entities(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    docs = t.articles.select("id", F.concat_ws(" ", "headline", "description").alias("text"))
    gaz = spark.createDataFrame(TEST_GAZETTEER, "term string, kind string")
    top = spark.createDataFrame(TEST_TOPICS, "term string, topic string, rank int")
    return E.gazetteer_entities(docs, gaz, top)

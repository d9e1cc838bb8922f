"""Keyed writes as DataFrame transforms (H-2 … H-8, B-15, D-J8, D-J11).

Parquet has no UPDATE: every upsert is "old table + change table → new
table version" (anti join for inserts, left join + ``when(matched)`` for
updates); the caller writes the result as a new version and swaps.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fx


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def next_ids(new_rows: DataFrame, existing: DataFrame, order_cols: list[str], col: str = "id",
             partitions: int | None = None) -> DataFrame:
    """Ids max(existing.id)+1, +2, … dense and in ``order_cols`` order (unique per row).

    No single-task window: rows are range-partitioned on the order key and numbered
    inside their partition; that numbering is written once to the shared checkpoint
    folder, and the per-partition offsets are computed from the written copy, so the
    offsets and the rows always come from the same data (no recomputation can
    disagree with itself)."""
    from ..session import materialize

    base = F.coalesce(existing.agg(F.max(col)).scalar().cast("long"), F.lit(0).cast("long"))
    n = partitions or int(new_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = new_rows.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id())
    ranged = ranged.withColumn("_pos", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)))
    fixed = materialize(ranged, "ids")
    counts = fixed.groupBy("_pid").agg(F.max("_pos").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return fixed.join(F.broadcast(offs), "_pid") \
        .withColumn(col, (base + F.col("_off") + F.col("_pos")).cast("long")).drop("_pid", "_pos", "_off")


# ---------------------------------------------------------------------------
# Sources
# ---------------------------------------------------------------------------
def get_or_create_sources(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """H-2: add incoming urls not present yet (name defaults to the url, language to 'ar');
    existing rows are kept unchanged, names included."""
    inc = incoming.select(
        "url",
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.col("url")).otherwise(F.col("name")).alias("name"),
        F.coalesce(F.col("language"), F.lit("ar")).alias("language"),
        F.col("bias"),
    )
    # several rows for one url: the smallest name wins (deterministic)
    inc = inc.groupBy("url").agg(F.min_by(F.struct("name", "language", "bias"), F.col("name")).alias("_r")) \
        .select("url", "_r.*")
    new = inc.join(sources.select("url"), "url", "left_anti")
    new = next_ids(new, sources, ["url"])
    cols = [c for c in sources.columns]
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(sources.schema[c].dataType).alias(c)
                       for c in cols])
    return sources.unionByName(new)


def _order(changes: DataFrame, order: str | None, columns) -> Column:
    """What decides which of several change rows of a key is the later one: the column ``order``, then the row's own values."""
    own = F.struct(*[c for c in columns if c in changes.columns])
    return own if order is None else F.struct(F.col(order).alias("o"), own.alias("v"))


def update_source_details(sources: DataFrame, details: DataFrame,
                          columns=("name", "bias", "owner", "founded_at", "hq_location"), order: str | None = None) -> DataFrame:
    """H-3 / D-J8: on url match overwrite the listed columns, nulls included.  Of detail rows
    that repeat a url the last one counts as a whole: by the column ``order``, else by the listed columns."""
    d = (details.groupBy(F.col("url").alias("_u")).agg(F.max_by(F.struct(*columns), _order(details, order, columns)).alias("_d"))
         .select("_u", *[F.col(f"_d.{c}").alias(f"_d_{c}") for c in columns]))
    j = sources.join(d, sources.url == d._u, "left")
    hit = F.col("_u").isNotNull()
    out = j
    for c in columns:
        old = F.col(c) if c in sources.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.when(hit, F.col(f"_d_{c}")).otherwise(old))
    return out.drop("_u", *[f"_d_{c}" for c in columns])


def details_not_found(sources: DataFrame, details: DataFrame) -> DataFrame:
    """D-J8: detail rows whose url matches no source."""
    return details.join(sources.select("url"), "url", "left_anti")


def update_partial(table: DataFrame, changes: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """H-4 / H-5: set the listed columns where the change row gives a non-null value.  Change rows
    that repeat a key are applied one after the other by the column ``order`` (else by their listed
    values), so each column ends with its last non-null value; one partial aggregation, whatever a key's rows."""
    listed = [c for c in columns if c in changes.columns and c in table.columns]
    later = _order(changes, order, listed)
    ch = changes.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_rows"), *[
        F.max_by(c, F.when(F.col(c).isNotNull(), later)).alias(f"_n_{c}") for c in listed]).drop("_rows")
    j = table.join(ch, table[key] == ch._k, "left")
    for c in listed:
        j = j.withColumn(c, F.coalesce(F.col(f"_n_{c}"), F.col(c)))
    return j.drop("_k", *[f"_n_{c}" for c in listed])


def mark_processed(articles: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """H-8: set updated_at for the given article ids."""
    hit = ids.select(F.col("id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    j = articles.join(hit, articles.id == hit._id, "left")
    return j.withColumn("updated_at", F.when(F.col("_hit"), at).otherwise(F.col("updated_at"))) \
        .drop("_id", "_hit")


# ---------------------------------------------------------------------------
# Tokens
# ---------------------------------------------------------------------------
def split_valid_registrations(regs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B-15: device_id, token and platform must all be non-empty."""
    ok = F.lit(True)
    for c in ("device_id", "token", "platform"):
        ok = ok & F.coalesce(F.col(c) != "", F.lit(False))
    return regs.filter(ok), regs.filter(~ok)


def upsert_tokens(tokens: DataFrame, regs: DataFrame) -> DataFrame:
    """H-6: apply registrations (user_id, device_id, token, platform, ts, seq) in (ts, seq)
    order, as the one-by-one rule does: a known token updates its first row (lowest id)
    with the latest registration and sets updated_at; an unknown token is inserted once
    (created_at = first registration) and further registrations update it."""
    valid, _ = split_valid_registrations(regs)
    order = F.struct("ts", "seq")
    per = valid.groupBy("token").agg(
        F.max_by(F.struct("user_id", "device_id", "platform"), order).alias("last"),
        F.max(order).alias("last_key"),
        F.min(order).alias("first_key"),
        F.count(F.lit(1)).alias("n"))
    first_row = tokens.groupBy("token").agg(F.min("id").alias("_first_id"))
    upd = per.join(first_row, "token")
    u = upd.select(F.col("_first_id").alias("_id"), F.col("last.user_id").alias("_user"),
                   F.col("last.device_id").alias("_dev"), F.col("last.platform").alias("_plat"),
                   F.col("last_key.ts").alias("_ts"))
    t = tokens.join(u, tokens.id == u._id, "left")
    hit = F.col("_id").isNotNull()
    t = t.select(
        "id",
        F.when(hit, F.col("_user")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(hit, F.col("_dev")).otherwise(F.col("device_id")).alias("device_id"),
        "token",
        F.when(hit, F.col("_plat")).otherwise(F.col("platform")).alias("platform"),
        "created_at",
        F.when(hit, F.col("_ts")).otherwise(F.col("updated_at")).alias("updated_at"))
    new = per.join(first_row.select("token"), "token", "left_anti")
    new = new.select(
        F.col("last.user_id").alias("user_id"), F.col("last.device_id").alias("device_id"), "token",
        F.col("last.platform").alias("platform"), F.col("first_key.ts").alias("created_at"),
        F.when(F.col("n") > 1, F.col("last_key.ts")).alias("updated_at"))
    new = next_ids(new, tokens, ["token"])
    return t.unionByName(new.select(*t.columns))


def expire_tokens(tokens: DataFrame, as_of: Column, days: int = fx.TOKEN_EXPIRY_DAYS) -> tuple[DataFrame, DataFrame]:
    """H-7: (kept, deleted): rows with updated_at < as_of - days are deleted; a null
    updated_at is never expired (three-valued logic)."""
    cond = F.col("updated_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    gone = F.coalesce(cond, F.lit(False))
    return tokens.filter(~gone), tokens.filter(gone)


def delete_tokens(tokens: DataFrame, values: DataFrame) -> DataFrame:
    """H-7: delete by token value."""
    return tokens.join(values.select("token"), "token", "left_anti")

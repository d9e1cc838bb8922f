"""Landed RSS files → parsed feed items → article rows (A-1 … A-5, A-7 … A-11).

Fetching over HTTP is outside the engine; files are landed under
``<root>/<feed_key>/<name>.xml`` by the user's ingest tool.  Spark's XML reader
gives a row per ``<item>`` and reads a file as a stream, so a feed of any size never
is one value; what stands before the first item (A-3) does not matter.  In PERMISSIVE mode
one malformed item yields one reject row instead of losing the whole feed (Q-10),
and a file without any item yields a reject of its own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fx
from ..functions.dates import standardize_feed_date
from ..functions.text import html_to_text, image_url

ITEM_DDL = ("`title` STRING, `description` STRING, `pubDate` STRING, `link` STRING, "
            "`media:content` STRUCT<`_url`: STRING>, `content:encoded` STRING, `_corrupt_record` STRING")
#: This parser cuts out item after item and parses each alone; the other one loses the whole file for one fault.
READ = {"useLegacyXMLParser": "true", "rowTag": "item", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "recursiveFileLookup": "true"}


def read_feed_files(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(path, x) per <item> of the landed files; x is the item's raw fields."""
    return _raw(spark.read.format("xml").options(**READ, pathGlobFilter=glob).schema(ITEM_DDL).load(path))


def feed_item_stream(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """The same as a stream: the items of every newly landed file."""
    return _raw(spark.readStream.format("xml").options(**READ, pathGlobFilter=glob).schema(ITEM_DDL).load(path))


def _raw(items: DataFrame) -> DataFrame:
    fields = [f.name for f in items.schema.fields]
    return items.select(F.col("_metadata.file_path").alias("path"), F.struct(*[F.col(f"`{c}`") for c in fields]).alias("x"))


def landed_files(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(path) of the landed files, empty ones included, from Spark's own listing; nothing is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).inputFiles()
    return spark.createDataFrame([(p,) for p in listed], "path string")


def items_from_text(raw: DataFrame) -> DataFrame:
    """A-1/A-3/A-4: (path, item_no, title, description, pubDate, link, media_url, encoded,
    corrupt) — one row per <item>; ``item_no`` grows in the order of a file."""
    return raw.select(
        "path", F.monotonically_increasing_id().alias("item_no"),
        F.col("x.title").alias("title"), F.col("x.description").alias("description"),
        F.col("x.pubDate").alias("pubDate"), F.col("x.link").alias("link"),
        F.col("x").getField("media:content").getField("_url").alias("media_url"),
        F.col("x").getField("content:encoded").alias("encoded"),
        # the reader refuses a scan of its corrupt-record column alone, so the column refers to another one, too
        F.concat(F.col("x._corrupt_record"), F.left(F.coalesce(F.col("x.title"), F.lit("")), F.lit(0))).alias("corrupt"))


def parse_items(items: DataFrame, app_tz: str = fx.APP_TIMEZONE) -> DataFrame:
    """A-1 field rules + E-5/E-6/E-7: headline, description (text), published_at
    ('yyyy-MM-dd HH:mm:ss' in the app zone or 'N/A'), article_url, image_url."""
    desc_html = F.coalesce(F.col("description"), F.lit(""))
    pub = F.coalesce(F.col("pubDate"), F.lit(""))
    return items.filter(F.col("corrupt").isNull()).select(
        "path", "item_no",
        F.coalesce(F.col("title"), F.lit("N/A")).alias("headline"),
        html_to_text(desc_html).alias("description"),
        F.when(pub != "", standardize_feed_date(pub, app_tz)).otherwise(F.lit("N/A")).alias("published_at"),
        F.coalesce(F.col("link"), F.lit("N/A")).alias("article_url"),
        image_url(F.col("media_url"), F.col("encoded"), desc_html).alias("image_url"))


def item_rejects(items: DataFrame) -> DataFrame:
    """A-4: items that did not parse, with their file."""
    return items.filter(F.col("corrupt").isNotNull()).select("path", "item_no", F.lit("malformed item").alias("reason"))


def file_rejects(files: DataFrame, items: DataFrame) -> DataFrame:
    """A-4: landed files (path) in which no item was found."""
    plain = F.regexp_replace("path", "^file:/+", "file:/")  # the readers spell a local path differently
    seen = items.select(plain.alias("_p")).distinct()
    return files.withColumn("_p", plain).join(seen, "_p", "left_anti").select(
        "path", F.lit(None).cast("long").alias("item_no"), F.lit("no item").alias("reason"))


def feed_key(path: Column) -> Column:
    """Directory name of a landed file = the feed key of the registry."""
    return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)


def feed_registry(spark: SparkSession, feeds: list[tuple[str, str]],
                  international: list[str] = fx.INTERNATIONAL_SOURCES) -> DataFrame:
    """A-2: (feed_key, source, category) — 'international' when the source is listed."""
    return registry_from(spark.createDataFrame(feeds, "feed_key string, source string"), international)


def registry_from(df: DataFrame, international: list[str] = fx.INTERNATIONAL_SOURCES) -> DataFrame:
    """A-2 over a (feed_key, source) DataFrame."""
    intl = F.array(*[F.lit(u) for u in international])
    return df.withColumn("category", F.when(F.array_contains(intl, F.col("source")), "international")
                         .otherwise("local"))


def read_bias_ratings(spark: SparkSession, path: str) -> DataFrame:
    """A-5: JSON array of {Source_name, website_url, Bias} → (url, name, bias)."""
    from ..schema import BIAS_RATING
    df = spark.read.option("multiLine", True).schema(BIAS_RATING).json(path)
    return df.select(F.col("website_url").alias("url"), F.col("Source_name").alias("name"),
                     F.col("Bias").alias("bias"))


def encode_lists(df: DataFrame, cols: list[str]) -> DataFrame:
    """A-7 (write side): list columns as JSON text (non-ASCII kept as is)."""
    return df.withColumns({c: F.to_json(F.col(c)) for c in cols})


def decode_lists(df: DataFrame, cols: list[str]) -> DataFrame:
    """A-7 (read side): JSON text → array<string>; text that does not parse stays in
    ``<col>_raw`` and the list is null (the reference hands back the raw value)."""
    out = df
    for c in cols:
        parsed = F.try_variant_get(F.try_parse_json(F.col(c)), "$", "array<string>")
        out = out.withColumn(f"{c}_raw", F.when(parsed.isNull(), F.col(c))).withColumn(c, parsed)
    return out


def create_table(spark: SparkSession, schema, path: str) -> None:
    """A-8: an empty table with the declared schema."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """A-9: append rows to a table."""
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """A-10: JSON result sink (one object per line)."""
    df.write.mode("overwrite").json(path)


def sample(df: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    """A-11: first ``n`` rows by ``order`` (a sampling feature: the limit is the point)."""
    return df.orderBy(order).limit(n)

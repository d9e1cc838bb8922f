"""The SQL functions agree with the Column API."""
from pyspark.sql import functions as F

from eventlens.functions import text as T
from eventlens.functions.labels import bias_label
from eventlens.functions.sql import register_sql_functions
from eventlens.operators.bias import bias_side


def test_sql_functions_match_columns(spark):
    register_sql_functions(spark)
    rows = [("  إِنَّ ة ", "Pro-SAF"), ("Café déjà!\n", "neutral"), ("", None), ("x", "Oppose-SAF")]
    df = spark.createDataFrame(rows, "t string, b string")
    df.createOrReplaceTempView("sqlf")
    a = spark.sql("select el_content_hash(t, t) h, el_normalize_text(t) n, el_bias_side(b) s, "
                  "el_bias_label(b) l, el_strip(t) st from sqlf").collect()
    b = df.select(T.content_hash("t", "t").alias("h"), T.normalize_text("t").alias("n"),
                  bias_side(F.col("b")).alias("s"), bias_label("b").alias("l"), T.strip("t").alias("st")).collect()
    assert a == b


def test_label_functions_match_columns(spark):
    from eventlens.functions import dates, labels
    register_sql_functions(spark)
    df = spark.createDataFrame([("Pro-SAF", "ar", "local", 1, 95), ("x", "en", "y", 9, 95), (None, None, None, 1, 0)], "b string, l string, c string, p long, n long")
    df.createOrReplaceTempView("sqll")
    a = spark.sql("select el_bias_css(b) css, el_language_label(l) l, el_local_label(c) c, el_page_numbers(p, n, 10) p from sqll").collect()
    b = df.select(labels.bias_css("b").alias("css"), labels.language_label("l").alias("l"), labels.local_label("c").alias("c"),
                  dates.page_numbers(F.col("p"), F.col("n"), F.lit(10)).alias("p")).collect()
    assert a == b


def test_functions_that_return_tables(spark):
    register_sql_functions(spark)
    feed = "<rss><item><title>a</title><link>u1</link></item> x <item><title>b</title><description>d</description></item></rss>"
    spark.createDataFrame([(1, feed), (2, "no item"), (3, None)], "id int, feed string").createOrReplaceTempView("feeds")
    got = spark.sql("select id, i.item_no, i.title, i.description, i.link from feeds, lateral el_feed_items(feed) i order by id, item_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", None, "u1"), (1, 1, "b", "d", None)]
    spark.createDataFrame([(1, '{"people": ["P", "Q"], "cities": ["C"], "brands": 3}'), (2, "broken"), (3, None)], "id int, r string").createOrReplaceTempView("answers")
    got = spark.sql("select id, e.kind, e.term from answers, lateral el_entities(r) e order by kind, term").collect()
    assert [tuple(r) for r in got] == [(1, "cities", "C"), (1, "people", "P"), (1, "people", "Q")]

"""Read-side views on inline rows."""

from pyspark.sql import functions as F

from tallyloom.operators import views


def test_media_keeps_only_what_its_type_has(spark):
    df = spark.createDataFrame([([("image", "u", 3, 4, True), ("embed", "v", 1, 1, True)],)], "m array<struct<type:string,url:string,width:int,height:int,complete:boolean>>")
    got = df.select(views.media(F.col("m")).alias("x")).first().x
    assert [tuple(r) for r in got] == [("image", "u", 3, 4, None), ("embed", "v", None, None, None)]


def test_zip_marks_unequal_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, ["a"], [1, 2])], "k long, x array<string>, y array<int>")
    assert {(r.k, r["rank"], r.aligned) for r in views.zipped(df, "k", "x", "y").collect()} == {(1, 1, True), (1, 2, True), (2, 1, False), (2, 2, False)}


def test_feed_orders_differ_on_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "id long, t long").withColumn("g", F.lit(1))
    stored, shown = (views.placed(df, ["g"], views.feed_order(F.col("t"), F.col("id"), d)).orderBy("place") for d in (False, True))
    assert [r.id for r in stored.collect()] == [2, 1] and [r.id for r in shown.collect()] == [1, 2]


def test_source_totals(spark):
    df = spark.createDataFrame([([("a", 2), ("b", 3)], "x"), ([], "총 7개"), ([], "none")], "b array<struct<name:string,count:long>>, t string")
    assert [r.x for r in df.select(views.source_total(F.col("b"), F.col("t")).alias("x")).collect()] == [5, 7, None]


def test_unknown_category_is_empty(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    assert [views.in_category(df, "c", w, ["a", "b"]).count() for w in ("all", "a", "z")] == [2, 1, 0]


def test_outside_header_needs_all_evidence(spark):
    f = lambda status, listed: spark.range(1).select(views.outside_header(F.lit(status), F.lit("5_1"), F.lit("t"), F.lit(1), F.lit(listed), F.lit("5"), F.lit(10), F.lit(20)).alias("x")).first().x
    assert (f("outside_window", 9), f("outside_window", 10), f("outside_window", None), f("ok", 9)) == (True, False, False, False)


def test_index_rows_and_links(spark):
    df = spark.createDataFrame([("2026-10-01-am", "2026-10-01", "am", True, [("t",)]), ("e", "2026-10-01", "pm", False, [])], "id string, date string, edition string, archive boolean, stories array<struct<title:string>>")
    assert [tuple(r) for r in views.index_rows(df).collect()] == [("2026-10-01-am", 1, "archive/2026-10-01/am.json", "t"), ("e", 0, "2026-10-01/pm.json", None)]
    assert spark.range(1).select(views.link("/x", a=F.lit("b c"), d=F.lit(None).cast("string")).alias("u")).first().u == "/x?a=b+c"

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows_of

from estimark.operators.scan import id_chunk, ordinal, running


def _data(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i, rnd.randint(0, 5), rnd.randint(-3, 9)) for i in range(n)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "g long, id long, flag int, v int")


def test_running_equals_single_window(spark):
    df = _data(spark)
    got = running(df, ["g"], ["id"], id_chunk("id", 37),
                  {"c": ("count", None), "s": ("sum", "flag"), "m": ("max", "v")})
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exp = df.select("*", F.count(F.lit(1)).over(w).alias("c"), F.sum("flag").over(w).alias("s"),
                    F.max("v").over(w).alias("m"))
    assert rows_of(got, "g", "id", "c", "s", "m") == rows_of(exp, "g", "id", "c", "s", "m")


def test_ordinal_equals_row_number(spark):
    df = _data(spark, 300, 3)
    got = ordinal(df, ["g"], ["id"], "rn", chunk=id_chunk("id", 11))
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert rows_of(got, "g", "id", "rn") == rows_of(exp, "g", "id", "rn")


import pytest  # noqa: E402


@pytest.mark.parametrize("width", [1, 2, 1000, 1 << 40])
def test_running_any_chunk_width(spark, width):
    df = _data(spark, 200, width % 97)
    got = running(df, ["g"], ["id"], id_chunk("id", width), {"s": ("sum", "v"), "m": ("max", "v")})
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exp = df.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    assert rows_of(got, "g", "id", "s", "m") == rows_of(exp, "g", "id", "s", "m")


def test_running_with_ties_in_order_and_nulls(spark):
    """Rows tied on the order get distinct running counts; NULL values are
    ignored by sum/max as in the window."""
    rows = [(1, 5, None), (1, 5, 3), (1, 6, 1), (1, 7, None), (2, 1, 4)]
    df = spark.createDataFrame(rows, "g long, id long, v int")
    got = running(df, ["g"], ["id"], id_chunk("id", 2), {"c": ("count", None), "s": ("sum", "v")})
    r = sorted((x["g"], x["id"], x["c"], x["s"]) for x in got.collect())
    assert [(g, i, c) for g, i, c, _ in r] in ([(1, 5, 1), (1, 5, 2), (1, 6, 3), (1, 7, 4), (2, 1, 1)],
                                               [(1, 5, 2), (1, 5, 1), (1, 6, 3), (1, 7, 4), (2, 1, 1)])
    assert [s for g, i, c, s in r if i >= 6] == [4, 4]


def test_running_sum_null_after_carry(spark):
    rows = [(1, 0, 3), (1, 2, None), (1, 3, 4), (1, 4, None), (2, 0, None)]
    df = spark.createDataFrame(rows, "g long, id long, v int")
    got = running(df, ["g"], ["id"], id_chunk("id", 2), {"s": ("sum", "v")})
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exp = df.select("*", F.sum("v").over(w).alias("s"))
    assert rows_of(got, "g", "id", "s") == rows_of(exp, "g", "id", "s")


def test_running_null_key_is_one_group(spark):
    rows = [(None, 1, 1), (None, 5, 1), (None, 9, 1), (7, 2, 1)]
    df = spark.createDataFrame(rows, "g long, id long, v int")
    got = running(df, ["g"], ["id"], id_chunk("id", 2), {"c": ("count", None)})
    assert rows_of(got, "g", "id", "c") == rows_of(spark.createDataFrame(
        [(None, 1, 1), (None, 5, 2), (None, 9, 3), (7, 2, 1)], "g long, id long, c long"))


def _most_rows(df, keys):
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("kind", ["busy hour", "hashed ids"])
def test_measured_chunks_bound_the_rows_of_a_chunk(spark, kind):
    """One key with 95 % of the rows: in one hour, or with ids spread over the whole range."""
    import datetime as dt

    from estimark.operators.scan import measured_chunks
    n, rows = 20_000, 1_000
    base = spark.range(n).withColumn("g", F.when(F.col("id") % 20 == 0, F.col("id") % 7).otherwise(99))
    if kind == "busy hour":
        start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
        df = base.withColumn("o", F.timestamp_add("SECOND", (F.xxhash64("id") % 1800 + 1800).cast("int"), start))
    else:
        df = base.withColumn("o", F.xxhash64("id"))
    bounds = measured_chunks(df, ["g"], F.col("o"), rows)
    cut = df.withColumn("__key", F.struct("g")).join(bounds, "__key", "left").withColumn(
        "c", F.coalesce(F.size(F.filter("__bounds", lambda b: b < F.col("o"))), F.lit(0)))
    assert _most_rows(cut, ["g", "c"]) <= 2 * rows
    assert bounds.count() == 1
    got = running(df, ["g"], ["o", "id"], None, {"c": ("count", None)}, chunk_rows=rows)
    w = Window.partitionBy("g").orderBy("o", "id")
    exp = df.withColumn("c", F.row_number().over(w).cast("long"))
    assert got.select("g", "id", "c").exceptAll(exp.select("g", "id", "c")).count() == 0 and got.count() == n
    plain = running(df, ["g"], ["o", "id"], None, {"c": ("count", None)})
    assert plain.select("g", "id", "c").exceptAll(exp.select("g", "id", "c")).count() == 0


def test_running_measures_with_null_keys_and_null_order(spark):
    rows = [(None if i % 2 else 1, None if i % 9 == 0 else (i * 7919) % 1000, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, o long, id long")
    got = running(df, ["g"], ["o", "id"], None, {"s": ("sum", "id")}, chunk_rows=20)
    w = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert rows_of(got, "g", "id", "s") == rows_of(df.withColumn("s", F.sum("id").over(w)), "g", "id", "s")

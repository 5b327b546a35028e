from decimal import Decimal

from conftest import SF_SMALL, rows_of

from estimark.operators import votes as V
from estimark.sources import bindings as B


def _votes(spark, scores, task=1):
    return spark.createDataFrame([(1, task, p, s) for p, s in enumerate(scores)],
                                 "room_id int, task_id long, person_id long, score int")


def _median(spark, scores):
    r = V.task_median(_votes(spark, scores), B.b_dictionary(spark)).collect()
    return r[0]["median"]


def test_median_odd_even_sentinels(spark):
    assert _median(spark, [3, 5, 8]) == Decimal("5.00")
    assert _median(spark, [3, 5]) == Decimal("4.00")
    assert _median(spark, [3, 5, 8, 999, 777, 0]) == Decimal("5.00")


def test_median_nothing_left_is_null(spark):
    assert _median(spark, [0, 777, 999]) is None


def test_median_rounds_half_up_to_two_places(spark):
    assert _median(spark, [1, 2]) == Decimal("1.50")
    assert _median(spark, [2, 3, 5, 8]) == Decimal("4.00")


def test_last_vote_wins(spark):
    log = spark.createDataFrame(
        [(1, 7, 3, 3, "2024-01-01 10:00:00", 1, 1, 1.0), (1, 7, 3, 13, "2024-01-01 10:05:00", 2, 1, 2.0),
         (1, 7, 4, 5, "2024-01-01 10:01:00", 3, 1, 3.0)],
        "room_id int, task_id long, person_id long, score int, ts string, l_orderkey long, l_linenumber int, "
        "l_quantity double").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["F"]).to_timestamp("ts"))
    got = rows_of(V.latest_vote(log), "task_id", "person_id", "score")
    assert got == [(7, 3, 13), (7, 4, 5)]


def test_last_vote_tie_on_time_uses_rest_of_order(spark):
    import pyspark.sql.functions as F
    log = spark.createDataFrame(
        [(1, 7, 3, 3, 1, 1, 1.0), (1, 7, 3, 8, 1, 1, 5.0), (1, 7, 3, 5, 0, 9, 9.0)],
        "room_id int, task_id long, person_id long, score int, l_orderkey long, l_linenumber int, l_quantity double"
    ).withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    assert rows_of(V.latest_vote(log), "score") == [(8,)]


def test_median_window_matches_group_median(spark):
    votes = V.latest_vote(B.b_vote_log(spark, SF_SMALL))
    d = B.b_dictionary(spark)
    mw = V.median_window(votes, d)
    tm = V.task_median(votes, d)
    joined = mw.join(tm.withColumnRenamed("median", "m2"), ["room_id", "task_id"])
    assert joined.filter("median <> m2").count() == 0
    assert mw.count() == V.not_in_dictionary(votes, d).count()


def test_vote_ordinals_dense_per_task(spark):
    v = _votes(spark, [1, 2, 3], task=5).union(_votes(spark, [4, 5], task=6))
    got = rows_of(V.vote_ordinals(v), "task_id", "person_id", "person_ord")
    assert got == [(5, 0, 1), (5, 1, 2), (5, 2, 3), (6, 0, 1), (6, 1, 2)]


def test_decode_scores(spark):
    got = rows_of(V.decode_scores(_votes(spark, [777, 999, 0, 8]), B.b_dictionary(spark)), "score", "label")
    assert got == [(0, "Not voice"), (777, "Question"), (8, "8"), (999, "Coffee break")]
    deck = rows_of(V.decode_scores(_votes(spark, [0, 8, 7, 777]), B.b_dictionary(spark)), "score", "in_deck")
    assert deck == [(0, False), (7, False), (777, True), (8, True)]


def test_results_grid_masks_and_pivots(spark):
    from decimal import Decimal as D

    from estimark.operators.grid import pivot_grid, results_grid
    votes = spark.createDataFrame([(1, 7, 30, 5), (1, 7, 10, 8), (2, 9, 10, 3)],
                                  "room_id int, task_id long, person_id long, score int")
    persons = spark.createDataFrame([(10, "ann"), (30, "bob")], "person_id long, login_name string")
    medians = spark.createDataFrame([(7, D("6.50")), (9, D("3.00"))], "task_id long, median decimal(9,2)")
    active = spark.createDataFrame([(1, False), (2, True)], "room_id int, has_active boolean")
    cells = results_grid(votes, persons, medians, active)
    assert rows_of(cells, "task_id", "person_ord", "login_name", "score") == [
        (7, 1, "ann", 8), (7, 2, "bob", 5), (9, 1, "ann", None)]
    wide = pivot_grid(cells, [1, 2]).orderBy("task_id").collect()
    assert [(r["task_id"], r["1"], r["2"], r["median"]) for r in wide] == [(7, 8, 5, D("6.50")), (9, None, None, D("3.00"))]

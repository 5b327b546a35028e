from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows_of

from estimark.operators import members as M
from estimark.operators import snapshot as S


def test_reconnect_counts_once(spark):
    persons = spark.createDataFrame([(1, "ann", "ann@x.io")], "person_id long, login_name string, email string")
    conns = spark.createDataFrame([(5, 1), (5, 1)], "room_id int, person_id long")
    assert rows_of(M.connected_persons(persons, conns)) == [(5, 1, "ann")]


def test_zero_fill_counts(spark):
    conns = spark.createDataFrame([(1, 10), (1, 11), (1, 10)], "room_id int, person_id long")
    tasks = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "room_id int, task_id long")
    votes = spark.createDataFrame([(1, 2, 10)], "room_id int, task_id long, person_id long")
    got = M.zero_fill_votes(conns, tasks, votes)
    assert sum(r["n_zero_filled"] for r in got.collect()) == 5
    assert rows_of(got, "task_id", "n_slots", "n_voted") == [(1, 2, 0), (2, 2, 1), (3, 2, 0)]


def test_zero_fill_interleaved_rooms(spark):
    conns = spark.createDataFrame([(1, 10)], "room_id int, person_id long")
    tasks = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "room_id int, task_id long")
    votes = spark.createDataFrame([], "room_id int, task_id long, person_id long")
    got = rows_of(M.zero_fill_votes(conns, tasks, votes), "room_id", "task_id")
    assert got == [(1, 1), (1, 3)]


def test_task_ordinals(spark):
    tasks = spark.createDataFrame([(1, 40), (1, 10), (1, 12), (2, 11)], "room_id int, task_id long")
    assert rows_of(M.task_ordinals(tasks), "room_id", "task_id", "task_ord") == [
        (1, 10, 1), (1, 12, 2), (1, 40, 3), (2, 11, 1)]


def test_creator_role(spark):
    rooms = spark.createDataFrame([(1, 100)], "room_id int, creator long")
    persons = spark.createDataFrame([(100, "c@x.io"), (101, "u@x.io")], "person_id long, email string")
    pairs = spark.createDataFrame([(1, 100), (1, 101), (9, 100)], "room_id int, person_id long")
    assert rows_of(M.creator_role(rooms, persons, pairs)) == [(1, 100, "Creator"), (1, 101, "User"), (9, 100, "User")]


def test_room_exists_checks_length(spark):
    g = "a" * 36
    rooms = spark.createDataFrame([(g,)], "room_guid string")
    probes = spark.createDataFrame([(g,), ("b" * 36,), ("a" * 35,)], "probe string")
    assert rows_of(M.room_exists(rooms, probes)) == [("a" * 35, False), (g, True), ("b" * 36, False)]


def _tiny_snapshot(spark, active=True):
    rooms = spark.createDataFrame([(1, "Sprint", active)], "room_id int, name_room string, is_active boolean")
    persons = spark.createDataFrame([(7, "ann", "a@x.io"), (3, "bob", "b@x.io")],
                                    "person_id long, login_name string, email string")
    conns = spark.createDataFrame([(1, 7), (1, 3), (1, 7)], "room_id int, person_id long")
    tasks = spark.createDataFrame([(1, 20, "t2", 3), (1, 10, "t1", 5)], "room_id int, task_id long, name string, minutes int")
    votes = spark.createDataFrame([(1, 10, 7, 8), (1, 10, 3, 5)], "room_id int, task_id long, person_id long, score int")
    results = spark.createDataFrame([(10, Decimal("6.50"))], "task_id long, median decimal(9,2)")
    return S.room_snapshot(rooms, persons, conns, tasks, votes, results)


def test_room_snapshot_nested_and_ordered(spark):
    r = _tiny_snapshot(spark).collect()[0]
    assert r["error"] is None and r["NameRoom"] == "Sprint"
    assert [(p["Id"], p["UserName"]) for p in r["Persons"]] == [(1, "bob"), (2, "ann")]
    assert [(t["Id"], t["NameTask"], t["Median"]) for t in r["Tasks"]] == [(1, "t1", Decimal("6.50")), (2, "t2", None)]
    assert [(v["PersonId"], v["Score"]) for v in r["Tasks"][0]["PersonTask"]] == [(1, 5), (2, 8)]
    assert r["Tasks"][1]["PersonTask"] == []


def test_inactive_room_is_unknown(spark):
    r = _tiny_snapshot(spark, active=False).collect()[0]
    assert r["error"] == "UnknownRoom" and r["Tasks"] is None and r["NameRoom"] is None


def test_snapshot_xml_round_trip(spark):
    snap = _tiny_snapshot(spark)
    xml = S.room_snapshot_xml(snap)
    text = xml.collect()[0]["xml"]
    assert text.lstrip().startswith("<Room") and 'NameRoom="Sprint"' in text and 'Median="6.50"' in text
    back = S.parse_room_xml(xml)
    assert rows_of(S.snapshot_summary(back)) == rows_of(S.snapshot_summary(snap))


def test_unknown_room_xml(spark):
    text = S.room_snapshot_xml(_tiny_snapshot(spark, active=False)).collect()[0]["xml"]
    assert 'Error="UnknownRoom"' in text and "NameRoom" not in text and "<Tasks" not in text


def test_paged_view_equals_single_page(spark):
    from conftest import SF_SMALL
    from estimark.operators import votes as V
    from estimark.sources import bindings as B
    votes = V.latest_vote(B.b_vote_log(spark, SF_SMALL))
    args = (B.b_rooms(spark, SF_SMALL), B.b_persons(spark, SF_SMALL), B.b_connections(spark, SF_SMALL),
            B.b_tasks(spark, SF_SMALL), votes, V.task_median(votes, B.b_dictionary(spark)))
    one = S.room_snapshot(*args, page_cells=10 ** 9)
    paged = S.room_snapshot(*args, page_cells=7)
    assert one.groupBy("room_id").count().filter("count > 1").count() == 0
    assert paged.filter("page > 1").count() > 0
    # every page is bounded
    cells = F.aggregate("Tasks", F.lit(0), lambda a, t: a + F.greatest(F.size(t["PersonTask"]), F.lit(1)))
    assert paged.filter(F.coalesce(cells, F.lit(0)) > 7).count() == 0
    assert rows_of(S.snapshot_summary(paged)) == rows_of(S.snapshot_summary(one))
    # the flattened cells in page order equal the single document's cells
    def flat(df):
        t = df.select("room_id", "page", F.posexplode("Tasks").alias("i", "t"))
        v = t.select("room_id", "page", "i", F.col("t.Id").alias("task"), F.explode_outer("t.PersonTask").alias("v"))
        return sorted((r["room_id"], r["task"], r["v"]["PersonId"] if r["v"] else None,
                       r["v"]["Score"] if r["v"] else None) for r in v.collect())
    assert flat(paged) == flat(one)
    back = S.parse_room_xml(S.room_snapshot_xml(paged))
    assert rows_of(S.snapshot_summary(back)) == rows_of(S.snapshot_summary(one))


def test_resolve_rooms(spark):
    rooms = spark.createDataFrame([(1, "g-1"), (2, "g-2")], "room_id long, room_guid string")
    log = spark.createDataFrame([(10, "g-2"), (11, "nope")], "event_id long, room_guid string")
    assert rows_of(M.resolve_rooms(log, rooms), "event_id", "room_id", "reason") == [(10, 2, None), (11, None, "unknown_room")]

"""Raw messages, slots, XML files, SQL functions, error counts, new rooms: hand-made cases."""

import datetime as dt
import tempfile

from conftest import rows_of

from estimark.functions.sql_functions import register_functions
from estimark.operators import members as M
from estimark.operators import requests as RQ
from estimark.sources import xml_files as XF

AT = lambda m: dt.datetime(2024, 1, 1, 10, m)


def test_messages_resolve_by_collated_keys(spark):
    log = spark.createDataFrame([(1, "AB-c  ", "Ann@X.io"), (2, "ab-C", "bob@x.io"), (3, "zz", "ann@x.io "), (4, None, None), (5, "", "?")],
                                "event_id long, room_guid string, email string")
    rooms = spark.createDataFrame([(7, "ab-c"), (9, "AB-C "), (8, None)], "room_id long, room_guid string")
    persons = spark.createDataFrame([(70, "ann@x.io"), (71, None)], "person_id long, email string")
    got = M.resolve_messages(log, rooms, persons)
    assert rows_of(got, "event_id", "room_id", "person_id", "reason") == [
        (1, 7, 70, None), (2, 7, None, "unknown_person"), (3, None, 70, "unknown_room"),
        (4, None, None, "unknown_room_and_person"), (5, None, None, "unknown_room_and_person")]


def test_slot_bitmaps_hold_the_missing_pairs(spark):
    members = [(1, p) for p in (0, 1, 62, 63, 64, 126, 1000)] + [(1, 64), (2, 5)]
    conns = spark.createDataFrame(members, "room_id long, person_id long")
    tasks = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "room_id long, task_id long")
    votes = spark.createDataFrame([(1, 10, 62), (1, 10, 64), (1, 10, 64), (1, 10, 999), (2, 20, 5)], "room_id long, task_id long, person_id long")
    b = M.slot_bitmaps(conns, tasks, votes)
    want = {(1, 10, p) for p in (0, 1, 63, 126, 1000)} | {(1, 11, p) for p in (0, 1, 62, 63, 64, 126, 1000)}
    assert set(rows_of(M.slots_of(b), "room_id", "task_id", "person_id")) == want
    assert sum(r["n_slots"] for r in b.collect()) == len(want) and b.count() == 8
    assert all(0 < r["slots"] < 1 << 63 for r in b.collect())


def test_slot_rows_are_made_after_the_last_shuffle(spark, monkeypatch):
    """Blocks smaller than a room's words give the same slots; nothing is shuffled once the words are opened."""
    monkeypatch.setattr(M, "SLOT_BLOCK", 2)
    conns = spark.createDataFrame([(1, 37 * i) for i in range(60)] + [(1, None), (2, 5)], "room_id long, person_id long")
    tasks = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 20), (3, 30)], "room_id long, task_id long")
    votes = spark.createDataFrame([(1, 10, 37 * i) for i in range(0, 60, 3)] + [(1, 11, 1), (1, 11, None), (2, 20, 5)],
                                  "room_id long, task_id long, person_id long")
    b = M.slot_bitmaps(conns, tasks, votes)
    want = [(1, 10, 37 * i) for i in range(60) if i % 3] + 2 * [(1, 11, 37 * i) for i in range(60)]
    assert rows_of(M.slots_of(b), "room_id", "task_id", "person_id") == sorted(want, key=repr)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join")


def shuffled_rows(df):
    """Rows that the exchanges of a plan have written, once it has run."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        n += p.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        inner = p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan() if kind.endswith("QueryStageExec") else None
        todo += [inner] if inner else [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_no_slot_row_per_task_and_block_is_shuffled(spark, monkeypatch):
    """With 18 blocks a room, what is shuffled stays near the rows of members, tasks and votes, and the slots are right."""
    monkeypatch.setattr(M, "SLOT_BLOCK", 2)
    conns = spark.createDataFrame([(1, 37 * i) for i in range(60)], "room_id long, person_id long")
    tasks = spark.createDataFrame([(1, i) for i in range(100)], "room_id long, task_id long")
    votes = spark.createDataFrame([(1, i, 37 * (i % 60)) for i in range(100)], "room_id long, task_id long, person_id long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        b = M.slot_bitmaps(conns, tasks, votes)
        assert shuffled_rows(b) < 1000 < 100 * 18
        assert M.slots_of(b).count() == 100 * 59
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_slots_do_not_depend_on_how_a_room_is_dealt_out(spark, monkeypatch):
    """Several groups of blocks and shares of tasks, repeated and missing keys, ids below zero and beyond a double's digits."""
    far = 2**60 + 7
    conns = spark.createDataFrame([(1, 37 * i - 500) for i in range(60)] + [(1, -500), (1, None), (None, 3), (2, 5), (2, 6), (2, far)],
                                  "room_id long, person_id long")
    tasks = spark.createDataFrame([(1, i) for i in range(20)] + [(1, 3), (2, 3), (2, None), (None, 4), (9, 1)], "room_id int, task_id long")
    votes = spark.createDataFrame([(1, i, 37 * j - 500) for i in range(0, 20, 2) for j in range(i, 60, 3)]
                                  + [(2, 3, 6), (1, 3, 6), (2, 3, far), (2, None, 5), (None, 4, 3), (1, 3, None)],
                                  "room_id long, task_id long, person_id long")
    whole = M.slot_bitmaps(conns, tasks, votes)
    assert whole.schema["room_id"].dataType.simpleString() == "int"
    want = rows_of(whole)
    seen = {(r[0], r[1]): 0 for r in want}
    for r in want:
        seen[r[0], r[1]] += r[4]
    assert seen[1, 1] == 60 and seen[1, 0] == 40 and seen[1, 3] == 120 and seen[2, 3] == 1 and seen[2, None] == 3 and len(seen) == 22
    for name, n in (("SLOT_BLOCK", 2), ("SLOT_GROUP", 2), ("SLOT_TASKS", 3)):
        monkeypatch.setattr(M, name, n)
        assert rows_of(M.slot_bitmaps(conns, tasks, votes)) == want


def test_view_files_round_trip_and_quarantine(spark):
    snap = spark.createDataFrame([
        (1, 1, None, 'A "quoted" <room> & more', [(1, "ann"), (2, "b<c")],
         [(1, "t", True, False, 5, None, False, [(1, True, 8), (2, False, 0)]), (2, "u & v", False, True, 3, None, False, [])]),
        (2, 1, "UnknownRoom", None, None, None)],
        "room_id long, page int, error string, NameRoom string, Persons array<struct<Id:int,UserName:string>>, Tasks array<struct<Id:int,"
        "NameTask:string,Completed:boolean,IsCurrentActive:boolean,TimeDiscussion:int,Median:decimal(9,2),Continued:boolean,"
        "PersonTask:array<struct<PersonId:int,Vote:boolean,Score:int>>>>")
    folder = tempfile.mkdtemp(prefix="estimark-xml-", dir="/tmp") + "/views"
    XF.write_views(snap, folder)
    views, bad = XF.read_views(spark, folder)
    assert rows_of(views.select(*snap.columns)) == rows_of(snap) and bad.count() == 0
    with open(f"{folder}/part-broken.xml", "w") as f:
        f.write('<Rooms><Room _RoomId="3" RoomId="3"><Tasks><Task Id="1"></Tasks></Room><Room RoomId="4" Page="1" Error="UnknownRoom"/></Rooms>')
    views, bad = XF.read_views(spark, folder)
    assert sorted(r["room_id"] for r in views.collect()) == [1, 2, 4] and [r["reason"] for r in bad.collect()] == ["bad_xml"]


def test_sql_functions(spark):
    register_functions(spark)
    lists = {"ok": '<tasks><task name="a" time-discussion="3"/></tasks>', "empty": "<tasks/>", "zero": '<tasks><task name="a" time-discussion="0"/></tasks>',
             "late": '<tasks><task name="a" time-discussion="3"/><task name=" " time-discussion="3"/></tasks>', "broken": '<tasks><task name="a"',
             "eleven": '<tasks><task name="a" time-discussion="11"/></tasks>', "none": '<tasks><task name="a"/></tasks>'}
    df = spark.createDataFrame(list(lists.items()), "k string, x string")
    got = {r["k"]: r["bad"] for r in spark.sql("SELECT k, is_null_or_empty(x) AS bad FROM {t}", t=df).collect()}
    assert got == {"ok": False, "empty": False, "zero": True, "late": True, "broken": True, "eleven": True, "none": True}
    reqs = df.selectExpr("xxhash64(k) AS request_id", "'r' AS name_room", "x AS tasks_xml", "k")
    valid = {r["k"]: r["is_valid"] for r in RQ.room_request_valid(reqs).join(reqs.select("request_id", "k"), "request_id").collect()}
    assert valid == {k: not v for k, v in got.items()}
    assert spark.sql("SELECT same_key('Ann ', 'aNN'), same_key('a', 'b')").first() == (True, False)
    assert rows_of(spark.sql("SELECT k, t.* FROM {d} d, LATERAL room_tasks(d.x) t WHERE k IN ('ok', 'late')", d=df)) == [
        ("late", 0, "a", 3), ("late", 1, "", 3), ("ok", 0, "a", 3)]


def test_error_table_counts_each_micro_batch(spark):
    from estimark.streaming import error_counts as EC
    src = tempfile.mkdtemp(prefix="estimark-errors-", dir="/tmp")
    rows = [(1, AT(0), i, 1, m) for i, m in enumerate(["a==b==c", "Nope==x", "ChangeVote==<broken", "ChangeGetVM", None, "a==b==c"])]
    log = spark.createDataFrame(rows, "room_id long, ts timestamp_ntz, event_id long, person_no long, msg string")
    for i, part in enumerate(("event_id < 3", "event_id >= 3")):
        log.filter(part).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", "1").parquet(f"{src}/*")
    out, counts = EC.parse_with_error_table(spark, stream)
    assert rows_of(counts) == [("bad_arity", 2), ("bad_xml", 1), ("no_message", 1), ("unknown_kind", 1)]
    assert rows_of(out.filter("reason IS NOT NULL").groupBy("reason").count()) == rows_of(counts)


def test_created_rooms_have_creator_and_stable_guid(spark):
    reqs = spark.createDataFrame([(1, "r", '<tasks><task name="a" time-discussion="3"/></tasks>', "ANN@x.io ", AT(0)),
                                  (2, "", "<tasks/>", "ann@x.io", AT(0)), (3, "s", "<tasks/>", "who@x.io", AT(1))],
                                 "request_id long, name_room string, tasks_xml string, creator_email string, ts timestamp_ntz")
    persons = spark.createDataFrame([(9, "ann@x.io")], "person_id long, email string")
    got = RQ.created_rooms(reqs, persons)
    assert rows_of(got, "room_id", "name_room", "creator", "is_active") == [(1, "r", 9, True), (3, "s", None, True)]
    guids = [r["room_guid"] for r in got.collect()]
    assert len(set(guids)) == 2 and all(len(g) == 36 for g in guids)
    assert rows_of(got) == rows_of(RQ.created_rooms(reqs, persons))


def test_wide_grid_pages(spark):
    from estimark.operators.grid import wide_pages
    cells = spark.createDataFrame([(1, 10, p, p * 10) for p in range(1, 6)] + [(1, 11, 1, 7)], "room_id long, task_id long, person_ord int, score int")
    medians = spark.createDataFrame([(10, 3.0)], "task_id long, median double")
    got = wide_pages(cells, medians, width=2, pages=2)
    assert rows_of(got, "task_id", "page", "person_1", "person_2", "median") == [
        (10, 1, 10, 20, 3.0), (10, 2, 30, 40, 3.0), (11, 1, 7, None, None)]

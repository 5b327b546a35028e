from pyspark.sql import functions as F

from conftest import rows_of

from estimark.functions import rules as R
from estimark.operators import requests as RQ
from estimark.sources.messages import parse_messages
from estimark.sources.xml import bad_task_xml, parse_change, shred_tasks


def _req(spark, rows):
    return spark.createDataFrame(rows, "request_id long, name_room string, tasks_xml string")


def _valid(spark, rows, strict=False):
    return dict(rows_of(RQ.room_request_valid(_req(spark, rows), strict=strict), "request_id", "is_valid"))


def test_room_request_rules(spark):
    ok = '<tasks><task name="a" time-discussion="3"/><task name="b" time-discussion="10"/></tasks>'
    got = _valid(spark, [
        (1, "Room", ok), (2, "  ", ok),
        (3, "Room", '<tasks><task name="" time-discussion="3"/></tasks>'),
        (4, "Room", '<tasks><task name="a" time-discussion="0"/></tasks>'),
        (5, "Room", '<tasks><task name="a" time-discussion="11"/></tasks>'),
        (6, "Room", '<tasks><task name="a"/></tasks>'),
        (7, "Room", "<tasks></tasks>"),
        (8, "Room", "<tasks><task name="),
        (9, "Room", ok.replace('"a"', '"ok"') + ""),
    ])
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True, 8: False, 9: True}


def test_ui_rule_is_stricter(spark):
    x = '<tasks><task name="a" time-discussion="3"/></tasks>'
    assert _valid(spark, [(1, "Room", x)], strict=True) == {1: False}
    assert _valid(spark, [(1, "Room", x)]) == {1: True}


def test_empty_list_accepted_broken_quarantined(spark):
    reqs = _req(spark, [(7, "Room", "<tasks></tasks>"), (8, "Room", "<tasks><task name=")])
    rooms, tasks = RQ.create_rooms(reqs)
    assert rows_of(rooms, "room_id") == [(7,)] and tasks.count() == 0
    assert rows_of(bad_task_xml(reqs)) == [(8, "bad_xml")]


def test_shred_positions_and_distinct_names(spark):
    x = ('<tasks><task name="a" time-discussion="3"/><task name="b" time-discussion="4"/>'
         '<task name="a" time-discussion="9"/></tasks>')
    s = shred_tasks(_req(spark, [(1, "R", x)]))
    assert rows_of(s) == [(1, 0, "a", 3), (1, 1, "b", 4), (1, 2, "a", 9)]
    assert rows_of(RQ.distinct_task_names(s), "pos", "name", "minutes") == [(0, "a", 3), (1, "b", 4)]


def test_message_arity_and_kinds(spark):
    log = spark.createDataFrame([("a==b==c",), ("Bogus==x",), ("StopVoting==",), ("ChangeGetVM",)], "msg string")
    got = rows_of(parse_messages(log), "msg", "kind", "payload", "reason")
    assert got == [("Bogus==x", "Bogus", "x", "unknown_kind"), ("ChangeGetVM", "ChangeGetVM", "", None),
                   ("StopVoting==", "StopVoting", "", None), ("a==b==c", None, None, "bad_arity")]


def test_change_payloads(spark):
    p = spark.createDataFrame([
        ('<Change><AddVote vote="1" score="8"/></Change>',),
        ('<Change><StartVoting taskId="2" isCurrentActive="1"/><StartVoting taskId="3"/></Change>',),
        ("<Change><AddVote vote=",), ("",)], "payload string")
    got = [r["c"] for r in p.select(parse_change(F.col("payload")).alias("c")).collect()]
    assert (got[0]["vote"], got[0]["score"], got[0]["task_ordinal"], got[0]["bad_xml"]) == (True, 8, None, False)
    assert (got[1]["task_ordinal"], got[1]["score"]) == (2, None)
    assert got[2]["bad_xml"] is True and got[3]["bad_xml"] is False


def _check(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_email_rule(spark):
    assert _check(spark, R.email_valid, ["a@bc.io", "a@bc.io\n", "a#b@bc.io", None]) == [True, False, False, False]


def test_password_rule(spark):
    assert _check(spark, R.password_valid, ["abcde1", "abcdef", "a1" * 12 + "x", "abc de1", "ab\\cd]1"]) == [
        True, False, False, False, True]


def test_username_rule(spark):
    assert _check(spark, R.username_valid, ["abc", "ab", "ab_c", "x" * 24, "x" * 25]) == [True, False, False, True, False]

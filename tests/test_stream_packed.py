"""Packed blocks of commands, changes and views hold what the plain processors emit; plain changes are read as the parser does."""

import json
import random

from pyspark.sql import functions as F
from test_fold_random import SENTINELS, Handle, _random_log

from estimark.sources.xml import parse_change, with_change
from estimark.streaming import room_fold as RF


def _commands(rows):
    import datetime as dt

    from pyspark.sql import Row
    return [Row(room_id=1, at=dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), us=60_000_000 * minute, event_id=i, person_no=person,
                kind=kind, start_task=10 * arg if kind == "StartVoting" and arg < 4 else None, minutes=3 if kind == "StartVoting" else None,
                has_slot=person < 3, vote=True if kind == "ChangeVote" else None, score=arg if kind == "ChangeVote" else None,
                is_card=arg not in SENTINELS) for i, (_, minute, person, kind, arg) in enumerate(rows)]


def _on(processor, state, rows):
    processor.init(state)
    return list(processor.handleInputRows((1,), iter(rows), None))


def test_packed_processors_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(RF, "BLOCK", 7)
    commands = _commands(_random_log(3, [1]))
    states = [Handle() for _ in range(4)]
    for lo, hi in ((0, 25), (25, 26), (26, len(commands))):
        got = random.Random(lo).sample(commands[lo:hi], hi - lo)
        plain = _on(RF.RoomFold(), states[0], got)
        views = _on(RF.RoomView(), states[1], [r for r in plain if r.what == "change"])
        packed = _on(RF.PackedRoomFold(), states[2], [
            (1, r.at, json.dumps({k: v for k, v in r.asDict().items() if v is not None and k not in ("room_id", "at")})) for r in got])
        packed_views = _on(RF.PackedRoomView(), states[3], [tuple(r) for r in packed])
        for want, blocks in ((plain, packed), (views, packed_views)):
            rows = [r for b in blocks for r in json.loads(b.rows)]
            assert all(len(json.loads(b.rows)) <= 7 for b in blocks)
            drop = lambda d: {k: v for k, v in d.items() if v is not None and k != "at"}
            assert [drop(r) for r in rows] == [drop(r.asDict()) for r in want]
    assert states[0].values == states[2].values and states[1].values == states[3].values
    assert states[0].timers == states[2].timers


def test_plain_changes_equal_the_parser(spark):
    vote, start = '<Change><AddVote vote="{}" score="{}"/></Change>', '<Change><StartVoting taskId="{}" isCurrentActive="1"/></Change>'
    texts = ["", "  ", None, "<Change/>", vote.format(1, 5), vote.format(0, "05"), vote.format(-1, -5), vote.format(1, 9999999999),
             vote.format("", ""), vote.format(" 1", "5 "), vote.format(1, "x"), vote.format(1, 5) + "\n", " " + vote.format(1, 5),
             '<Change><AddVote score="5" vote="1"/></Change>', '<Change><AddVote vote="1" score="5"/><AddVote vote="0" score="8"/></Change>',
             "<Change><AddVote vote=", start.format(2), start.format("02"), start.format("a"), '<Change><StartVoting taskId="3"/></Change>',
             "garbage", start.format(1) + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    got = {r["i"]: r["__c"] for r in with_change(df).collect()}
    want = {r["i"]: r["c"] for r in df.select("i", parse_change(F.col("payload")).alias("c")).collect()}
    assert got == want

"""The window-based fold against a one-event-at-a-time simulation of the rules."""

import random
from decimal import ROUND_HALF_UP, Decimal

from conftest import cmds, rows_of

from estimark.operators import fold as FO
from estimark.sources import bindings as B

SENTINELS = {0, 777, 999}
CARDS = [0, 1, 2, 3, 5, 8, 13, 20, 40, 777, 999]


def _median(scores):
    xs = sorted(s for s in scores if s not in SENTINELS)
    if not xs:
        return None
    n = len(xs)
    m = xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2
    return Decimal(str(m)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)


def simulate(rows, ordinals, members):
    """rows as in conftest.cmds, event_id = position; returns the fold's outputs."""
    out = {"results": {}, "late": [], "flags": [], "votes": {}, "segments": {}, "active": {}}
    by_room = {}
    for i, r in enumerate(rows):
        by_room.setdefault(r[0], []).append((r[1], i, r))
    for room, evs in by_room.items():
        open_task, opened = None, False
        votes_of = {}  # task -> person -> score (latest)
        for _, eid, (_, _, person, kind, arg) in sorted(evs):
            if kind == "StartVoting":
                task = ordinals.get((room, arg))
                if opened and open_task is not None:
                    out["flags"].append((eid, "overlapping_start"))
                if task is None:
                    out["flags"].append((eid, "unknown_ordinal"))
                elif (room, task) in out["results"]:
                    out["flags"].append((eid, "already_completed"))
                if task is not None:
                    out["segments"][(room, task)] = out["segments"].get((room, task), 0) + 1
                open_task, opened = task, True
            elif kind == "StopVoting":
                if open_task is not None:
                    if (room, open_task) not in out["results"]:
                        out["results"][(room, open_task)] = _median(votes_of.get(open_task, {}).values())
                    out.setdefault("completed", set()).add((room, open_task))
                open_task = None
            elif kind == "ChangeVote":
                if open_task is None:
                    out["late"].append((eid, "no_active_task"))
                elif (room, person) not in members:
                    out["late"].append((eid, "no_slot"))
                else:
                    done = (room, open_task) in out["results"]
                    if not done:
                        votes_of.setdefault(open_task, {})[person] = arg
                    out["votes"][(room, open_task, person)] = arg
        out["active"][room] = open_task
    return out


def _random_log(seed, rooms):
    rnd = random.Random(seed)
    rows, minute = [], 0
    for _ in range(60 * len(rooms)):
        minute += rnd.randint(0, 2)
        room = rnd.choice(rooms)
        kind = rnd.choices(["StartVoting", "StopVoting", "ChangeVote", "ChangeGetVM", "FinishPlanning"],
                           [3, 2, 8, 1, 1])[0]
        arg = rnd.randint(1, 4) if kind == "StartVoting" else rnd.choice(CARDS) if kind == "ChangeVote" else None
        rows.append((room, minute, rnd.randint(0, 3), kind, arg))
    return rows


import pytest  # noqa: E402


@pytest.mark.parametrize("seed", [5, 17, 99])
def test_fold_equals_sequential_rules(spark, seed):
    rooms = list(range(1, 9))
    rows = _random_log(seed, rooms)
    ordinals = {(r, k): 100 * r + 10 * k for r in rooms for k in (1, 2, 3)}   # ordinal 4 is unknown
    members = {(r, p) for r in rooms for p in (0, 1, 2)}                        # person 3 has no slot
    exp = simulate(rows, ordinals, members)

    o = spark.createDataFrame([(r, t, k) for (r, k), t in ordinals.items()], "room_id long, task_id long, task_ord int")
    m = spark.createDataFrame(sorted(members), "room_id long, person_no long")
    f = FO.fold(cmds(spark, rows), o, m, chunk_unit="minute")
    d = B.b_dictionary(spark)

    assert {(r, t): med for r, t, med in rows_of(FO.stop_voting(f, d), "room_id", "task_id", "median")} == exp["results"]
    assert rows_of(FO.late_votes(f), "event_id", "reason") == sorted(exp["late"], key=repr)
    assert rows_of(FO.segment_flags(f), "event_id", "reason") == sorted(exp["flags"], key=repr)
    assert {(r, t, p): s for r, t, p, s in rows_of(FO.apply_votes(f), "room_id", "task_id", "person_no", "score")} \
        == exp["votes"]
    state = {(r, t): (a, c, n) for r, t, a, c, n in
             rows_of(FO.room_state_fold(f, d), "room_id", "task_id", "on_active", "completed", "n_segments")}
    assert state == {(r, t): (exp["active"].get(r) == t, (r, t) in exp.get("completed", set()), n)
                     for (r, t), n in exp["segments"].items()}


class Handle:
    """State of one key, held in memory: what the engine's store does for a processor."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, schema):
        held = self.values

        class Value:
            exists = staticmethod(lambda: name in held)
            get = staticmethod(lambda: held[name])
            update = staticmethod(lambda v: held.__setitem__(name, tuple(v)))

        return Value()

    def getMapState(self, name, key, value):
        held = self.values.setdefault(name, {})

        class Map:
            containsKey = staticmethod(held.__contains__)
            getValue = staticmethod(held.__getitem__)
            updateValue = staticmethod(lambda k, v: held.__setitem__(k, tuple(v)))

        return Map()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def processed(rows, ordinals, members, cuts, minutes=3):
    """Rows that the two chained processors emit, batch by batch."""
    import datetime as dt

    from pyspark.sql import Row

    from estimark.streaming.room_fold import RoomFold, RoomView
    changes, views, handles = [], [], {}
    bounds = [0, *cuts, len(rows)]
    for lo, hi in zip(bounds, bounds[1:]):
        by_room = {}
        for i in range(lo, hi):
            room, minute, person, kind, arg = rows[i]
            task = ordinals.get((room, arg)) if kind == "StartVoting" else None
            by_room.setdefault(room, []).append(Row(
                room_id=room, at=dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), us=60_000_000 * minute, event_id=i, person_no=person,
                kind=kind, start_task=task, minutes=minutes if task else None, has_slot=(room, person) in members,
                vote=True if kind == "ChangeVote" else None, score=arg if kind == "ChangeVote" else None, is_card=arg not in SENTINELS))
        for room, got in by_room.items():
            random.Random(lo).shuffle(got)
            fold_state, view_state = handles.setdefault(room, (Handle(), Handle()))
            f, v = RoomFold(), RoomView()
            f.init(fold_state)
            v.init(view_state)
            out = list(f.handleInputRows((room,), iter(got), None))
            changes += out
            views += v.handleInputRows((room,), iter([r for r in out if r.what == "change"]), None)
    return changes, views, handles


@pytest.mark.parametrize("seed,cuts", [(5, (60, 200, 210, 400)), (17, (1, 2, 250)), (31, tuple(range(1, 480)))])
def test_stream_processor_equals_sequential_rules(seed, cuts):
    from estimark.streaming.room_fold import DIGEST, cell_hash
    rooms = list(range(1, 9))
    rows = _random_log(seed, rooms)
    ordinals = {(r, k): 100 * r + 10 * k for r in rooms for k in (1, 2, 3)}
    members = {(r, p) for r in rooms for p in (0, 1, 2)}
    exp = simulate(rows, ordinals, members)
    changes, views, _ = processed(rows, ordinals, members, cuts)
    last = {}
    for r in changes:
        if r.what == "task" and r.seq >= last.get((r.room_id, r.task_id), r).seq:
            last[r.room_id, r.task_id] = r
    assert {k: (r.on_active, r.completed, r.n_segments) for k, r in last.items()} == {
        (r, t): (exp["active"].get(r) == t, (r, t) in exp.get("completed", set()), n) for (r, t), n in exp["segments"].items()}
    assert {k: r.median for k, r in last.items() if r.completed} == {k: None if m is None else float(m) for k, m in exp["results"].items()}
    flags = [(r.event_id, f) for r in changes if r.what == "change" for f in r.flags.split(",") if f]
    assert sorted(flags) == sorted(exp["late"] + exp["flags"])
    votes = {}
    for r in sorted((r for r in changes if r.what == "change"), key=lambda r: r.seq):
        if r.kind == "ChangeVote" and not r.flags:
            votes[r.room_id, r.task_id, r.person_no] = r.score
    assert votes == exp["votes"]
    # every view digest is that of the view built from scratch from the commands up to there
    assert len(views) == len(rows)
    for r in random.Random(seed).sample(views, 60):
        upto = [x for i, x in enumerate(rows) if i <= r.event_id and x[0] == r.room_id]
        now = simulate(upto, ordinals, members)
        total = sum(cell_hash(f"v|{t}|{p}|true|{s}") for (_, t, p), s in now["votes"].items())
        total += sum(cell_hash(f"t|{t}|" + ("none" if m is None else f"{m:.2f}")) for (_, t), m in now["results"].items())
        active = now["active"][r.room_id]
        total += cell_hash("a|" + ("none" if active is None else str(active)))
        total += cell_hash("f") if any(x[3] == "FinishPlanning" for x in upto) else 0
        assert (r.digest, r.n_cells, r.sum_scores, r.n_completed) == (
            total % DIGEST, len(now["votes"]), sum(now["votes"].values()), len(now["results"]))


def test_timers_of_the_time_box():
    """A deadline is a timer while its segment is open; a segment closed too late is reported at its end, once."""
    from types import SimpleNamespace

    from estimark.streaming.room_fold import RoomFold
    ordinals, members = {(1, 1): 10, (1, 2): 20}, {(1, 0)}
    log = [(1, 0, 0, "StartVoting", 1), (1, 3, 0, "StopVoting", None),       # on time to the second: no overrun
           (1, 5, 0, "StartVoting", 2), (1, 9, 0, "StartVoting", 1),         # four minutes of three: overrun at its end
           (1, 20, 0, "ChangeGetVM", None)]
    changes, _, handles = processed(log, ordinals, members, (2, 3))
    assert [(r.task_id, r.seg, r.us) for r in changes if r.what == "overrun"] == [(20, 3, 300_000_000)]
    h = handles[1][0]
    assert h.timers == {1000 * (9 * 60 + 180 + 1)}  # the open segment's
    f = RoomFold()
    f.init(h)
    fire = lambda ms: list(f.handleExpiredTimer((1,), None, SimpleNamespace(getExpiryTimeInMs=lambda: ms)))
    assert fire(5) == [] and [(r.what, r.task_id, r.seg) for r in fire(1000 * 721)] == [("overrun", 10, 4)]
    assert fire(1000 * 721) == []

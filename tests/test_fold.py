from decimal import Decimal

from conftest import cmds, rows_of

from estimark.operators import fold as FO
from estimark.sources import bindings as B


def _ordinals(spark, tasks=((1, 10), (1, 12), (1, 40))):
    rows = []
    per = {}
    for room, task in sorted(tasks):
        per[room] = per.get(room, 0) + 1
        rows.append((room, task, per[room]))
    return spark.createDataFrame(rows, "room_id long, task_id long, task_ord int")


def _fold(spark, rows, **kw):
    return FO.fold(cmds(spark, rows), _ordinals(spark), **kw)


def test_ordinal_resolves_to_task(spark):
    f = _fold(spark, [(1, 0, 0, "StartVoting", 2)])
    assert rows_of(FO.task_by_ordinal(f), "task_ordinal", "task_id") == [(2, 12)]


def test_vote_without_active_task_is_dropped(spark):
    f = _fold(spark, [(1, 0, 5, "ChangeVote", 3), (1, 1, 0, "StartVoting", 1), (1, 2, 5, "ChangeVote", 5),
                      (1, 3, 0, "StopVoting", None), (1, 4, 5, "ChangeVote", 8)])
    assert rows_of(FO.late_votes(f), "score", "reason") == [(3, "no_active_task"), (8, "no_active_task")]
    assert rows_of(FO.stop_voting(f, B.b_dictionary(spark)), "task_id", "median") == [(10, Decimal("5.00"))]


def test_two_starts_no_stop(spark):
    f = _fold(spark, [(1, 0, 0, "StartVoting", 1), (1, 1, 0, "StartVoting", 2), (1, 2, 5, "ChangeVote", 8)])
    assert rows_of(FO.votes_asof_active_task(f), "score", "task_id") == [(8, 12)]
    flags = rows_of(FO.segment_flags(f), "event_id", "reason")
    assert flags == [(1, "overlapping_start")]


def test_second_round_of_completed_task(spark):
    f = _fold(spark, [(1, 0, 0, "StartVoting", 1), (1, 1, 5, "ChangeVote", 3), (1, 2, 0, "StopVoting", None),
                      (1, 3, 0, "StartVoting", 1), (1, 4, 5, "ChangeVote", 13), (1, 5, 0, "StopVoting", None)])
    assert rows_of(FO.stop_voting(f, B.b_dictionary(spark)), "task_id", "median") == [(10, Decimal("3.00"))]
    assert rows_of(FO.segment_flags(f), "event_id", "reason") == [(3, "already_completed")]
    # the Votes table still takes the later vote (the task was active again)
    assert rows_of(FO.apply_votes(f), "task_id", "score") == [(10, 13)]


def test_stop_with_nothing_active(spark):
    f = _fold(spark, [(1, 0, 0, "StopVoting", None), (1, 1, 0, "StopVoting", None)])
    assert FO.stop_voting(f, B.b_dictionary(spark)).count() == 0


def test_unknown_ordinal_ends_segment(spark):
    f = _fold(spark, [(1, 0, 0, "StartVoting", 1), (1, 1, 0, "StartVoting", 9), (1, 2, 5, "ChangeVote", 5),
                      (1, 3, 0, "StopVoting", None)])
    assert rows_of(FO.late_votes(f), "reason") == [("no_active_task",)]
    assert FO.stop_voting(f, B.b_dictionary(spark)).count() == 0
    assert ("unknown_ordinal" in [r[0] for r in rows_of(FO.segment_flags(f), "reason")])


def test_last_vote_per_person_until_stop(spark):
    f = _fold(spark, [(1, 0, 0, "StartVoting", 3), (1, 1, 5, "ChangeVote", 3), (1, 2, 6, "ChangeVote", 5),
                      (1, 3, 5, "ChangeVote", 13), (1, 4, 7, "ChangeVote", 999), (1, 5, 0, "StopVoting", None),
                      (1, 6, 6, "ChangeVote", 40)])
    assert rows_of(FO.stop_voting(f, B.b_dictionary(spark)), "task_id", "median") == [(40, Decimal("9.00"))]


def test_no_slot(spark):
    members = spark.createDataFrame([(1, 5)], "room_id long, person_no long")
    f = _fold(spark, [(1, 0, 0, "StartVoting", 1), (1, 1, 5, "ChangeVote", 3), (1, 2, 6, "ChangeVote", 5)],
              members=members)
    assert rows_of(FO.late_votes(f), "person_no", "reason") == [(6, "no_slot")]


def test_finish_room(spark):
    rooms = spark.createDataFrame([(1, True), (2, True)], "room_id long, is_active boolean")
    c = cmds(spark, [(1, 5, 0, "FinishPlanning", None), (1, 9, 0, "FinishPlanning", None)])
    got = {r["room_id"]: (r["is_active"], r["deleted"] is not None) for r in FO.finish_room(rooms, c).collect()}
    assert got == {1: (False, True), 2: (True, False)}


def test_stop_after_finish(spark):
    f = _fold(spark, [(1, 0, 0, "StartVoting", 1), (1, 1, 0, "FinishPlanning", None), (1, 2, 5, "ChangeVote", 3)],
              stop_after_finish=True)
    assert rows_of(FO.late_votes(f), "reason") == [("room_finished",)]


def test_task_status_and_time_box(spark):
    f = _fold(spark, [(1, 0, 0, "StartVoting", 1), (1, 7, 0, "StopVoting", None), (1, 8, 0, "StartVoting", 2)])
    tasks = spark.createDataFrame([(1, 10, 5), (1, 12, 3), (1, 40, 1)], "room_id long, task_id long, minutes int")
    assert rows_of(FO.task_status(tasks, f), "task_id", "status") == [(10, "completed"), (12, "active"), (40, "blocked")]
    box = {r["task_id"]: r for r in FO.time_box(f, tasks).collect()}
    assert box[10]["elapsed_s"] == 420 and box[10]["overrun"] is True and box[10]["countdown"] == "0-m: 0-sec"
    assert box[12]["end_ts"] is None and box[12]["remaining_s"] is None


def test_order_independence(spark):
    rows = [(1, 0, 0, "StartVoting", 1), (1, 1, 5, "ChangeVote", 3), (1, 2, 6, "ChangeVote", 8),
            (1, 3, 0, "StopVoting", None), (2, 0, 0, "StartVoting", 1), (2, 1, 5, "ChangeVote", 2)]
    a = FO.room_state_fold(_fold(spark, rows), B.b_dictionary(spark))
    c = cmds(spark, rows)
    b = FO.room_state_fold(FO.fold(c.orderBy(c.event_id.desc()).repartition(3), _ordinals(spark)),
                           B.b_dictionary(spark))
    assert rows_of(a) == rows_of(b)


def test_chunking_does_not_change_the_fold(spark):
    """The running marker count is computed per time chunk with carries; any
    chunk size must give the same fold (here: a day vs a minute)."""
    from conftest import SF_SMALL
    from estimark.operators.members import task_ordinals
    from estimark.plans import q_fold
    c = q_fold.commands(spark, SF_SMALL)
    o = task_ordinals(B.b_tasks(spark, SF_SMALL))
    m = q_fold.log_members(spark, SF_SMALL)
    a = FO.fold(c, o, m, chunk_unit="day")
    b = FO.fold(c, o, m, chunk_unit="minute")
    assert rows_of(a.events.select("event_id", "seg")) == rows_of(b.events.select("event_id", "seg"))
    d = B.b_dictionary(spark)
    assert rows_of(FO.room_state_fold(a, d)) == rows_of(FO.room_state_fold(b, d))


def test_creator_only(spark):
    creators = spark.createDataFrame([(1, 0)], "room_id long, person_no long")
    f = _fold(spark, [(1, 0, 9, "StartVoting", 1), (1, 1, 0, "StartVoting", 2), (1, 2, 5, "ChangeVote", 8),
                      (1, 3, 9, "StopVoting", None), (1, 4, 0, "StopVoting", None)], creators=creators)
    assert rows_of(f.rejected, "event_id", "reason") == [(0, "not_creator"), (3, "not_creator")]
    assert rows_of(FO.stop_voting(f, B.b_dictionary(spark)), "task_id", "median") == [(12, Decimal("8.00"))]
    assert rows_of(FO.segment_flags(f), "reason") == []

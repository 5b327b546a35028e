"""The per-room fold of the change log: Start / Stop / Vote / Finish.

Rules (per room, ordered by ts, event_id):

1. ``StartVoting(k)`` resolves ordinal k to a task of the room, opens a
   segment for it and ends the open one (reason ``overlapping_start``).  An
   unknown ordinal opens nothing but still ends the current segment.
2. ``ChangeVote`` counts for the task of the open segment if the sender has a
   slot in the room; else ``no_active_task`` / ``no_slot``.
3. ``StopVoting`` completes the open segment; with none open nothing happens.
4. A task's result is the median of the last vote per person up to the end
   of its first completed segment (sentinel cards left out); later segments
   of the task are flagged ``already_completed``.
5. ``FinishPlanning`` makes the room inactive from then on.
6. ``ChangeGetVM`` changes nothing.

The fold is expressed without a sequential loop: a running count of the
markers (Start/Stop) numbers the segments, so "the open segment at this
moment" is an equi-join on (room_id, seg) with the marker that opened it, and
"the marker that closed it" is the marker numbered seg + 1.  The running
count uses ``scan.running`` (chunked by time), so one busy room is spread over
many tasks.  Everything else is grouping and equi-joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.operators.scan import running, time_chunk
from estimark.operators.votes import task_median
from estimark.session import materialize, materialize_counted

START, STOP, VOTE, FINISH, GETVM = "StartVoting", "StopVoting", "ChangeVote", "FinishPlanning", "ChangeGetVM"


@dataclass
class Fold:
    events: DataFrame      # valid commands with seg
    segments: DataFrame    # one row per marker: opener, closer, open_task, flags
    votes: DataFrame       # ChangeVote rows with their active task and reason
    first_done: DataFrame  # (room_id, task_id, first_seg, completed_ts)
    rejected: DataFrame | None = None  # commands refused before the fold (room_id, event_id, reason)


def resolve_starts(cmds: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Add ``start_task`` to marker rows: the task with ordinal
    ``task_ordinal`` in the room (only for StartVoting rows; NULL when
    unknown).

    Rows that are not a Start get negative join keys that no ordinal has, many
    of them, so they neither match nor pile up in one partition (as NULL keys
    of a busy room would)."""
    o = ordinals.select(F.col("room_id").alias("__room"), F.col("task_ord").alias("__ord"),
                        F.col("task_id").cast("bigint").alias("start_task"))
    is_start = (F.col("kind") == START) & F.col("task_ordinal").isNotNull()
    key = F.when(is_start, F.col("task_ordinal").cast("bigint")).otherwise(
        -1 - F.pmod(F.xxhash64("event_id"), F.lit(4096)))
    j = cmds.withColumn("__k", key).join(o, (F.col("room_id") == F.col("__room")) & (F.col("__k") == F.col("__ord")),
                                         "left")
    return j.drop("__room", "__ord", "__k")


def fold(cmds: DataFrame, ordinals: DataFrame, members: DataFrame | None = None,
         chunk_unit: str | None = None, stop_after_finish: bool = False, checkpoint: bool = True,
         creators: DataFrame | None = None) -> Fold:
    """``cmds``: (room_id, ts, event_id, person_no, kind, task_ordinal, score,
    vote) of well-formed messages.  ``ordinals``: (room_id, task_id, task_ord).
    ``members``: optional (room_id, person_no) holders of a slot in the room.
    ``creators``: optional (room_id, person_no); when given, Start / Stop /
    Finish from anyone else are refused ('not_creator') instead of applied.
    ``chunk_unit``: a time unit to cut busy rooms by, instead of measuring."""
    rejected = None
    if creators is not None:
        c = creators.select("room_id", "person_no").distinct().withColumn("__creator", F.lit(True))
        cmds = cmds.join(c, ["room_id", "person_no"], "left")
        refused = F.col("kind").isin(START, STOP, FINISH) & F.col("__creator").isNull()
        rejected = cmds.filter(refused).select("room_id", "event_id", F.lit("not_creator").alias("reason"))
        cmds = cmds.filter(~refused).drop("__creator")
    is_marker = F.col("kind").isin(START, STOP)
    chunk, rows = time_chunk("ts", chunk_unit) if chunk_unit else None, None
    if checkpoint and chunk is None:
        cmds, rows = materialize_counted(cmds)  # measured, then numbered
    ev = running(cmds.withColumn("__m", is_marker.cast("int")), ["room_id"], ["ts", "event_id"],
                 chunk, {"seg": ("sum", "__m")}, rows=rows).drop("__m")
    if checkpoint:
        ev = materialize(ev)

    # ordinals are looked up for the markers only; the votes take no part
    mk = resolve_starts(ev.filter(is_marker), ordinals).select(
        "room_id", "seg", F.col("kind").alias("opener"), F.col("start_task").alias("mtask"),
        F.col("ts").alias("opened_ts"), F.col("event_id").alias("opened_event"),
        F.col("task_ordinal").alias("opened_ordinal"))
    nxt = mk.select("room_id", (F.col("seg") - 1).alias("seg"), F.col("opener").alias("closer"),
                    F.col("opened_ts").alias("closed_ts"), F.col("opened_event").alias("closed_event"))
    seg = mk.join(nxt, ["room_id", "seg"], "left")
    seg = seg.withColumn("open_task", F.when(F.col("opener") == START, F.col("mtask")))
    seg = seg.withColumn("completed", F.col("open_task").isNotNull() & F.coalesce(F.col("closer") == STOP, F.lit(False)))

    first = (seg.filter("completed").groupBy("room_id", F.col("open_task").alias("task_id"))
             .agg(F.min("seg").alias("first_seg"), F.min_by("closed_ts", "seg").alias("completed_ts")))
    seg = (seg.join(first.withColumnRenamed("task_id", "open_task"), ["room_id", "open_task"], "left")
           .withColumn("already_completed", F.coalesce(F.col("seg") > F.col("first_seg"), F.lit(False)))
           .drop("completed_ts"))
    if checkpoint:
        seg = materialize(seg)

    if stop_after_finish:
        fin = ev.filter(F.col("kind") == FINISH).groupBy("room_id").agg(
            F.min(F.struct("ts", "event_id")).alias("__fin"))
        ev = ev.join(fin, "room_id", "left")
        ev = ev.withColumn("__after_finish", F.coalesce(F.struct("ts", "event_id") > F.col("__fin"), F.lit(False)))
    else:
        ev = ev.withColumn("__after_finish", F.lit(False))

    v = ev.filter(F.col("kind") == VOTE).join(
        seg.select("room_id", "seg", F.col("open_task").alias("task_id")), ["room_id", "seg"], "left")
    if members is not None:
        m = members.select("room_id", "person_no").distinct().withColumn("__slot", F.lit(True))
        v = v.join(m, ["room_id", "person_no"], "left")
    else:
        v = v.withColumn("__slot", F.lit(True))
    reason = (F.when(F.col("__after_finish"), "room_finished").when(F.col("task_id").isNull(), "no_active_task")
              .when(F.col("__slot").isNull(), "no_slot"))
    v = v.withColumn("reason", reason).drop("__slot", "__after_finish")
    return Fold(ev.drop("__after_finish", "__fin"), seg, v, first, rejected)


def valid_votes(f: Fold) -> DataFrame:
    return f.votes.filter(F.col("reason").isNull())


def votes_asof_active_task(f: Fold) -> DataFrame:
    """Every vote with the task active when it arrived (NULL if none)."""
    return f.votes.select("room_id", "event_id", "ts", "person_no", "score", "task_id")


def apply_votes(f: Fold) -> DataFrame:
    """The Votes table after the log: last valid vote per (room, task, person)."""
    best = F.max_by(F.struct("vote", "score"), F.struct("ts", "event_id"))
    return (valid_votes(f).groupBy("room_id", "task_id", "person_no").agg(best.alias("b"))
            .select("room_id", "task_id", "person_no", F.col("b.vote").alias("vote"), F.col("b.score").alias("score")))


def stop_voting(f: Fold, dictionary: DataFrame) -> DataFrame:
    """Task results: for each task's first completed segment, the median of
    the last vote per person up to its end.  (room_id, task_id, completed_ts, median)."""
    vv = valid_votes(f).join(f.first_done.select("room_id", "task_id", "first_seg"), ["room_id", "task_id"])
    vv = vv.filter(F.col("seg") <= F.col("first_seg"))
    last = (vv.groupBy("room_id", "task_id", "person_no")
            .agg(F.max_by("score", F.struct("ts", "event_id")).alias("score")))
    med = task_median(last, dictionary)
    return f.first_done.select("room_id", "task_id", "completed_ts").join(med, ["room_id", "task_id"], "left")


def start_voting(f: Fold) -> DataFrame:
    """Start stamps per task: how often it was started, first and last time."""
    s = f.segments.filter(F.col("open_task").isNotNull())
    return s.groupBy("room_id", F.col("open_task").alias("task_id")).agg(
        F.count(F.lit(1)).alias("n_starts"), F.min("opened_ts").alias("first_started"),
        F.max("opened_ts").alias("last_started"))


def task_by_ordinal(f: Fold) -> DataFrame:
    """Start messages with the ordinal resolved to a task key (NULL if unknown)."""
    return f.segments.filter(F.col("opener") == START).select(
        "room_id", F.col("opened_event").alias("event_id"), F.col("opened_ordinal").alias("task_ordinal"),
        F.col("mtask").alias("task_id"))


def room_state(f: Fold) -> DataFrame:
    """Per room: last segment number and its open task (NULL if none)."""
    last = f.segments.groupBy("room_id").agg(F.max_by("open_task", "seg").alias("active_task"),
                                             F.max("seg").alias("n_markers"))
    return last


def room_has_active(f: Fold) -> DataFrame:
    """Per room of the log: is a task being voted on at the end of the log?"""
    rooms = f.events.select("room_id").distinct()
    return rooms.join(room_state(f), "room_id", "left").select(
        "room_id", F.col("active_task").isNotNull().alias("has_active"))


def markers_only(cmds: DataFrame) -> DataFrame:
    """The commands that number segments: enough for everything but votes."""
    return cmds.filter(F.col("kind").isin(START, STOP))


def rooms_with_active(cmds: DataFrame, ordinals: DataFrame) -> DataFrame:
    """``room_has_active`` straight from the commands: the last marker per room
    (one aggregation with a partial step), a Start of a known task."""
    marker = F.col("kind").isin(START, STOP)
    last = F.max_by(F.struct("kind", "task_ordinal"), F.when(marker, F.struct("ts", "event_id")))
    rooms = cmds.groupBy("room_id").agg(last.alias("m"))
    o = ordinals.select(F.col("room_id").alias("__room"), F.col("task_ord").alias("__ord"))
    started = F.when(F.col("m.kind") == START, F.col("m.task_ordinal").cast("bigint"))
    j = rooms.withColumn("__k", started).join(o, (F.col("room_id") == F.col("__room")) & (F.col("__k") == F.col("__ord")), "left")
    return j.select("room_id", F.col("__room").isNotNull().alias("has_active"))


def room_state_fold(f: Fold, dictionary: DataFrame) -> DataFrame:
    """Final state of every task touched by the log:
    (room_id, task_id, on_active, completed, n_segments, median)."""
    per_task = f.segments.filter(F.col("open_task").isNotNull()).groupBy(
        "room_id", F.col("open_task").alias("task_id")).agg(
        F.count(F.lit(1)).alias("n_segments"), F.bool_or("completed").alias("completed"))
    act = room_state(f).select("room_id", F.col("active_task").alias("task_id"), F.lit(True).alias("on_active"))
    res = stop_voting(f, dictionary).select("room_id", "task_id", "median")
    return (per_task.join(act, ["room_id", "task_id"], "left").join(res, ["room_id", "task_id"], "left")
            .select("room_id", "task_id", F.coalesce("on_active", F.lit(False)).alias("on_active"),
                    "completed", "n_segments", "median"))


def latest_active_task(f: Fold) -> DataFrame:
    """Per room: the most recently started task and whether it is still open."""
    s = f.segments.filter(F.col("open_task").isNotNull())
    best = F.max_by(F.struct("open_task", "opened_ts", "closer"), F.struct("opened_ts", "opened_event"))
    return s.groupBy("room_id").agg(best.alias("b")).select(
        "room_id", F.col("b.open_task").alias("task_id"), F.col("b.opened_ts").alias("started_ts"),
        F.col("b.closer").isNull().alias("still_open"))


def task_status(tasks: DataFrame, f: Fold) -> DataFrame:
    """Per task of ``tasks``: 'active', 'completed', 'blocked' (idle while
    another task of the room is active) or 'idle'."""
    st = room_state(f).select("room_id", "active_task")
    done = f.first_done.select("room_id", "task_id", F.lit(True).alias("__done"))
    j = tasks.select("room_id", "task_id").join(st, "room_id", "left").join(done, ["room_id", "task_id"], "left")
    status = (F.when(F.col("task_id") == F.col("active_task"), "active").when(F.col("__done"), "completed")
              .when(F.col("active_task").isNotNull(), "blocked").otherwise("idle"))
    return j.select("room_id", "task_id", status.alias("status"))


def late_votes(f: Fold) -> DataFrame:
    """Votes that changed nothing, with the reason."""
    return f.votes.filter(F.col("reason").isNotNull()).select(
        "room_id", "event_id", "ts", "person_no", "score", "reason")


def segment_flags(f: Fold) -> DataFrame:
    """Start markers that are quarantined: unknown ordinal, a Start that ends
    an open segment (overlapping), a segment of an already completed task."""
    s = f.segments.filter(F.col("opener") == START)
    prev_open = f.segments.select("room_id", (F.col("seg") + 1).alias("seg"),
                                  F.col("open_task").isNotNull().alias("__prev_open"))
    s = s.join(prev_open, ["room_id", "seg"], "left")
    reasons = [
        (F.col("mtask").isNull(), "unknown_ordinal"),
        (F.coalesce(F.col("__prev_open"), F.lit(False)), "overlapping_start"),
        (F.col("already_completed"), "already_completed"),
    ]
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in reasons]), lambda r: r.isNotNull())
    return s.select("room_id", F.col("opened_event").alias("event_id"), F.explode(found).alias("reason"))


def finish_room(rooms: DataFrame, cmds: DataFrame) -> DataFrame:
    """Rooms after the log: the first FinishPlanning sets ``deleted`` and
    makes the room inactive; the view then reports UnknownRoom."""
    fin = cmds.filter(F.col("kind") == FINISH).groupBy("room_id").agg(F.min("ts").alias("deleted"))
    return rooms.select("room_id", "is_active").join(fin, "room_id", "left").select(
        "room_id", (F.col("is_active") & F.col("deleted").isNull()).alias("is_active"), "deleted")


def time_box(f: Fold, tasks: DataFrame) -> DataFrame:
    """The countdown of each voting segment: deadline = start + minutes; the
    segment's end (NULL while open) gives elapsed and remaining seconds, an
    overrun flag and the 'M-m: S-sec' text of the time left."""
    s = f.segments.filter(F.col("open_task").isNotNull()).select(
        "room_id", "seg", F.col("open_task").alias("task_id"), F.col("opened_ts").alias("start_ts"),
        F.col("closed_ts").alias("end_ts"))
    j = s.join(tasks.select("task_id", "minutes"), "task_id", "left")
    box = F.col("minutes").cast("bigint") * 60
    # whole-second boundaries between the two wall-clock times (no time zone involved)
    elapsed = F.timestamp_diff("SECOND", F.date_trunc("second", F.col("start_ts")),
                               F.date_trunc("second", F.col("end_ts")))
    remaining = F.when(elapsed.isNotNull(), F.greatest(box - elapsed, F.lit(0).cast("bigint")))
    text = F.format_string("%d-m: %d-sec", F.floor(remaining / 60).cast("bigint"), (remaining % 60).cast("bigint"))
    return j.select("room_id", "seg", "task_id", "start_ts", "end_ts", "minutes",
                    F.timestamp_add("SECOND", box, F.col("start_ts")).alias("deadline"),
                    elapsed.alias("elapsed_s"), remaining.alias("remaining_s"), (elapsed > box).alias("overrun"),
                    F.when(remaining.isNotNull(), text).alias("countdown"))

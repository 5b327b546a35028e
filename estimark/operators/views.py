"""Room views rebuilt from the folded log state (what a change re-emits)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.operators import fold as FO
from estimark.operators.snapshot import room_snapshot


def views_after_log(f: FO.Fold, rooms: DataFrame, tasks: DataFrame, persons: DataFrame,
                    members: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Nested views of the rooms the log touched: the rooms' tasks with the
    fold's active / completed flags, the applied votes, the task results and
    the members of the log (person_no is the person key).  A room that the log
    finished is hidden: its view is ``UnknownRoom``."""
    rooms = rooms.drop("is_active").join(FO.finish_room(rooms, f.events).select("room_id", "is_active"), "room_id")
    touched = f.events.select("room_id").distinct()
    state = FO.room_state_fold(f, dictionary)
    t = tasks.join(touched, "room_id", "left_semi").join(
        state.select("task_id", "on_active", "completed"), "task_id", "left").select(
        "room_id", "task_id", "name", "minutes", F.coalesce("completed", F.lit(False)).alias("completed"),
        F.coalesce("on_active", F.lit(False)).alias("on_active"))
    votes = FO.apply_votes(f).select("room_id", "task_id", F.col("person_no").cast("bigint").alias("person_id"),
                                     "vote", "score")
    conns = members.select("room_id", F.col("person_no").cast("bigint").alias("person_id"))
    results = FO.stop_voting(f, dictionary).select("task_id", "median")
    return room_snapshot(rooms.join(touched, "room_id", "left_semi"), persons, conns, t, votes, results)

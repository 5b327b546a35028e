"""New-room requests: validate the task list, create rooms and tasks.

A request is (request_id, name_room, tasks_xml).  One bad task rejects the
whole request.  Tasks are shredded row by row; validity is an aggregation by
request joined back on the request key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.functions.rules import is_blank
from estimark.sources.xml import bad_task_xml, shred_tasks


def bad_task(name, minutes):
    """Server rule for one task: empty or NULL name, minutes NULL, 0, or
    outside 0..10.  (NULL minutes slip through three-valued logic in the
    original check and then fail NOT NULL; here they are invalid up front.)"""
    return is_blank(name) | minutes.isNull() | (minutes == 0) | ~minutes.between(0, 10)


def ui_bad_task(name, minutes):
    """Stricter browser rule: name longer than one character, minutes 1..10."""
    return name.isNull() | (F.length(name) <= 1) | minutes.isNull() | ~minutes.between(1, 10)


def room_request_valid(requests: DataFrame, strict: bool = False) -> DataFrame:
    """Per request: (request_id, n_tasks, is_valid).  An empty task list is
    valid (the room gets no tasks); broken XML is invalid.
    ``strict`` applies the browser's rule instead, which also trims the room name."""
    tasks = shred_tasks(requests)
    bad = ui_bad_task if strict else bad_task
    per = tasks.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_tasks"),
                                          F.bool_or(bad(F.col("name"), F.col("minutes"))).alias("any_bad"))
    broken = bad_task_xml(requests).select("request_id", F.lit(True).alias("broken"))
    name_bad = (F.trim(F.col("name_room")) == "") | F.col("name_room").isNull() if strict else is_blank(
        F.col("name_room"))
    j = requests.select("request_id", "name_room").join(per, "request_id", "left").join(broken, "request_id", "left")
    ok = ~name_bad & ~F.coalesce("any_bad", F.lit(False)) & F.col("broken").isNull()
    return j.select("request_id", F.coalesce("n_tasks", F.lit(0)).cast("int").alias("n_tasks"), ok.alias("is_valid"))


def create_rooms(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests become rooms (keyed by the request key) and their tasks
    (ordinal = position + 1).  Returns (rooms, tasks)."""
    valid = room_request_valid(requests).filter("is_valid").select("request_id")
    rooms = requests.join(valid, "request_id", "left_semi").select(
        F.col("request_id").alias("room_id"), "name_room")
    tasks = shred_tasks(requests).join(valid, "request_id", "left_semi").select(
        F.col("request_id").alias("room_id"), (F.col("pos") + 1).cast("int").alias("task_ord"), "name", "minutes")
    return rooms, tasks


def distinct_task_names(tasks: DataFrame, key: str = "request_id") -> DataFrame:
    """The browser keeps task names in a Set: one task per (request, name),
    the first by position, with its own minutes.  ``min_by`` is aggregated
    partially before the shuffle, so a long list is reduced per input
    partition first."""
    first = F.min_by(F.struct("pos", "minutes"), F.col("pos"))
    return tasks.groupBy(key, "name").agg(first.alias("__f")).select(
        key, F.col("__f.pos").alias("pos"), "name", F.col("__f.minutes").alias("minutes"))


def created_rooms(requests: DataFrame, persons: DataFrame) -> DataFrame:
    """The room rows of the valid requests: (room_id, name_room, created, is_active, creator, room_guid).

    ``requests`` also has ``creator_email`` and ``ts``.  The creator is looked up by e-mail under the key collation
    (NULL if nobody has it); the GUID is a digest of the request's key, so a retry gives the same room."""
    from estimark.operators.members import KEY_COLLATION

    valid = room_request_valid(requests).filter("is_valid").select("request_id")
    key = lambda c: F.collate(F.col(c), KEY_COLLATION)
    who = persons.select(key("email").alias("__email"), "person_id").groupBy("__email").agg(F.min("person_id").alias("creator"))
    r = requests.join(valid, "request_id", "left_semi").join(who, key("creator_email") == F.col("__email"), "left")
    h = F.md5(F.concat(F.lit("room|"), F.col("request_id").cast("string")))
    guid = F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return r.select(F.col("request_id").alias("room_id"), "name_room", F.col("ts").alias("created"), F.lit(True).alias("is_active"),
                    "creator", guid.alias("room_guid"))

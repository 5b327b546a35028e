"""XML payloads: task lists of new rooms and the change messages of a room.

Parsed with ``from_xml`` and a fixed schema.  The schemas keep
``_corrupt_record`` so that broken XML can be told apart from an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASKS_SCHEMA = "task ARRAY<STRUCT<_name: STRING, `_time-discussion`: STRING>>, _corrupt_record STRING"
CHANGE_SCHEMA = ("AddVote ARRAY<STRUCT<_vote: STRING, _score: STRING>>, "
                 "StartVoting ARRAY<STRUCT<_taskId: STRING, _isCurrentActive: STRING>>, _corrupt_record STRING")


def _is_corrupt(parsed: Column) -> Column:
    return parsed.isNull() | (F.coalesce(parsed["_corrupt_record"], F.lit("")) != "")


def parsed_once(df: DataFrame, parsed: Column, name: str) -> DataFrame:
    """Add ``parsed`` as column ``name``, evaluated once per row.

    The value goes through a one-element ``inline`` (a Generate node), so a
    later filter on it cannot be pushed below the parse and re-evaluate it,
    and every field read from it shares the one evaluation."""
    return df.select("*", F.inline(F.array(F.struct(parsed.alias(name)))))


def shred_tasks(requests: DataFrame, xml_col: str = "tasks_xml", key: str = "request_id") -> DataFrame:
    """``nodes('/tasks/task')`` + ``value('@name')``, ``value('@time-discussion')``:
    one row per task with its position (0-based).  ``minutes`` is NULL when the
    attribute is missing or not an integer.  Requests whose XML is broken give
    no rows here; see ``bad_task_xml``."""
    p = parsed_once(requests.select(key, xml_col), F.from_xml(xml_col, TASKS_SCHEMA, {"rowTag": "tasks"}), "__x")
    ok = p.filter(~_is_corrupt(F.col("__x")))
    return ok.select(key, F.posexplode(F.col("__x.task")).alias("pos", "__t")).select(
        key, "pos", F.col("__t._name").alias("name"),
        F.col("__t.`_time-discussion`").try_cast("int").alias("minutes"))


def bad_task_xml(requests: DataFrame, xml_col: str = "tasks_xml", key: str = "request_id") -> DataFrame:
    """Requests whose task list does not parse: (key, reason='bad_xml')."""
    p = parsed_once(requests.select(key, xml_col), F.from_xml(xml_col, TASKS_SCHEMA, {"rowTag": "tasks"}), "__x")
    return p.filter(_is_corrupt(F.col("__x"))).select(key, F.lit("bad_xml").alias("reason"))


#: Changes as clients write them, one element with whole numbers: a pattern reads these exactly as the parser does, at a
#: fraction of its cost (a parser a record).  Anything else, however slightly it differs, goes through the parser.
_PLAIN_VOTE = r'\A<Change><AddVote vote="(-?[0-9]{1,9})" score="(-?[0-9]{1,9})"/></Change>\z'
_PLAIN_START = r'\A<Change><StartVoting taskId="(-?[0-9]{1,9})"(?: isCurrentActive="[A-Za-z0-9]+")?/></Change>\z'


def with_change(df: DataFrame, payload: str = "payload", name: str = "__c") -> DataFrame:
    """``df`` plus column ``name`` = ``parse_change(payload)``, parsed once per row and only where there is something that
    the plain forms do not cover."""
    text = F.coalesce(F.col(payload), F.lit(""))
    number = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int")
    df = parsed_once(df, F.struct(number(_PLAIN_VOTE, 1).alias("vote"), number(_PLAIN_VOTE, 2).alias("score"),
                                  number(_PLAIN_START, 1).alias("start")), "__p")
    plain = F.col("__p.vote").isNotNull() | F.col("__p.start").isNotNull()
    df = parsed_once(df, F.when((text != "") & ~plain, F.from_xml(payload, CHANGE_SCHEMA, {"rowTag": "Change"})), "__x")
    read = _change_of(F.col("__x"), F.col(payload))
    change = F.struct(F.coalesce(F.col("__p.vote") != 0, read["vote"]).alias("vote"), F.coalesce("__p.score", read["score"]).alias("score"),
                      F.coalesce("__p.start", read["task_ordinal"]).alias("task_ordinal"), (~plain & read["bad_xml"]).alias("bad_xml"))
    return parsed_once(df, change, name).drop("__p", "__x")


def checked_commands(parsed: DataFrame) -> DataFrame:
    """Parsed messages with their change in columns (task_ordinal, score, vote), and ``reason`` also set where the
    payload of a vote or a start is broken.  Rows without a reason are the well-formed commands."""
    p = with_change(parsed)
    broken = F.col("reason").isNull() & F.col("__c.bad_xml")
    reason = F.when(broken, "bad_xml").otherwise(F.col("reason"))
    return p.select(*[c for c in parsed.columns if c != "reason"], reason.alias("reason"), F.col("__c.task_ordinal").alias("task_ordinal"),
                    F.col("__c.score").alias("score"), F.col("__c.vote").alias("vote"))


def parse_change(payload: Column) -> Column:
    """``/Change/AddVote/@vote,@score`` (the last node wins, as a variable
    assignment over rows does) and ``TOP(1) /Change/StartVoting/@taskId``.
    Returns struct(vote BOOLEAN, score INT, task_ordinal INT, bad_xml BOOLEAN).
    A missing node gives NULL (not 0, as xpath_int would)."""
    return _change_of(F.from_xml(payload, CHANGE_SCHEMA, {"rowTag": "Change"}), payload)


def _change_of(x: Column, payload: Column) -> Column:
    vote = F.try_element_at(x["AddVote"], F.lit(-1))
    start = F.try_element_at(x["StartVoting"], F.lit(1))
    empty = F.coalesce(payload, F.lit("")) == ""
    return F.struct(
        (vote["_vote"].try_cast("int") != 0).alias("vote"),
        vote["_score"].try_cast("int").alias("score"),
        start["_taskId"].try_cast("int").alias("task_ordinal"),
        (~empty & _is_corrupt(x)).alias("bad_xml"))


def _esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def task_list_xml(name: Column, minutes: Column) -> Column:
    """One ``<task name=".." time-discussion=".."/>`` element (attribute-escaped)."""
    return F.concat(F.lit('<task name="'), _esc(name), F.lit('" time-discussion="'),
                    F.coalesce(minutes.cast("string"), F.lit("")), F.lit('"/>'))

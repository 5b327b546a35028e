"""XML files through Spark's XML data source: room views and task lists, in both directions.

A file holds one element per row (``rowTag``), so a file is split by rows like any text, and a folder of files is read
by as many tasks as it has blocks.  Schemas are given; an element that does not parse keeps its text in
``_corrupt_record`` and goes to the quarantine instead of failing the read or vanishing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estimark.operators.snapshot import view_document, view_from_document
from estimark.session import materialize
from estimark.sources.xml import TASKS_SCHEMA

# the parser that takes a file element by element: the other one gives up on a file at its first broken element
_READ = {"mode": "PERMISSIVE", "useLegacyXMLParser": "true"}

VIEW_FILE_SCHEMA = ("_RoomId BIGINT, _Error STRING, _NameRoom STRING, _Page INT, "
                    "Persons STRUCT<Person: ARRAY<STRUCT<_UserName: STRING, _Id: INT>>>, "
                    "Tasks STRUCT<Task: ARRAY<STRUCT<_Id: INT, _NameTask: STRING, _Completed: INT, _IsCurrentActive: INT, "
                    "_TimeDiscussion: INT, _Median: DECIMAL(9,2), _Continued: INT, "
                    "PersonTask: ARRAY<STRUCT<_PersonId: INT, _Vote: INT, _Score: INT>>>>>, _corrupt_record STRING")


def write_views(snap: DataFrame, folder: str) -> None:
    """Room views as XML files: a ``Rooms`` root, one ``Room`` element a page."""
    (snap.select(F.col("room_id").cast("bigint").alias("_RoomId"), view_document().alias("d")).select("_RoomId", "d.*")
     .write.format("xml").option("rootTag", "Rooms").option("rowTag", "Room").save(folder))


def read_views(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(views, quarantine) of a folder of view files; the quarantine is (text, reason)."""
    raw = spark.read.format("xml").schema(VIEW_FILE_SCHEMA).options(rowTag="Room", **_READ).load(folder)
    raw = materialize(raw)  # parsed once for both
    good = raw.filter(F.col("_corrupt_record").isNull())
    views = good.select(F.col("_RoomId").alias("room_id"), F.struct(*[c for c in raw.columns if c != "_RoomId"]).alias("r"))
    bad = raw.filter(F.col("_corrupt_record").isNotNull()).select(F.col("_corrupt_record").alias("text"), F.lit("bad_xml").alias("reason"))
    return view_from_document(views), bad


LIST_FILE_SCHEMA = "_request BIGINT, " + TASKS_SCHEMA


def write_task_lists(lists: DataFrame, folder: str) -> None:
    """Task lists (request_id, tasks_xml) as text files of ``tasks`` elements, as a form would post them one after the other."""
    tagged = F.replace(F.col("tasks_xml"), F.lit("<tasks>"), F.concat(F.lit('<tasks request="'), F.col("request_id").cast("string"), F.lit('">')))
    lists.select(tagged.alias("value")).write.text(folder)


def read_task_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, quarantine) of a folder of task lists: (request_id, pos, name, minutes) and (request_id, reason).

    A list that is broken inside keeps its request number where that can still be read from its text."""
    raw = spark.read.format("xml").schema(LIST_FILE_SCHEMA).options(rowTag="tasks", **_READ).load(folder)
    raw = materialize(raw)  # parsed once for both
    bad = raw.filter(F.col("_corrupt_record").isNotNull()).select(
        F.regexp_extract("_corrupt_record", 'request="([0-9]+)"', 1).try_cast("bigint").alias("request_id"), F.lit("bad_xml").alias("reason"))
    t = raw.filter(F.col("_corrupt_record").isNull()).select(F.col("_request").alias("request_id"), F.posexplode("task").alias("pos", "t"))
    return t.select("request_id", "pos", F.col("t._name").alias("name"), F.col("t.`_time-discussion`").try_cast("int").alias("minutes")), bad

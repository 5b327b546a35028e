"""Streaming forms: the message log as a stream, live last votes, the room
fold and the room views as keyed state.

All queries use ``trigger(availableNow=True)`` here (process what is there,
then stop); in production the same code runs with a processing-time trigger
on a Kafka or file source.  State lives in the engine's state store (RocksDB);
output goes to plain Parquet under the shared checkpoint folder, never to the
driver (no memory sink).
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estimark.operators.fold import FINISH, VOTE
from estimark.operators.members import task_ordinals
from estimark.operators.snapshot import room_snapshot
from estimark.sources.bindings import commands_of, messages_of, vote_log_of
from estimark.sources.messages import parse_messages
from estimark.sources.xml import with_change
from estimark.streaming import room_fold
from estimark.streaming.room_fold import CHANGES, PACKED, VIEWS, PackedRoomFold, PackedRoomView
from estimark.streaming.sinks import AppendTable, file_system, scratch_root

# the processors travel whole: the processes that run them need not be able to import this package
cloudpickle.register_pickle_by_value(room_fold)

ROOM_BUCKETS = 64
DELAY = "1 hour"  # how late a message may be
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parquet_stream(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream.  ``path`` is a folder of part files (``glob`` narrows it), or, as a table may be, one
    file: then its folder is watched for files of that name.  A path or a pattern that matches nothing is an error,
    not an empty stream."""
    fs, p = file_system(spark, path)
    if glob is None and fs.exists(p) and fs.getFileStatus(p).isFile():
        path, glob = str(p.getParent()), p.getName()
    fs, p = file_system(spark, path if glob is None else f"{path.rstrip('/')}/{glob}")
    found = fs.globStatus(p)
    if not found:
        raise FileNotFoundError(f"nothing to stream at {p}")
    r = spark.readStream.schema(schema)
    if glob:
        if found[0].isDirectory():  # a table written as a folder of part files
            path = str(found[0].getPath())
        else:
            r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(path)


EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def message_stream(spark: SparkSession, directory: str, glob: str = "events.parquet",
                   max_files: int | None = None) -> DataFrame:
    """The room message log as a stream (room_id, ts, event_id, person_no, msg)."""
    return messages_of(commands_of(parquet_stream(spark, directory, EVENTS, glob, max_files)))


def run(writer, root: str) -> str:
    """Run a streaming query over what is there, with its state in RocksDB; returns the query's id."""
    conf, key = SparkSession.active().conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, STATE_STORE)
    try:
        q = writer.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return str(q.id)


def change_log_stream(spark: SparkSession, messages: DataFrame, root: str | None = None) -> DataFrame:
    """Parse the message stream (stateless) into a Parquet file sink; returns
    the sink's table."""
    root = root or scratch_root(spark, "change-log")
    parsed = parse_messages(messages)
    run(parsed.writeStream.format("parquet").option("path", f"{root}/data"), root)
    return spark.read.schema(parsed.schema).parquet(f"{root}/data")


def append_log(spark: SparkSession, messages: DataFrame, root: str | None = None) -> AppendTable:
    """Parse the message stream into an append-only log, partitioned by a room bucket, one folder a micro-batch."""
    root = root or scratch_root(spark, "append-log")
    log = AppendTable(f"{root}/log", partition_by=["room_bucket"])
    parsed = parse_messages(messages).withColumn("room_bucket", F.pmod(F.hash("room_id"), F.lit(ROOM_BUCKETS)))
    run(parsed.writeStream.foreachBatch(log.append), root)
    return log


def stream_vote_counts(spark: SparkSession, lineitem: DataFrame, part: DataFrame, root: str | None = None) -> DataFrame:
    """Live last score per (task, person): a streaming ``max_by`` aggregation (update mode, state in the state store).
    Each micro-batch appends the keys it changed; the latest batch of a key holds its score.  ``part`` is static
    (stream-static join)."""
    root = root or scratch_root(spark, "vote-counts")
    table = AppendTable(f"{root}/table")
    log = vote_log_of(lineitem.join(part, lineitem.l_partkey == part.p_partkey))
    best = F.max_by(F.struct("room_id", "score"), F.struct("ts", "l_orderkey", "l_linenumber", "l_quantity"))
    agg = log.groupBy("task_id", "person_id").agg(best.alias("b")).select(
        F.col("b.room_id").alias("room_id"), F.col("b.score").alias("score"), "task_id", "person_id")
    run(agg.writeStream.outputMode("update").foreachBatch(table.append), root)
    latest = F.max_by(F.struct("room_id", "score"), "batch_id")
    return table.read(spark).groupBy("task_id", "person_id").agg(latest.alias("b")).select(
        "b.room_id", "b.score", "task_id", "person_id")


def parsed_commands(parsed: DataFrame) -> DataFrame:
    """Well-formed commands from parsed messages (format and XML checked)."""
    p = with_change(parsed.filter(F.col("reason").isNull())).filter(~F.col("__c.bad_xml"))
    return p.select(*[c for c in ("at", "us") if c in parsed.columns], "room_id", "ts", "event_id", "person_no", "kind",
                    F.col("__c.task_ordinal").alias("task_ordinal"), F.col("__c.score").alias("score"),
                    F.col("__c.vote").alias("vote"))


def with_event_time(df: DataFrame, delay: str = DELAY, ts: str = "ts") -> DataFrame:
    """Add ``us`` (microseconds) and ``at``, the watermarked event time, of a wall-clock column.  The wall clock is read
    field by field, so that no time zone, and no hour that a zone skips or repeats, enters."""
    us = F.expr(f"CAST(datediff({ts}, DATE '1970-01-01') AS BIGINT) * 86400000000 + hour({ts}) * 3600000000L + minute({ts}) * 60000000L "
                f"+ CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)")
    return df.withColumn("us", us).withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)


def wall_clock(us: str):
    """The wall-clock time of ``us``."""
    return F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {us} / CAST(1000000 AS DECIMAL(8, 0)))")


def packed_changes(messages: DataFrame, tasks: DataFrame, dictionary: DataFrame, members: DataFrame | None = None,
                   delay: str = DELAY) -> DataFrame:
    """The stream of changes: what each command did, task states at the end of each micro-batch, overrun segments; in
    blocks (schema ``PACKED``), which ``unpacked`` opens.

    ``members`` (room_id, person_no) holds who may have a slot; without it every sender has one.  Ordinals, slots and
    special cards are looked up by stream-static joins, so the keyed state holds nothing that a table has."""
    # parsed by as many tasks as there are state partitions, however few row groups the files of a micro-batch have
    messages = messages.repartition("room_id", "event_id")
    c = parsed_commands(parse_messages(with_event_time(messages, delay)))
    o = task_ordinals(tasks).select(F.col("room_id").alias("__room"), F.col("task_ord").alias("__ord"),
                                    F.col("task_id").cast("long").alias("start_task"), F.col("minutes").cast("int").alias("minutes"))
    c = c.join(o, (F.col("room_id") == F.col("__room")) & (F.col("task_ordinal") == F.col("__ord")), "left").drop("__room", "__ord")
    if members is None:
        c = c.withColumn("has_slot", F.lit(True))
    else:
        m = members.select(F.col("room_id").alias("__room"), F.col("person_no").alias("__person")).distinct()
        c = c.join(m, (F.col("room_id") == F.col("__room")) & (F.col("person_no") == F.col("__person")), "left")
        c = c.withColumn("has_slot", F.col("__room").isNotNull()).drop("__room", "__person")
    d = dictionary.select(F.col("score").alias("__score")).distinct()
    c = c.join(d, F.col("score") == F.col("__score"), "left").withColumn("is_card", F.col("__score").isNull())
    # a command is one text: the processor's process reads every cell of its input by itself
    command = F.to_json(F.struct("us", "event_id", F.col("person_no").cast("long").alias("person_no"), "kind", "start_task", "minutes",
                                 "has_slot", "vote", "score", "is_card"))
    c = c.select(F.col("room_id").cast("long").alias("room_id"), "at", command.alias("rows"))
    return c.groupBy("room_id").transformWithState(PackedRoomFold(), PACKED, "append", "EventTime", eventTimeColumnName="at")


def packed_views(changes: DataFrame) -> DataFrame:
    """From packed changes, one row per command: the cell it changed and the digest of the room's view after it, packed."""
    return changes.groupBy("room_id").transformWithState(PackedRoomView(), PACKED, "append", "EventTime", eventTimeColumnName="at")


def unpacked(packed: DataFrame, schema: str) -> DataFrame:
    """The rows of packed blocks, in the columns of ``schema`` (one of them ``at``, the event time)."""
    inner = schema.replace("at timestamp", "at long")
    rows = packed.select(F.explode(F.from_json("rows", f"array<struct<{inner.replace(' ', ': ').replace(',: ', ', ')}>>")).alias("r")).select("r.*")
    return rows.withColumn("at", F.timestamp_micros("at"))


def room_changes(messages: DataFrame, tasks: DataFrame, dictionary: DataFrame, members: DataFrame | None = None,
                 delay: str = DELAY) -> DataFrame:
    """The stream of changes, a row each (schema ``CHANGES``); see ``packed_changes``."""
    return unpacked(packed_changes(messages, tasks, dictionary, members, delay), CHANGES)


def room_views(changes: DataFrame) -> DataFrame:
    """One row per command: the cell it changed and the digest of the room's view after it (from packed changes)."""
    return unpacked(packed_views(changes), VIEWS)


class ChangeTables:
    """What a streaming fold has written, read as tables."""

    def __init__(self, spark: SparkSession, root: str, tasks: DataFrame, rooms: DataFrame, persons: DataFrame, members: DataFrame | None):
        self.spark, self.root = spark, root
        self.tasks, self.rooms, self.persons, self.members = tasks, rooms, persons, members

    @property
    def changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(f"{self.root}/changes")

    def commands(self) -> DataFrame:
        return self.changes.filter("what = 'change'")

    def task_states(self) -> DataFrame:
        """(room_id, task_id, on_active, completed, n_segments, median): the latest state of every task."""
        last = F.max_by(F.struct("on_active", "completed", "n_segments", F.col("median").cast("decimal(9,2)").alias("median")), "seq")
        return (self.changes.filter("what = 'task'").groupBy("room_id", "task_id").agg(last.alias("b"))
                .select("room_id", "task_id", "b.*"))

    def votes(self) -> DataFrame:
        """The Votes table: the last applied vote per (room, task, person)."""
        best = F.max_by(F.struct("vote", "score"), "seq")
        return (self.commands().filter((F.col("kind") == VOTE) & (F.col("flags") == "")).groupBy("room_id", "task_id", "person_no")
                .agg(best.alias("b")).select("room_id", "task_id", "person_no", "b.vote", "b.score"))

    def quarantine(self) -> DataFrame:
        """Commands that changed nothing, and flagged Starts: (room_id, event_id, reason)."""
        return self.commands().filter("flags <> ''").select("room_id", "event_id", F.explode(F.split("flags", ",")).alias("reason"))

    def overruns(self) -> DataFrame:
        """Segments that went beyond their time box: (room_id, seg, task_id, start_ts)."""
        return self.changes.filter("what = 'overrun'").select("room_id", "seg", "task_id", wall_clock("us").alias("start_ts"))

    def views(self) -> DataFrame:
        """The stored room views, with the time a room's view was first written; a finished room's is ``UnknownRoom``."""
        seen = self.commands().groupBy("room_id").agg(F.bool_or(F.col("kind") == FINISH).alias("__done"), F.min("at").alias("created"))
        live = self.rooms.join(seen, "room_id").withColumn("is_active", F.col("is_active") & ~F.col("__done"))
        states = self.task_states()
        t = self.tasks.join(seen.select("room_id"), "room_id", "left_semi").join(
            states.select("task_id", "on_active", "completed"), "task_id", "left").select(
            "room_id", "task_id", "name", "minutes", F.coalesce("completed", F.lit(False)).alias("completed"),
            F.coalesce("on_active", F.lit(False)).alias("on_active"))
        who = self.members if self.members is not None else self.commands()
        who = who.select("room_id", F.col("person_no").cast("bigint").alias("person_id")).distinct()
        votes = self.votes().withColumnRenamed("person_no", "person_id")
        v = room_snapshot(live.drop("__done", "created"), self.persons, who.join(seen.select("room_id"), "room_id", "left_semi"), t,
                          votes, states.filter("completed").select("task_id", "median"))
        return v.join(seen.select("room_id", "created"), "room_id")


def stream_room_fold(spark: SparkSession, messages: DataFrame, tasks: DataFrame, rooms: DataFrame, persons: DataFrame,
                     dictionary: DataFrame, root: str | None = None, members: DataFrame | None = None,
                     delay: str = DELAY) -> ChangeTables:
    """Run the fold over the stream; its changes go to a Parquet file sink, partitioned by what they are."""
    root = root or scratch_root(spark, "room-fold")
    changes = room_changes(messages, tasks, dictionary, members, delay)
    run(changes.writeStream.format("parquet").partitionBy("what").option("path", f"{root}/changes"), root)
    return ChangeTables(spark, root, tasks, rooms, persons, members)


def stream_room_views(spark: SparkSession, messages: DataFrame, tasks: DataFrame, dictionary: DataFrame, root: str | None = None,
                      members: DataFrame | None = None, delay: str = DELAY) -> str:
    """Run the fold and, chained behind it, the views; returns the folder of the view log (schema ``VIEWS``)."""
    root = root or scratch_root(spark, "room-views")
    views = room_views(packed_changes(messages, tasks, dictionary, members, delay))
    run(views.writeStream.format("parquet").option("path", f"{root}/views"), root)
    return f"{root}/views"

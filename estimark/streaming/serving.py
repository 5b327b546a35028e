"""What the streaming fold serves: the view log, live deliveries, countdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estimark.operators.fold import START
from estimark.streaming.log_stream import DELAY, ChangeTables, run, wall_clock, with_event_time
from estimark.streaming.room_fold import VIEWS
from estimark.streaming.sinks import scratch_root


def view_log(spark: SparkSession, folder: str) -> DataFrame:
    """The view log as a table: one row per command of a room, in the order of ``seq``."""
    return spark.read.schema(VIEWS).parquet(folder).withColumn("ts", wall_clock("us")).drop("at", "us")


def fanout(spark: SparkSession, views: str, connects: DataFrame, lifetime: str = "1 hour", delay: str = DELAY,
           root: str | None = None) -> DataFrame:
    """Deliver every change of a room's view to the connections that are live at that time.

    A stream-stream join of the view log at ``views`` with the stream of connections (connect_id, room_id, person_no,
    ts).  A connection lives for ``lifetime``, so the join condition bounds how long either side is kept: a
    connection until the watermark is ``lifetime`` beyond it, a change until no earlier connection can still come.
    A connection gets the cells that change after it opened, each with the digest of the view it leads to."""
    root = root or scratch_root(spark, "fanout")
    v = spark.readStream.schema(VIEWS).parquet(views).withWatermark("at", delay)
    k = with_event_time(connects, delay).select("connect_id", F.col("room_id").alias("__room"), F.col("person_no").alias("connected_person"),
                                                F.col("at").alias("__since"))
    live = (F.col("room_id") == F.col("__room")) & (F.col("at") > F.col("__since")) & (
        F.col("at") <= F.col("__since") + F.expr(f"INTERVAL {lifetime}"))
    out = v.join(k, live).select("connect_id", "connected_person", "room_id", "seq", "event_id", wall_clock("us").alias("ts"), "kind",
                                 "task_id", "person_no", "vote", "score", "active_task", "digest")
    run(out.writeStream.format("parquet").option("path", f"{root}/deliveries"), root)
    return spark.read.schema(out.schema).parquet(f"{root}/deliveries")


def countdown(t: ChangeTables, tasks: DataFrame, now: DataFrame) -> DataFrame:
    """The countdown of every open voting segment: (room_id, task_id, start_ts, minutes, deadline, remaining_s, overrun,
    countdown).  ``now`` is one row with the time in microseconds (``now``)."""
    c = t.commands()
    last = c.groupBy("room_id").agg(F.max_by(F.struct("active_task", "seg"), "seq").alias("b")).select(
        "room_id", F.col("b.active_task").alias("task_id"), F.col("b.seg").alias("seg")).filter("task_id IS NOT NULL")
    opened = c.filter(F.col("kind") == START).select("room_id", "seg", F.col("us").alias("__us"))
    j = last.join(opened, ["room_id", "seg"]).join(tasks.select("task_id", "minutes"), "task_id").join(F.broadcast(now))
    box = F.col("minutes").cast("bigint") * 60
    elapsed = F.floor(F.col("now") / 1_000_000) - F.floor(F.col("__us") / 1_000_000)
    left = F.greatest(box - elapsed, F.lit(0).cast("bigint"))
    return j.select("room_id", "task_id", wall_clock("__us").alias("start_ts"), "minutes",
                    F.timestamp_add("SECOND", box, wall_clock("__us")).alias("deadline"), left.alias("remaining_s"),
                    (elapsed > box).alias("overrun"),
                    F.format_string("%d-m: %d-sec", F.floor(left / 60).cast("bigint"), left % 60).alias("countdown"))

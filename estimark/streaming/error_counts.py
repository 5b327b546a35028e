"""The error table: how many messages were refused, and why, counted while they are parsed.

``observe`` attaches the counts to the parsing plan, so they come out of the same pass that writes the messages; a
streaming listener takes them from the progress of every micro-batch and appends them to the error table.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from estimark.sources.messages import parse_messages
from estimark.sources.xml import with_change
from estimark.streaming.log_stream import run
from estimark.streaming.sinks import scratch_root

METRICS = "message_errors"
REASONS = ("no_message", "bad_arity", "unknown_kind", "bad_xml")
SCHEMA = "query STRING, batch_id BIGINT, reason STRING, n BIGINT"


def refused(messages: DataFrame) -> DataFrame:
    """Messages with every reason they can be refused for before the fold, broken payloads included; parsed once."""
    p = with_change(parse_messages(messages))
    xml = F.col("reason").isNull() & F.col("kind").isin("ChangeVote", "StartVoting") & F.col("__c.bad_xml")
    return p.withColumn("reason", F.when(xml, "bad_xml").otherwise(F.col("reason"))).drop("__c")


def counted(parsed: DataFrame) -> DataFrame:
    """The same rows; their plan also counts the reasons."""
    return parsed.observe(METRICS, *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


class ErrorTable(StreamingQueryListener):
    """Appends the counts of every micro-batch of the queries it hears of to a table.

    A batch that is replayed after a failure reports its counts again under its own number; ``read`` keeps one row a
    (query, batch, reason)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._ended: dict[str, threading.Event] = {}
        self._failed: list[Exception] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            p = event.progress
            row = p.observedMetrics.get(METRICS)
            if row is not None:
                rows = [(str(p.id), p.batchId, r, row[r]) for r in REASONS if row[r]]
                if rows:
                    self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/errors")
        except Exception as e:  # noqa: BLE001 - the listener runs beside the query; its failures are raised in wait()
            self._failed.append(e)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.id), threading.Event()).set()

    def wait(self, query_id: str, seconds: float = 120) -> None:
        """Until all progress of an ended query has been taken in (events come in order)."""
        if not self._ended.setdefault(query_id, threading.Event()).wait(seconds):
            raise TimeoutError("the listener has not heard of the query's end")
        if self._failed:
            raise self._failed[0]

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/errors").dropDuplicates(["query", "batch_id", "reason"])


def parse_with_error_table(spark: SparkSession, messages: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the message stream into the log; returns (log, error counts by reason).  One pass over the messages."""
    root = root or scratch_root(spark, "errors")
    parsed = counted(refused(messages))
    table = ErrorTable(spark, root)
    spark.streams.addListener(table)
    try:
        q = run(parsed.writeStream.format("parquet").option("path", f"{root}/log"), f"{root}")
        table.wait(q)
    finally:
        spark.streams.removeListener(table)
    return spark.read.schema(parsed.schema).parquet(f"{root}/log"), table.read().groupBy("reason").agg(F.sum("n").alias("n"))

"""The data model as explicit Spark schemas.

One StructType per table of the estimation model.  Keys are LONG; flags are
BOOLEAN; times are TIMESTAMP_NTZ (wall-clock, no zone, like the source's
DATETIME2); the median is DECIMAL(9,2).  Parquet enforces none of the source's
NOT NULL / UNIQUE / CHECK / FOREIGN KEY constraints: see ``operators.audits``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, S, B, I, TS = T.LongType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


MODEL: dict[str, T.StructType] = {
    "rooms": _s(("room_id", L, False), ("name_room", S, False), ("created", TS, True), ("deleted", TS, True),
                ("is_active", B, True), ("creator", L, False), ("room_guid", S, True)),
    "persons": _s(("person_id", L, False), ("login_name", S, False), ("email", S, False), ("password", S, True)),
    "connections": _s(("connection_id", S, True), ("ts", TS, True), ("room_id", L, True), ("person_id", L, True)),
    "tasks": _s(("task_id", L, False), ("room_id", L, True), ("name", S, False), ("minutes", I, False),
                ("created", TS, True), ("on_active", B, False), ("completed", B, False), ("changed", TS, False)),
    "votes": _s(("room_id", L, False), ("task_id", L, False), ("person_id", L, False), ("vote", B, False),
                ("score", I, False)),
    "task_results": _s(("task_id", L, False), ("room_id", L, False), ("median", T.DecimalType(9, 2), True),
                       ("created", TS, False)),
    "recovery": _s(("account_id", L, False), ("link", S, False), ("is_active", B, False), ("requested", TS, False)),
    "dictionary": _s(("score", I, False), ("meaning", S, True)),
    "errors": _s(("error_id", L, False), ("error_text", S, False), ("ts", TS, False)),
    "room_requests": _s(("request_id", L, False), ("name_room", S, True), ("tasks_xml", S, True)),
    "messages": _s(("room_id", L, True), ("ts", TS, True), ("event_id", L, False), ("person_no", L, True),
                   ("msg", S, True)),
}


def read_model_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a stored model table with its declared schema (no inference)."""
    return spark.read.schema(MODEL[name]).parquet(path)


def conforms(df: DataFrame, name: str) -> list[str]:
    """Columns of ``df`` whose type differs from the model's (ignoring
    nullability and integer widths, which Parquet sources vary); [] if none."""
    want = {f.name: f.dataType for f in MODEL[name].fields}
    widths = {T.IntegerType, T.LongType, T.ShortType, T.ByteType}
    bad = []
    for f in df.schema.fields:
        w = want.get(f.name)
        if w is None:
            continue
        if type(w) in widths and type(f.dataType) in widths:
            continue
        if w != f.dataType:
            bad.append(f"{f.name}: {f.dataType.simpleString()} (model {w.simpleString()})")
    return bad

"""Constraint audits: UNIQUE, FOREIGN KEY, CHECK, NOT NULL.

Parquet enforces none of the original DDL constraints, so each becomes a
query that reports the rows (or counts) breaking it.  Each audit is one scan
plus, for keys, one aggregation or anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.functions.rules import key_text


def audit_unique(checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``{constraint: (table, column)}`` -> (constraint_name, key_value, n_rows)
    for every key value held by more than one row.  Text keys compare
    case-insensitively without trailing blanks; NULLs are not counted."""
    out = None
    for name, (df, col) in checks.items():
        dt = dict(df.dtypes)[col]
        k = key_text(F.col(col)) if dt == "string" else F.col(col).cast("string")
        part = (df.select(k.alias("key_value")).filter(F.col("key_value").isNotNull())
                .groupBy("key_value").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
                .select(F.lit(name).alias("constraint_name"), "key_value", "n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def audit_foreign_keys(children: dict[str, tuple[DataFrame, dict[str, tuple[str, DataFrame, str]]]]) -> DataFrame:
    """``{child: (table, {constraint: (fk_col, parent, pk_col)})}`` ->
    (constraint_name, n_orphans): child rows whose non-NULL key has no parent
    row.  A child is scanned once; each row gives one (constraint, key) per
    foreign key, and these collapse to distinct keys with counts before any
    shuffle.  All constraints then meet the parents' keys in one join."""
    keys = parents = None
    names = [n for _, constraints in children.values() for n in constraints]
    for child, constraints in children.values():
        pairs = F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.col(fk).cast("bigint").alias("__key"))
                          for n, (fk, _, _) in constraints.items()])
        part = child.select(F.inline(pairs)).filter(F.col("__key").isNotNull()).groupBy("constraint_name", "__key").agg(
            F.count(F.lit(1)).alias("__n"))
        keys = part if keys is None else keys.unionByName(part)
        for n, (_, parent, pk) in constraints.items():
            p = parent.select(F.lit(n).alias("constraint_name"), F.col(pk).cast("bigint").alias("__key"))
            parents = p if parents is None else parents.unionByName(p)
    orphans = keys.join(parents, ["constraint_name", "__key"], "left_anti").groupBy("constraint_name").agg(F.sum("__n").alias("__n"))
    every = keys.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("constraint_name"))
    return every.join(orphans, "constraint_name", "left").select("constraint_name", F.coalesce("__n", F.lit(0)).alias("n_orphans"))


def audit_check(tasks: DataFrame, lo: int = 1, hi: int = 10) -> DataFrame:
    """CHECK (TimeDiscussion > 0 AND TimeDiscussion <= 10): rows where the
    check is false.  A NULL makes the check unknown, which passes."""
    ok = (F.col("minutes") >= lo) & (F.col("minutes") <= hi)
    return tasks.filter(~ok).select("task_id", "room_id", "minutes")


def audit_not_null(checks: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``{table: (df, not_null_columns)}`` -> (table_name, column_name, n_nulls),
    one pass per table with a ``count_if`` per column."""
    out = None
    for name, (df, cols) in checks.items():
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        long = counts.unpivot([], cols, "column_name", "n_nulls").select(
            F.lit(name).alias("table_name"), "column_name", "n_nulls")
        out = long if out is None else out.unionByName(long)
    return out

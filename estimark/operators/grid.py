"""The results grid: task rows, person columns, scores and the median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.operators.votes import vote_ordinals


def results_grid(votes: DataFrame, persons: DataFrame, medians: DataFrame, room_active: DataFrame) -> DataFrame:
    """Grid cells (room_id, task_id, person_ord, person_id, login_name, score,
    median).  Scores are masked (NULL) while a task of the room is being voted
    on, as the view only shows them between rounds."""
    v = vote_ordinals(votes.select("room_id", "task_id", "person_id", "score"))
    j = (v.join(persons.select("person_id", "login_name"), "person_id")
         .join(medians.select("task_id", "median"), "task_id", "left")
         .join(room_active.select("room_id", "has_active"), "room_id", "left"))
    return j.select("room_id", "task_id", "person_ord", "person_id", "login_name",
                    F.when(~F.coalesce("has_active", F.lit(False)), F.col("score")).alias("score"), "median")


def pivot_grid(cells: DataFrame, person_ords: Sequence[int]) -> DataFrame:
    """Wide form for display: one column per person ordinal.  The ordinals are
    given explicitly (a page of the grid), so Spark does not scan the data to
    discover them and the width stays bounded; call once per page."""
    return cells.groupBy("room_id", "task_id", "median").pivot("person_ord", list(person_ords)).agg(
        F.first("score"))


def wide_pages(cells: DataFrame, medians: DataFrame, width: int, pages: int) -> DataFrame:
    """Pages of the wide grid: a row per (task, page), a column per person of the page.

    ``cells`` are votes with ``person_ord``.  A cell's page and column follow from its ordinal, so all pages come from
    one explicit-value pivot: one aggregation, whatever the number of persons, and rows that stay ``width`` wide."""
    at = F.col("person_ord") - 1
    c = cells.filter(F.col("person_ord") <= width * pages).select(
        "room_id", "task_id", "score", (F.floor(at / width) + 1).cast("int").alias("page"), (at % width + 1).alias("__column"))
    wide = c.groupBy("room_id", "task_id", "page").pivot("__column", list(range(1, width + 1))).agg(F.first("score"))
    wide = wide.select("room_id", "task_id", "page", *[F.col(str(i)).alias(f"person_{i}") for i in range(1, width + 1)])
    return wide.join(medians.select("task_id", "median"), "task_id", "left")

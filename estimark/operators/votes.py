"""Votes: last vote wins, sentinel cards, the median estimate, ordinals.

Votes are keyed by (task_id, person_id); the room is carried along.  All
aggregations here have a map-side partial step (``latest_vote`` keeps struct
buffers and is sort-based, the others are hash aggregations), so a hot task or
person is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.operators.scan import ordinal

VOTE_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_quantity")

# The cards of the voting deck, as the room page offers them.
DECK = (1, 2, 3, 5, 8, 13, 20, 40, 999, 777)


def latest_vote(log: DataFrame, keys: Sequence[str] = ("task_id", "person_id"),
                order: Sequence[str] = VOTE_ORDER, carry: Sequence[str] = ("room_id", "score")) -> DataFrame:
    """Repeated UPDATE semantics: the last row per key by the total ``order``
    wins.  ``max_by`` over a struct of the order columns is aggregated
    partially before the shuffle (no window), so one busy key is reduced to
    one row per input partition.  Struct buffers make Spark run it as a
    sort-based aggregate."""
    best = F.max_by(F.struct(*carry), F.struct(*order))
    return (log.groupBy(*keys).agg(best.alias("__b"))
            .select(*[F.col(f"__b.{c}").alias(c) for c in carry], *keys))


def sentinel_flag(votes: DataFrame, dictionary: DataFrame, score: str = "score") -> DataFrame:
    """Add ``is_sentinel``: the score is a dictionary card (coffee, question,
    not voted).  How the dictionary is joined is left to the planner, which
    sees its size."""
    d = dictionary.select(F.col("score").alias("__ds")).distinct().withColumn("is_sentinel", F.lit(True))
    return (votes.join(d, votes[score] == d["__ds"], "left")
            .withColumn("is_sentinel", F.coalesce("is_sentinel", F.lit(False))).drop("__ds"))


def not_in_dictionary(votes: DataFrame, dictionary: DataFrame, score: str = "score") -> DataFrame:
    """``Score NOT IN (SELECT Score FROM dictionary)``; both sides are NOT NULL,
    so a plain anti join is exact."""
    d = dictionary.select(F.col("score").alias("__ds"))
    return votes.join(d, votes[score] == d["__ds"], "left_anti")


def median_of(score_col: str = "score"):
    """PERCENTILE_CONT(0.5) as DECIMAL(9,2).  Spark's exact percentile keeps a
    value->count map per group, so its state is bounded by distinct cards."""
    return F.percentile(F.col(score_col), F.lit(0.5)).cast("decimal(9,2)")


def task_median(votes: DataFrame, dictionary: DataFrame, keys: Sequence[str] = ("room_id", "task_id")) -> DataFrame:
    """Median of the (latest) scores of each task with sentinels left out;
    NULL when nothing is left.  Every task that has a vote gets a row.

    Votes are first counted per (task, score) - a codegen hash aggregation
    with a map-side partial step - and the exact percentile then runs on
    those (value, frequency) rows, a handful per task, however hot the task."""
    counted = votes.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("__n"))
    flagged = sentinel_flag(counted, dictionary)
    kept = F.when(~F.col("is_sentinel"), F.col("score"))
    return flagged.groupBy(*keys).agg(
        F.percentile(kept, F.lit(0.5), F.col("__n")).cast("decimal(9,2)").alias("median"))


def median_window(votes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``PERCENTILE_CONT(0.5) OVER (PARTITION BY task)`` on every kept vote row.

    Computed as the grouped median joined back on the task key: the same
    numbers as the window, but the hot task is partially aggregated instead of
    being buffered whole in one window task."""
    kept = not_in_dictionary(votes, dictionary)
    med = kept.groupBy("task_id").agg(median_of().alias("median"))
    return kept.join(med, "task_id").select("room_id", "task_id", "person_id", "score", "median")


def vote_ordinals(votes: DataFrame) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY task ORDER BY person_id) -> person_ord."""
    return ordinal(votes, ["task_id"], ["person_id"], "person_ord")


def decode_scores(votes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Card label: the dictionary meaning of a sentinel, else the number; and
    ``in_deck``, whether the score is a card of the deck (scores are not
    checked when votes arrive, so this is an audit column, not a filter)."""
    d = dictionary.select(F.col("score").alias("__ds"), "meaning")
    j = votes.join(d, votes["score"] == d["__ds"], "left")
    return j.select("room_id", "task_id", "person_id", "score",
                    F.coalesce("meaning", F.col("score").cast("string")).alias("label"),
                    F.coalesce(F.col("score").isin(*DECK), F.lit(False)).alias("in_deck"))


def voted_flags(log: DataFrame) -> DataFrame:
    """Per task: persons with any row, and persons who voted (some nonzero
    score, the ``Vote != 0`` flag of the view).  Two-level partial aggregation."""
    per_person = log.groupBy("room_id", "task_id", "person_id").agg(
        F.bool_or(F.col("score") != 0).alias("voted"))
    return per_person.groupBy("room_id", "task_id").agg(
        F.count(F.lit(1)).alias("n_persons"), F.count_if("voted").alias("n_voted"))


def voted_on_active(active: DataFrame, members: DataFrame, votes: DataFrame) -> DataFrame:
    """For every room with a task being voted on: each member and whether the
    member has voted on that task (a vote row with the Vote flag).
    ``active``: (room_id, task_id); ``members``: (room_id, person_id);
    ``votes``: (room_id, task_id, person_id, vote)."""
    cast = votes.filter("vote").select("room_id", "task_id", "person_id", F.lit(True).alias("__v")).distinct()
    return (active.filter(F.col("task_id").isNotNull()).select("room_id", "task_id").join(members, "room_id")
            .join(cast, ["room_id", "task_id", "person_id"], "left")
            .select("room_id", "task_id", "person_id", F.coalesce("__v", F.lit(False)).alias("has_voted")))


def results_by_person(votes: DataFrame, persons: DataFrame) -> DataFrame:
    """Scores with the voter's name, joined on the person key (not on ordinals)."""
    return votes.join(persons.select("person_id", "login_name"), "person_id").select(
        "room_id", "task_id", "person_id", "login_name", "score")


def dictionary_usage(votes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The score dictionary with the number of (latest) votes on each card."""
    counts = votes.groupBy("score").agg(F.count(F.lit(1)).alias("n_votes"))
    return (dictionary.join(counts, "score", "left")
            .select("score", "meaning", F.coalesce("n_votes", F.lit(0)).alias("n_votes")))

"""One quarantine table: every rejected input row with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.operators.fold import Fold, late_votes, segment_flags


def quarantine(parsed_messages: DataFrame, f: Fold) -> DataFrame:
    """Union of all rule failures: message format (bad_arity, unknown_kind),
    bad XML payloads, votes that changed nothing, flagged Start markers.
    Columns: (room_id, event_id, reason)."""
    from estimark.sources.xml import with_change
    fmt = parsed_messages.filter(F.col("reason").isNotNull()).select("room_id", "event_id", "reason")
    xml = (with_change(parsed_messages.filter(F.col("reason").isNull() & F.col("kind").isin("ChangeVote", "StartVoting")))
           .filter(F.col("__c.bad_xml")).select("room_id", "event_id", F.lit("bad_xml").alias("reason")))
    votes = late_votes(f).select("room_id", "event_id", "reason")
    out = fmt.unionByName(xml).unionByName(votes).unionByName(segment_flags(f))
    return out.unionByName(f.rejected) if f.rejected is not None else out


def refused_and_late(refused: DataFrame, f: Fold) -> DataFrame:
    """The same table from messages whose refusals, broken payloads included, are already in ``reason``: parsed once
    for the fold and for the quarantine."""
    out = refused.filter(F.col("reason").isNotNull()).select("room_id", "event_id", "reason")
    out = out.unionByName(late_votes(f).select("room_id", "event_id", "reason")).unionByName(segment_flags(f))
    return out.unionByName(f.rejected) if f.rejected is not None else out

"""Room change messages ``Kind==payload``: split, classify, quarantine.

The same projection serves a finished log (batch) and a live one (stream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The message kinds a room understands.
KINDS = ("ChangeVote", "ChangeGetVM", "StartVoting", "StopVoting", "FinishPlanning")
SEP = "=="


def parse_messages(log: DataFrame, msg: str = "msg") -> DataFrame:
    """Split ``msg`` on '=='.  One part: kind only; two: kind and payload;
    more: rejected ('bad_arity').  A kind outside KINDS: 'unknown_kind'."""
    parts = F.split(F.col(msg), SEP, -1)
    n = F.size(parts)
    kind = F.when(n <= 2, F.element_at(parts, 1))
    payload = F.when(n == 2, F.element_at(parts, 2)).when(n == 1, F.lit(""))
    reason = (F.when(F.col(msg).isNull(), "no_message").when(n > 2, "bad_arity")
              .when(~kind.isin(*KINDS), "unknown_kind"))
    return log.withColumn("kind", kind).withColumn("payload", payload).withColumn("reason", reason)

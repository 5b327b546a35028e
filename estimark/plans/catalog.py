"""Import every query module so that the registry is complete."""

from __future__ import annotations

from estimark.plans import q_fold, q_ingest, q_misc, q_rooms, q_serving, q_stream, q_votes  # noqa: F401
from estimark.plans.registry import ORACLE, QUERIES  # noqa: F401

ORACLE["message_texts"] = ORACLE["message_texts"].replace("__RECOVERY__", q_ingest.RECOVERY_SQL)


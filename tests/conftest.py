import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from estimark.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session(master="local[*]", app="estimark-tests", extra={"spark.sql.shuffle.partitions": "8"})
    yield s


def ts(minute: int, second: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1, 10, 0, 0) + dt.timedelta(minutes=minute, seconds=second)


CMD_SCHEMA = ("room_id long, ts timestamp_ntz, event_id long, person_no long, kind string, "
              "task_ordinal int, score int, vote boolean")


def cmds(spark, rows):
    """rows: (room, minute, person, kind, ordinal_or_score).  event_id = position."""
    out = []
    for i, (room, minute, person, kind, arg) in enumerate(rows):
        out.append((room, ts(minute), i, person, kind, arg if kind == "StartVoting" else None,
                    arg if kind == "ChangeVote" else None, True if kind == "ChangeVote" else None))
    return spark.createDataFrame(out, CMD_SCHEMA)


def rows_of(df, *cols, order=None):
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)

import datetime as dt
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows_of

from estimark.operators import fold as FO
from estimark.operators import votes as V
from estimark.plans import q_fold
from estimark.sources import bindings as B
from estimark.sources.tables import read_table
from estimark.streaming import log_stream as LS
from estimark.streaming import serving as SV


def _split_events(spark, parts=4):
    """Copy of the small events table cut into several files (one per part)."""
    d = tempfile.mkdtemp(prefix="estimark-stream-", dir="/tmp")
    ev = read_table(spark, SF_SMALL, "events")
    bounds = ev.agg(F.max("event_id")).collect()[0][0] + 1
    for i in range(parts):
        lo, hi = bounds * i // parts, bounds * (i + 1) // parts
        ev.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(f"{d}/p{i}")
    import glob
    import os
    import shutil
    out = tempfile.mkdtemp(prefix="estimark-stream-files-", dir="/tmp")
    for i in range(parts):
        for f in glob.glob(f"{d}/p{i}/*.parquet"):
            target = os.path.join(out, f"events-{i}.parquet")
            shutil.copy(f, target)
            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))  # arrival order = file age
    return out


def _fold(spark, src, root=None, glob=None, **kw):
    msgs = LS.message_stream(spark, src, glob=glob or "events-*.parquet", **kw)
    return LS.stream_room_fold(spark, msgs, B.b_tasks(spark, SF_SMALL), B.b_rooms(spark, SF_SMALL), B.b_persons(spark, SF_SMALL),
                               B.b_dictionary(spark), members=B.b_slots(spark, SF_SMALL), root=root)


@pytest.fixture(scope="module")
def batch(spark):
    return q_fold.run_fold(spark, SF_SMALL)


def _equals_batch(spark, t, f):
    got = t.task_states()
    assert rows_of(got) == rows_of(FO.room_state_fold(f, B.b_dictionary(spark)).select(*got.columns))
    assert rows_of(t.votes()) == rows_of(FO.apply_votes(f))
    from estimark.operators.quarantine import quarantine
    from estimark.sources.messages import parse_messages
    want = quarantine(parse_messages(B.b_messages(spark, SF_SMALL)), f).filter(
        F.col("reason").isin("no_active_task", "no_slot", "unknown_ordinal", "overlapping_start", "already_completed"))
    assert rows_of(t.quarantine()) == rows_of(want)


def test_stream_fold_equals_batch_in_four_batches(spark, batch):
    t = _fold(spark, _split_events(spark), max_files=1)
    _equals_batch(spark, t, batch)
    from estimark.operators.snapshot import snapshot_summary
    from estimark.operators.views import views_after_log
    exp = views_after_log(batch, B.b_rooms(spark, SF_SMALL), B.b_tasks(spark, SF_SMALL),
                          B.b_persons(spark, SF_SMALL), q_fold.log_members(spark, SF_SMALL), B.b_dictionary(spark))
    assert rows_of(snapshot_summary(t.views())) == rows_of(snapshot_summary(exp))
    # a view keeps the time it was first written
    first = t.commands().groupBy("room_id").agg(F.min("at").alias("created"))
    assert rows_of(t.views().select("room_id", "created").distinct()) == rows_of(
        first.join(B.b_rooms(spark, SF_SMALL).select("room_id"), "room_id"))


def test_stream_fold_goes_on_after_a_restart(spark, batch):
    """Two files, a stop, four more files: the state carries over, nothing is skipped or done twice."""
    src, later = _split_events(spark, parts=6), tempfile.mkdtemp(prefix="estimark-stream-now-", dir="/tmp")
    root = f"{later}-out"
    for i in range(6):
        shutil.copy2(f"{src}/events-{i}.parquet", later)
        if i in (1, 5):
            t = _fold(spark, later, root=root, max_files=2)
    _equals_batch(spark, t, batch)


def test_stream_of_a_folder_and_of_nothing(spark):
    """A table that is a folder of part files streams whole; a path or pattern that matches nothing is an error."""
    d = tempfile.mkdtemp(prefix="estimark-folder-", dir="/tmp")
    read_table(spark, SF_SMALL, "events").repartition(3).write.parquet(f"{d}/events.parquet")
    got = LS.change_log_stream(spark, LS.message_stream(spark, d))
    one = LS.change_log_stream(spark, LS.message_stream(spark, SF_SMALL))
    assert rows_of(got) == rows_of(one) and got.count() == read_table(spark, SF_SMALL, "events").count()
    with pytest.raises(FileNotFoundError):
        LS.message_stream(spark, d, glob="messages.parquet")
    with pytest.raises(FileNotFoundError):
        LS.parquet_stream(spark, f"{d}/nowhere", LS.EVENTS)
    assert LS.parquet_stream(spark, f"{SF_SMALL}/events.parquet", LS.EVENTS).isStreaming


def test_stream_vote_counts_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="estimark-li-", dir="/tmp")
    li = read_table(spark, SF_SMALL, "lineitem")
    li.repartition(3).write.parquet(d + "/li")
    stream = LS.parquet_stream(spark, d + "/li", li.schema, glob="*.parquet", max_files=1)
    part = read_table(spark, SF_SMALL, "part", "p_partkey", "p_brand")
    got = LS.stream_vote_counts(spark, stream, part).select("room_id", "task_id", "person_id", "score")
    exp = V.latest_vote(B.b_vote_log(spark, SF_SMALL)).select("room_id", "task_id", "person_id", "score")
    assert rows_of(got) == rows_of(exp)


def _kv(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def test_append_table_replays_overwrite_their_own_batch(spark):
    from estimark.streaming.sinks import AppendTable, scratch_root
    t = AppendTable(scratch_root(spark, "append"))
    t.append(_kv(spark, (1, "a"), (2, "b")), 0)
    t.append(_kv(spark, (2, "c")), 1)
    t.append(_kv(spark, (2, "c"), (3, "d")), 1)
    assert rows_of(t.read(spark), "k", "v", "batch_id") == [(1, "a", 0), (2, "b", 0), (2, "c", 1), (3, "d", 1)]


def test_read_table_sees_appended_rows(spark):
    from estimark.streaming.sinks import scratch_root
    folder = scratch_root(spark, "grow")
    _kv(spark, (1, "a")).write.parquet(f"{folder}/t.parquet")
    assert read_table(spark, folder, "t").count() == 1
    _kv(spark, (2, "b"), (3, "c")).write.mode("append").parquet(f"{folder}/t.parquet")
    assert read_table(spark, folder, "t").count() == 3


AT = lambda m, s=0: dt.datetime(2024, 1, 1, 10, m, s)


def _small_room(spark):
    """Two rooms; room 1 votes, stops, starts again and is finished, room 2 stays with an open task."""
    start = '<Change><StartVoting taskId="1" isCurrentActive="1"/></Change>'
    vote = '<Change><AddVote vote="1" score="5"/></Change>'
    msgs = [(1, AT(0), 0, 1, f"StartVoting=={start}"), (1, AT(1), 1, 1, f"ChangeVote=={vote}"), (1, AT(2), 2, 1, "StopVoting=="),
            (2, AT(2, 30), 3, 1, f"StartVoting=={start}"), (1, AT(3), 4, 1, "FinishPlanning=="), (2, AT(9), 5, 1, "ChangeGetVM")]
    log = spark.createDataFrame(msgs, "room_id long, ts timestamp_ntz, event_id long, person_no long, msg string")
    rooms = spark.createDataFrame([(1, "one", True), (2, "two", True)], "room_id long, name_room string, is_active boolean")
    tasks = spark.createDataFrame([(10, 1, "t", 3), (20, 2, "u", 3)], "task_id long, room_id long, name string, minutes int")
    return log, rooms, tasks, spark.createDataFrame([(1, "ann")], "person_id long, login_name string")


def test_finished_room_is_hidden_in_batch_and_stream(spark):
    from estimark.operators.members import task_ordinals
    from estimark.operators.views import views_after_log
    from estimark.sources.messages import parse_messages
    log, rooms, tasks, persons = _small_room(spark)
    d = B.b_dictionary(spark)
    members = log.select("room_id", "person_no").distinct()
    f = FO.fold(LS.parsed_commands(parse_messages(log)), task_ordinals(tasks), members)
    want = [(1, "UnknownRoom", None), (2, None, "two")]
    assert rows_of(views_after_log(f, rooms, tasks, persons, members, d), "room_id", "error", "NameRoom") == want
    src = tempfile.mkdtemp(prefix="estimark-finish-", dir="/tmp")
    log.filter("event_id < 3").coalesce(1).write.parquet(f"{src}/a")
    stream = lambda: spark.readStream.schema(log.schema).parquet(f"{src}/*")
    root = f"{src}-out"
    t = LS.stream_room_fold(spark, stream(), tasks, rooms, persons, d, root=root)
    assert rows_of(t.views(), "room_id", "error", "NameRoom") == [(1, None, "one")]
    log.filter("event_id >= 3").coalesce(1).write.parquet(f"{src}/b")
    t = LS.stream_room_fold(spark, stream(), tasks, rooms, persons, d, root=root)
    assert rows_of(t.views(), "room_id", "error", "NameRoom") == want
    now = spark.createDataFrame([(int(AT(9).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000),)], "now long")
    assert rows_of(SV.countdown(t, tasks, now), "room_id", "task_id", "remaining_s", "overrun", "countdown") == [
        (2, 20, 0, True, "0-m: 0-sec")]


def test_timer_reports_an_open_segment_once(spark):
    """The watermark passes the deadline of room 2's open segment: one overrun, also after a restart."""
    log, rooms, tasks, persons = _small_room(spark)
    src = tempfile.mkdtemp(prefix="estimark-timer-", dir="/tmp")
    log.coalesce(1).write.parquet(f"{src}/a")
    stream = lambda: spark.readStream.schema(log.schema).parquet(f"{src}/*")
    for _ in range(2):
        t = LS.stream_room_fold(spark, stream(), tasks, rooms, persons, B.b_dictionary(spark), root=f"{src}-out", delay="1 minute")
        assert rows_of(t.overruns()) == [(2, 1, 20, AT(2, 30))]


def test_deliveries_begin_with_the_connection(spark):
    log, _, tasks, _ = _small_room(spark)
    src = tempfile.mkdtemp(prefix="estimark-fanout-", dir="/tmp")
    log.coalesce(1).write.parquet(f"{src}/log")
    connects = [(100, 1, 7, AT(0, 30)), (101, 1, 8, AT(2)), (102, 2, 7, AT(0)), (103, 3, 7, AT(0))]
    spark.createDataFrame(connects, "connect_id long, room_id long, person_no long, ts timestamp_ntz").coalesce(1).write.parquet(f"{src}/connects")
    views = LS.stream_room_views(spark, spark.readStream.schema(log.schema).parquet(f"{src}/log"), tasks, B.b_dictionary(spark))
    k = spark.readStream.schema("connect_id long, room_id long, person_no long, ts timestamp_ntz").parquet(f"{src}/connects")
    got = SV.fanout(spark, views, k, lifetime="5 minutes")
    assert rows_of(got, "connect_id", "event_id") == [(100, 1), (100, 2), (100, 4), (101, 4), (102, 3)]
    digests = {r["event_id"]: r["digest"] for r in SV.view_log(spark, views).collect()}
    assert all(r["digest"] == digests[r["event_id"]] for r in got.collect()) and len(set(digests.values())) == 5

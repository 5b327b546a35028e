"""Streaming queries: each runs a Structured Streaming query to completion
(availableNow) over the test tables and returns the table its sink wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.operators.snapshot import snapshot_cells, snapshot_summary
from estimark.plans.q_fold import CELL_BLOCKS, CELLS_AFTER_LOG_SQL, VIEW_BLOCKS, VIEWS_AFTER_LOG_SQL
from estimark.plans.q_ingest import PARSE_SQL
from estimark.plans.registry import register
from estimark.sources import bindings as B
from estimark.sources.tables import read_table
from estimark.streaming import log_stream as LS
from estimark.streaming import serving as SV

STATE_SQL = """select t.room_id, t.task_id,
  coalesce(a.active_task = t.task_id, false) on_active, t.completed, t.n_segments, r.median
from (select room_id, open_task task_id, bool_or(completed) completed, count(*) n_segments from o_seg
      where open_task is not null group by room_id, open_task) t
left join o_active a on a.room_id = t.room_id left join o_results r on r.room_id = t.room_id and r.task_id = t.task_id"""


@register("change_log_stream", ["b_messages"], PARSE_SQL)
def q_change_log_stream(spark, sf):
    return LS.change_log_stream(spark, LS.message_stream(spark, sf))


@register("stream_vote_counts", ["latest_votes"], "select * from latest_votes")
def q_stream_vote_counts(spark, sf):
    li = LS.parquet_stream(spark, sf, read_table(spark, sf, "lineitem").schema, glob="lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    part = read_table(spark, sf, "part", "p_partkey", "p_brand")
    return LS.stream_vote_counts(spark, li, part).select("room_id", "task_id", "person_id", "score")


def _stream_fold(spark, sf):
    return LS.stream_room_fold(spark, LS.message_stream(spark, sf), B.b_tasks(spark, sf), B.b_rooms(spark, sf),
                               B.b_persons(spark, sf), B.b_dictionary(spark), members=B.b_slots(spark, sf))


@register("stream_room_state_fold", ["o_seg", "o_active", "o_results"], STATE_SQL)
def q_stream_room_state_fold(spark, sf):
    """The fold run as a stream, its state kept by the engine; the task states."""
    return _stream_fold(spark, sf).task_states()


@register("append_sinks", ["b_messages"], PARSE_SQL)
def q_append_sinks(spark, sf):
    """The message log, written by the idempotent append sink (one folder per micro-batch), read back."""
    return LS.append_log(spark, LS.message_stream(spark, sf)).read(spark).drop("room_bucket", "batch_id")


@register("room_snapshot_upsert", VIEW_BLOCKS, VIEWS_AFTER_LOG_SQL)
def q_room_snapshot_upsert(spark, sf):
    """Stored room views after the stream: the latest row of every key that changed."""
    return snapshot_summary(_stream_fold(spark, sf).views())


@register("room_snapshot_upsert_cells", CELL_BLOCKS, CELLS_AFTER_LOG_SQL)
def q_room_snapshot_upsert_cells(spark, sf):
    """Contents of the stored room views after the stream, as flat cells."""
    return snapshot_cells(_stream_fold(spark, sf).views())


BOX = "cast(t.minutes as bigint) * 60"


@register("stream_time_box", ["o_seg", "b_tasks", "b_messages"], f"""select s.room_id, s.seg, s.open_task task_id, s.opened_ts start_ts
from o_seg s join b_tasks t on t.task_id = s.open_task
where date_diff('second', s.opened_ts, coalesce(s.closed_ts, (select max(ts) from b_messages) - interval 1 hour)) > {BOX}""")
def q_stream_time_box(spark, sf):
    """Segments that ran over their time box: closed too late, or still open when the watermark (an hour behind the
    newest message) passed the deadline and the timer fired."""
    return _stream_fold(spark, sf).overruns()


@register("stream_countdown", ["o_seg", "b_tasks", "o_cmd"], f"""select room_id, task_id, start_ts, minutes, start_ts + to_seconds(box) deadline,
  greatest(box - elapsed, 0) remaining_s, elapsed > box overrun,
  cast(floor(greatest(box - elapsed, 0) / 60) as bigint) || '-m: ' || (greatest(box - elapsed, 0) % 60) || '-sec' countdown
from (select s.room_id, s.open_task task_id, s.opened_ts start_ts, t.minutes, {BOX} box,
        date_diff('second', s.opened_ts, n.ts) elapsed
      from o_seg s join b_tasks t on t.task_id = s.open_task cross join (select max(ts) ts from o_cmd) n
      where s.open_task is not null and s.closer is null)""")
def q_stream_countdown(spark, sf):
    """The running countdown of every open segment, as of the newest command."""
    t = _stream_fold(spark, sf)
    return SV.countdown(t, B.b_tasks(spark, sf), t.commands().agg(F.max("us").alias("now")))


VIEW_SQL = "select room_id, seq, event_id, ts, kind, task_id, person_no, vote, score, active_task, n_cells, sum_scores, n_completed, finished, digest from o_views"


def _views(spark, sf):
    return LS.stream_room_views(spark, LS.message_stream(spark, sf), B.b_tasks(spark, sf), B.b_dictionary(spark),
                                members=B.b_slots(spark, sf))


@register("stream_view_changes", ["o_views"], VIEW_SQL)
def q_stream_view_changes(spark, sf):
    """After every command: the cell of the room's view that it changed, and the digest of the whole view."""
    return SV.view_log(spark, _views(spark, sf))


@register("stream_fanout", ["o_views", "b_connects"], """select k.connect_id, k.person_no connected_person, v.room_id, v.seq, v.event_id, v.ts,
  v.kind, v.task_id, v.person_no, v.vote, v.score, v.active_task, v.digest
from o_views v join b_connects k on k.room_id = v.room_id and v.ts > k.ts and v.ts <= k.ts + interval 12 hours""")
def q_stream_fanout(spark, sf):
    """Every change of a room's view delivered to the connections that were live then (stream-stream join)."""
    connects = B.connects_of(LS.parquet_stream(spark, sf, LS.EVENTS, glob="events.parquet"))
    return SV.fanout(spark, _views(spark, sf), connects, lifetime="12 hours")

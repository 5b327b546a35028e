"""Queries on what rooms are given and send: keys of raw messages, slots as bitmaps, XML files, SQL functions, error
counts, whole new rooms, the wide results grid, surviving rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.functions import texts as TX
from estimark.functions.sql_functions import register_functions
from estimark.operators import grid as G
from estimark.operators import members as M
from estimark.operators import requests as RQ
from estimark.operators import snapshot as S
from estimark.operators import votes as V
from estimark.plans import q_rooms as QR
from estimark.plans.oracle_bindings import SENDER
from estimark.plans.q_ingest import BAD_TASK, REQ_SQL
from estimark.plans.registry import register
from estimark.sources import bindings as B
from estimark.sources import xml_files as XF
from estimark.streaming import error_counts as EC
from estimark.streaming import log_stream as LS
from estimark.streaming.sinks import scratch_root


@register("resolve_messages", ["b_raw_messages", "b_rooms", "b_persons"], """select m.event_id, m.ts, r.room_id, p.person_id,
  case when r.room_id is null and p.person_id is null then 'unknown_room_and_person' when r.room_id is null then 'unknown_room'
       when p.person_id is null then 'unknown_person' end reason
from b_raw_messages m left join (select lower(rtrim(room_guid)) k, min(room_id) room_id from b_rooms group by 1) r
  on lower(rtrim(m.room_guid)) = r.k
left join (select lower(rtrim(email)) k, min(person_id) person_id from b_persons group by 1) p on lower(rtrim(m.email)) = p.k""")
def q_resolve_messages(spark, sf):
    out = M.resolve_messages(B.b_raw_messages(spark, sf), B.b_rooms(spark, sf), B.b_persons(spark, sf))
    return out.select("event_id", "ts", "room_id", "person_id", "reason")


@register("slot_bitmaps", ["members", "b_tasks", "b_vote_log"], """select room_id, task_id, cast(person_id // 63 as bigint) bucket,
  bit_or(cast(1 as bigint) << cast(person_id % 63 as int)) slots, cast(count(*) as int) n_slots
from (select t.room_id, t.task_id, m.person_id from b_tasks t join members m on t.room_id = m.room_id
      where not exists (select 1 from b_vote_log v where v.room_id = t.room_id and v.task_id = t.task_id and v.person_id = m.person_id))
group by room_id, task_id, person_id // 63""")
def q_slot_bitmaps(spark, sf):
    """The slots that connecting inserts, one bit a (member, task) without a vote."""
    return M.slot_bitmaps(B.b_connections(spark, sf), B.b_tasks(spark, sf), B.b_vote_log(spark, sf))


@register("room_view_files", *QR.CELLS)
def q_room_view_files(spark, sf):
    """Contents of the room views, written as XML files and read back, as flat cells."""
    folder = scratch_root(spark, "views-xml")
    XF.write_views(QR.room_views(spark, sf), folder)
    return S.snapshot_cells(XF.read_views(spark, folder)[0].withColumn("room_id", F.col("room_id").cast("int")))


@register("task_list_files", ["b_room_requests"], f"""select request_id, pos, name, minutes, null reason from ({REQ_SQL}) where request_id % 7 <> 3
union all select distinct request_id, null, null, null, 'bad_xml' from b_room_requests where request_id % 7 = 3""")
def q_task_list_files(spark, sf):
    """Posted task lists read from XML files: their tasks, and the broken lists in quarantine."""
    folder = scratch_root(spark, "lists-xml")
    XF.write_task_lists(B.b_posted_lists(spark, sf), folder)
    tasks, bad = XF.read_task_lists(spark, folder)
    return tasks.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@register("sql_functions", ["b_room_requests"], f"""select r.request_id, r.pos, r.name, r.minutes from ({REQ_SQL}) r
where r.request_id not in (select request_id from b_room_requests group by request_id having bool_or({BAD_TASK}))""")
def q_sql_functions(spark, sf):
    """Tasks of the acceptable requests, by functions that SQL calls."""
    register_functions(spark)
    return spark.sql("SELECT r.request_id, t.pos, t.name, t.minutes FROM {r} r, LATERAL room_tasks(r.tasks_xml) t "
                     "WHERE NOT is_null_or_empty(r.tasks_xml)", r=B.b_room_request_xml(spark, sf))


@register("message_error_counts", ["b_messages", "b_commands"], """select reason, cast(count(*) as bigint) n from (
  select case when len(string_split(msg, '==')) > 2 then 'bad_arity'
    when string_split(msg, '==')[1] not in ('ChangeVote', 'ChangeGetVM', 'StartVoting', 'StopVoting', 'FinishPlanning')
    then 'unknown_kind' end reason from b_messages
  union all select 'bad_xml' from b_commands where fault = 'xml') where reason is not null group by reason""")
def q_message_error_counts(spark, sf):
    """Refused messages by reason, counted by the pass that parses the stream."""
    return EC.parse_with_error_table(spark, LS.message_stream(spark, sf))[1]


GUID_SQL = " || '-' || ".join(f"substr(md5('room|' || request_id), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
CREATED_SQL = f"""select request_id room_id, 'Room ' || request_id name_room, timestamp '2024-01-01' + to_seconds(request_id) created,
  true is_active, p.person_id creator, {GUID_SQL} room_guid
from (select request_id from b_room_requests group by request_id having not bool_or({BAD_TASK})) r
left join b_persons p on lower(rtrim(p.email)) = {SENDER.format(n="(request_id % 11)")}"""


@register("create_rooms_rows", ["b_room_requests", "b_persons"], CREATED_SQL)
def q_create_rooms_rows(spark, sf):
    """The room rows that valid requests insert: GUID and creator included."""
    return RQ.created_rooms(B.b_posted_rooms(spark, sf), B.b_persons(spark, sf))


@register("invitation_links", ["b_room_requests", "b_persons"],
          f"select room_id, 'http://localhost/rooms?roomId=' || lower(room_guid) link from ({CREATED_SQL})")
def q_invitation_links(spark, sf):
    """The link that the creator of a new room gets to pass on."""
    rooms = RQ.created_rooms(B.b_posted_rooms(spark, sf), B.b_persons(spark, sf))
    return rooms.select("room_id", TX.invitation_link(F.col("room_guid")).alias("link"))


PAGE = 8  # columns of a page of the wide grid
WIDE_SQL = ", ".join(f"max(case when person_ord = {{first}} + {i} then score end) person_{i + 1}" for i in range(PAGE))


@register("results_grid_wide", ["latest_votes", "task_median"], "\nunion all ".join(
    f"""select room_id, task_id, median, {p + 1} as page, {WIDE_SQL.format(first=p * PAGE + 1)}
from (select v.room_id, v.task_id, m.median, v.score, row_number() over (partition by v.task_id order by v.person_id) person_ord
      from latest_votes v left join task_median m on m.task_id = v.task_id)
where person_ord between {p * PAGE + 1} and {(p + 1) * PAGE} group by room_id, task_id, median""" for p in range(2)))
def q_results_grid_wide(spark, sf):
    """The first two pages of the grid as a user sees it: a row a task, a column a person."""
    votes = V.latest_vote(B.b_vote_log(spark, sf))
    return G.wide_pages(V.vote_ordinals(votes), V.task_median(votes, B.b_dictionary(spark)), PAGE, pages=2)


@register("cascade_delete_rows", ["b_rooms", "b_tasks", "b_connections", "latest_votes", "task_median"], "\nunion all ".join(
    f"select '{n}' table_name, room_id, {t} task_id, {p} person_id from {src} where room_id not in (select room_id from b_rooms where not is_active)"
    for n, src, t, p in (("tasks", "b_tasks", "task_id", "cast(null as bigint)"), ("connections", "b_connections", "cast(null as bigint)", "person_id"),
                         ("votes", "latest_votes", "task_id", "person_id"), ("results", "task_median", "task_id", "cast(null as bigint)"))))
def q_cascade_delete_rows(spark, sf):
    """The rows that survive the deletion of the inactive rooms, by table."""
    votes = V.latest_vote(B.b_vote_log(spark, sf))
    kept = M.cascade_delete(B.b_rooms(spark, sf).filter(~F.col("is_active")), {
        "tasks": B.b_tasks(spark, sf), "connections": B.b_connections(spark, sf), "votes": votes,
        "results": V.task_median(votes, B.b_dictionary(spark))})
    out = None
    for name, df in kept.items():
        part = df.select(F.lit(name).alias("table_name"), "room_id", *[
            (F.col(c) if c in df.columns else F.lit(None)).cast("bigint").alias(c) for c in ("task_id", "person_id")])
        out = part if out is None else out.unionByName(part)
    return out

"""Queries on rooms, members, tasks and the nested room view."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.operators import members as M
from estimark.operators import snapshot as S
from estimark.operators import votes as V
from estimark.plans.registry import register
from estimark.session import materialize
from estimark.sources import bindings as B


def _latest(spark, sf):
    return V.latest_vote(B.b_vote_log(spark, sf))


def _medians(spark, sf):
    return V.task_median(_latest(spark, sf), B.b_dictionary(spark))


def _snapshot(spark, sf, **kwargs):
    votes = materialize(_latest(spark, sf))  # reduced once, read for ordinals and medians
    return S.room_snapshot(B.b_rooms(spark, sf), B.b_persons(spark, sf), B.b_connections(spark, sf),
                           B.b_tasks(spark, sf), votes, V.task_median(votes, B.b_dictionary(spark)), **kwargs)


@register("task_ordinals", ["b_tasks"], """select task_id, room_id, name, minutes,
  cast(row_number() over (partition by room_id order by task_id) as int) task_ord from b_tasks""")
def q_task_ordinals(spark, sf):
    return M.task_ordinals(B.b_tasks(spark, sf))


CONNECTED_SQL = """select m.room_id, m.person_id, p.login_name from members m join b_persons p on m.person_id = p.person_id"""


@register("connected_persons", ["members", "b_persons"], CONNECTED_SQL)
def q_connected_persons(spark, sf):
    return M.connected_persons(B.b_persons(spark, sf), B.b_connections(spark, sf))


@register("person_ordinals", ["members", "b_persons"], f"""select *,
  cast(row_number() over (partition by room_id order by person_id) as int) person_ord from ({CONNECTED_SQL})""")
def q_person_ordinals(spark, sf):
    return M.person_ordinals(M.connected_persons(B.b_persons(spark, sf), B.b_connections(spark, sf)))


@register("zero_fill_votes", ["members", "b_tasks", "b_vote_log"], """select room_id, task_id, cast(count(*) as bigint) n_slots,
  cast(count(*) filter (where voted) as bigint) n_voted, cast(count(*) filter (where not voted) as bigint) n_zero_filled
from (select t.room_id, t.task_id, m.person_id,
        exists (select 1 from b_vote_log v where v.room_id = t.room_id and v.task_id = t.task_id
                and v.person_id = m.person_id) voted
      from b_tasks t join members m on t.room_id = m.room_id) group by room_id, task_id""")
def q_zero_fill_votes(spark, sf):
    return M.zero_fill_votes(B.b_connections(spark, sf), B.b_tasks(spark, sf), B.b_vote_log(spark, sf))


@register("creator_role", ["members", "b_rooms", "b_persons"], """select m.room_id, m.person_id,
  case when lower(rtrim(p.email)) = lower(rtrim(cp.email)) then 'Creator' else 'User' end role
from members m left join b_persons p on m.person_id = p.person_id
left join b_rooms r on m.room_id = r.room_id left join b_persons cp on cp.person_id = r.creator""")
def q_creator_role(spark, sf):
    pairs = M.room_members(B.b_connections(spark, sf))
    return M.creator_role(B.b_rooms(spark, sf), B.b_persons(spark, sf), pairs)


@register("room_exists", ["b_room_probes", "b_rooms"], """select probe,
  length(probe) = 36 and exists (select 1 from b_rooms r where lower(rtrim(r.room_guid)) = lower(rtrim(p.probe))) room_exists
from (select distinct probe from b_room_probes) p""")
def q_room_exists(spark, sf):
    return M.room_exists(B.b_rooms(spark, sf), B.b_room_probes(spark, sf))


@register("task_id_bounds", ["b_tasks"],
          "select room_id, min(task_id) first_task_id, max(task_id) last_task_id from b_tasks group by room_id")
def q_task_id_bounds(spark, sf):
    return M.task_id_bounds(B.b_tasks(spark, sf))


@register("latest_room", ["b_room_history"], """select creator, max(room_id) latest_room_id,
  arg_max(created, room_id) latest_created from b_room_history group by creator""")
def q_latest_room(spark, sf):
    return M.latest_room(B.b_room_history(spark, sf))


@register("cascade_delete", ["b_rooms", "b_tasks", "b_connections", "latest_votes", "task_median"], """
select 'tasks' table_name, count(*) n_kept from b_tasks where room_id not in (select room_id from b_rooms where not is_active)
union all select 'connections', count(*) from b_connections where room_id not in (select room_id from b_rooms where not is_active)
union all select 'votes', count(*) from latest_votes where room_id not in (select room_id from b_rooms where not is_active)
union all select 'results', count(*) from task_median where room_id not in (select room_id from b_rooms where not is_active)""")
def q_cascade_delete(spark, sf):
    rooms = B.b_rooms(spark, sf)
    kept = M.cascade_delete(rooms.filter(~F.col("is_active")), {
        "tasks": B.b_tasks(spark, sf), "connections": B.b_connections(spark, sf),
        "votes": _latest(spark, sf), "results": _medians(spark, sf)})
    out = None
    for name, df in kept.items():
        c = df.agg(F.count(F.lit(1)).alias("n_kept")).select(F.lit(name).alias("table_name"), "n_kept")
        out = c if out is None else out.unionByName(c)
    return out


SNAP_SUMMARY_SQL = """select r.room_id, case when r.is_active then null else 'UnknownRoom' end error,
  case when r.is_active then r.name_room end name_room,
  case when r.is_active then cast((select count(*) from members m join b_persons p on m.person_id = p.person_id
                                   where m.room_id = r.room_id) as int) end n_persons,
  case when r.is_active then cast((select count(*) from b_tasks t where t.room_id = r.room_id) as int) end n_tasks,
  case when r.is_active then cast((select count(*) from latest_votes v join b_tasks t on v.task_id = t.task_id
                                   where t.room_id = r.room_id) as int) end n_person_tasks,
  case when r.is_active then cast(coalesce((select sum(v.score) from latest_votes v join b_tasks t on v.task_id = t.task_id
                                   where t.room_id = r.room_id), 0) as bigint) end sum_scores,
  case when r.is_active then cast((select count(*) from task_median m join b_tasks t on m.task_id = t.task_id
                                   where t.room_id = r.room_id and m.median is not null) as int) end n_medians,
  case when r.is_active then cast(nullif((select count(*) from members m join b_persons p on m.person_id = p.person_id
                                   where m.room_id = r.room_id), 0) as int) end last_person_id
from b_rooms r"""
SNAP_BLOCKS = ["b_rooms", "members", "b_persons", "b_tasks", "latest_votes", "task_median"]


@register("room_snapshot", SNAP_BLOCKS, SNAP_SUMMARY_SQL)
def q_room_snapshot(spark, sf):
    """Nested views of all rooms, digested into flat counts read from the arrays."""
    return S.snapshot_summary(_snapshot(spark, sf))


@register("room_snapshot_xml", SNAP_BLOCKS, SNAP_SUMMARY_SQL)
def q_room_snapshot_xml(spark, sf):
    """Views written as XML text, read back with from_xml, then digested."""
    return S.snapshot_summary(S.parse_room_xml(S.room_snapshot_xml(_snapshot(spark, sf))))


@register("fanout_updates", SNAP_BLOCKS + ["b_connections"], f"""select c.room_id, c.person_id, c.ts, s.error, s.n_persons, s.n_tasks
from b_connections c join ({SNAP_SUMMARY_SQL}) s on c.room_id = s.room_id""")
def q_fanout_updates(spark, sf):
    return S.fanout_updates(_snapshot(spark, sf), B.b_connections(spark, sf))


@register("coalesce_default", ["b_tasks", "task_median", "b_rooms"], """select t.room_id, t.task_id,
  case when coalesce(r.is_active, false) then coalesce(cast(m.median as varchar), 'Unknown') else 'UnknownRoom' end median_text
from b_tasks t left join task_median m on t.task_id = m.task_id left join b_rooms r on t.room_id = r.room_id""")
def q_coalesce_default(spark, sf):
    return S.coalesce_default(B.b_tasks(spark, sf), _medians(spark, sf), B.b_rooms(spark, sf))


@register("task_median_lookup", ["b_tasks", "task_median"], """select t.room_id, t.task_id, m.median
from b_tasks t left join task_median m on t.task_id = m.task_id""")
def q_task_median_lookup(spark, sf):
    """Correlated scalar lookup of a task's result, as a left join on the
    result table's unique task key."""
    return B.b_tasks(spark, sf).select("room_id", "task_id").join(
        _medians(spark, sf).select("task_id", "median"), "task_id", "left")


room_views = _snapshot
CELLS = (["b_rooms", "b_tasks", "latest_votes", "task_median"], """
select r.room_id, t.task_ord, t.name, false completed, false on_active, t.minutes, m.median, v.vote_ord, v.vote, v.score
from b_rooms r join (select *, cast(row_number() over (partition by room_id order by task_id) as int) task_ord from b_tasks) t
  on t.room_id = r.room_id
left join (select task_id, cast(row_number() over (partition by task_id order by person_id) as int) vote_ord, true vote, score
  from latest_votes) v on v.task_id = t.task_id
left join task_median m on m.task_id = t.task_id where r.is_active""")


@register("room_snapshot_cells", *CELLS)
def q_room_snapshot_cells(spark, sf):
    """Contents of the room views, cut into many pages and read back as flat cells."""
    return S.snapshot_cells(_snapshot(spark, sf, page_cells=500))


@register("room_snapshot_persons", ["b_rooms", "b_persons", "members"], """
select r.room_id, cast(row_number() over (partition by r.room_id order by p.person_id) as int) person_ord, p.login_name
from b_rooms r join members m on m.room_id = r.room_id join b_persons p on p.person_id = m.person_id where r.is_active""")
def q_room_snapshot_persons(spark, sf):
    """Persons of the room views, cut into many pages and read back."""
    return S.snapshot_persons(_snapshot(spark, sf, page_cells=50))

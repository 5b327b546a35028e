"""Queries on the room change log: the fold and what is read from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.operators import fold as FO
from estimark.operators import members as M
from estimark.operators import snapshot as S
from estimark.operators import votes as V
from estimark.plans.registry import register
from estimark.session import materialize
from estimark.sources import bindings as B
from estimark.sources.messages import parse_messages
from estimark.sources.xml import checked_commands, with_change


def commands(spark, sf):
    """Parsed, well-formed commands from the message text log."""
    p = parse_messages(B.b_messages(spark, sf)).filter(F.col("reason").isNull())
    p = with_change(p).filter(~F.col("__c.bad_xml"))
    return p.select("room_id", "ts", "event_id", "person_no", "kind",
                    F.col("__c.task_ordinal").alias("task_ordinal"), F.col("__c.score").alias("score"),
                    F.col("__c.vote").alias("vote"))


def log_members(spark, sf):
    """Who holds slots in a room."""
    return B.b_slots(spark, sf)


def run_fold(spark, sf):
    return FO.fold(commands(spark, sf), M.task_ordinals(B.b_tasks(spark, sf)), log_members(spark, sf))


def run_markers(spark, sf):
    """The fold of the markers alone, for what no vote enters."""
    return FO.fold(FO.markers_only(commands(spark, sf)), M.task_ordinals(B.b_tasks(spark, sf)))


def active_rooms(spark, sf):
    return FO.rooms_with_active(commands(spark, sf), M.task_ordinals(B.b_tasks(spark, sf)))


@register("votes_asof_active_task", ["o_votes"], "select room_id, event_id, ts, person_no, score, task_id from o_votes")
def q_votes_asof(spark, sf):
    return FO.votes_asof_active_task(run_fold(spark, sf))


@register("late_votes", ["o_votes"],
          "select room_id, event_id, ts, person_no, score, reason from o_votes where reason is not null")
def q_late_votes(spark, sf):
    return FO.late_votes(run_fold(spark, sf))


@register("apply_votes", ["o_votes"], """select room_id, task_id, person_no, vote, score from (
  select *, row_number() over (partition by room_id, task_id, person_no order by ts desc, event_id desc) rn
  from o_votes where reason is null) where rn = 1""")
def q_apply_votes(spark, sf):
    return FO.apply_votes(run_fold(spark, sf))


@register("stop_voting", ["o_results"], "select * from o_results")
def q_stop_voting(spark, sf):
    return FO.stop_voting(run_fold(spark, sf), B.b_dictionary(spark))


@register("start_voting", ["o_seg"], """select room_id, open_task task_id, count(*) n_starts, min(opened_ts) first_started,
  max(opened_ts) last_started from o_seg where open_task is not null group by room_id, open_task""")
def q_start_voting(spark, sf):
    return FO.start_voting(run_markers(spark, sf))


@register("task_by_ordinal", ["o_seg"], """select room_id, opened_event event_id, opened_ordinal task_ordinal, mtask task_id
from o_seg where opener = 'StartVoting'""")
def q_task_by_ordinal(spark, sf):
    return FO.task_by_ordinal(run_markers(spark, sf))


@register("room_has_active", ["o_active"], "select room_id, has_active from o_active")
def q_room_has_active(spark, sf):
    return active_rooms(spark, sf)


@register("voted_on_active", ["o_active", "o_votes", "b_slots"], """select a.room_id, a.active_task task_id, s.person_no person_id,
  exists (select 1 from o_votes v where v.reason is null and v.room_id = a.room_id and v.task_id = a.active_task
    and v.person_no = s.person_no and v.vote) has_voted
from o_active a join b_slots s on s.room_id = a.room_id where a.active_task is not null""")
def q_voted_on_active(spark, sf):
    """Who has voted on the task that each room is voting on."""
    f = run_fold(spark, sf)
    active = FO.room_state(f).select("room_id", F.col("active_task").alias("task_id"))
    members = log_members(spark, sf).select("room_id", F.col("person_no").alias("person_id"))
    votes = FO.apply_votes(f).withColumnRenamed("person_no", "person_id")
    return V.voted_on_active(active, members, votes)


@register("room_state_fold", ["o_seg", "o_active", "o_results"], """select t.room_id, t.task_id,
  coalesce(a.active_task = t.task_id, false) on_active, t.completed, t.n_segments, r.median
from (select room_id, open_task task_id, bool_or(completed) completed, count(*) n_segments from o_seg
      where open_task is not null group by room_id, open_task) t
left join o_active a on a.room_id = t.room_id left join o_results r on r.room_id = t.room_id and r.task_id = t.task_id""")
def q_room_state_fold(spark, sf):
    return FO.room_state_fold(run_fold(spark, sf), B.b_dictionary(spark))


@register("latest_active_task", ["o_seg"], """select room_id, open_task task_id, opened_ts started_ts, closer is null still_open
from (select *, row_number() over (partition by room_id order by opened_ts desc, opened_event desc) rn
      from o_seg where open_task is not null) where rn = 1""")
def q_latest_active_task(spark, sf):
    return FO.latest_active_task(run_markers(spark, sf))


@register("task_status", ["b_tasks", "o_seg", "o_first"], """select t.room_id, t.task_id,
  case when t.task_id = a.active_task then 'active' when f.task_id is not null then 'completed'
       when a.active_task is not null then 'blocked' else 'idle' end status
from b_tasks t left join (select room_id, open_task active_task from (
    select *, row_number() over (partition by room_id order by seg desc) rn from o_seg) where rn = 1) a
  on a.room_id = t.room_id
left join o_first f on f.room_id = t.room_id and f.task_id = t.task_id""")
def q_task_status(spark, sf):
    return FO.task_status(B.b_tasks(spark, sf), run_markers(spark, sf))


@register("time_box", ["o_seg", "b_tasks"], """select s.room_id, s.seg, s.open_task task_id, s.opened_ts start_ts,
  s.closed_ts end_ts, t.minutes, s.opened_ts + to_seconds(cast(t.minutes as bigint) * 60) deadline,
  date_diff('second', s.opened_ts, s.closed_ts) elapsed_s,
  case when s.closed_ts is not null then
    greatest(cast(t.minutes as bigint) * 60 - date_diff('second', s.opened_ts, s.closed_ts), 0) end remaining_s,
  date_diff('second', s.opened_ts, s.closed_ts) > cast(t.minutes as bigint) * 60 overrun,
  case when s.closed_ts is not null and t.minutes is not null then
    cast(floor(greatest(cast(t.minutes as bigint) * 60 - date_diff('second', s.opened_ts, s.closed_ts), 0) / 60) as bigint)
    || '-m: ' || (greatest(cast(t.minutes as bigint) * 60 - date_diff('second', s.opened_ts, s.closed_ts), 0) % 60)
    || '-sec' end countdown
from o_seg s left join b_tasks t on t.task_id = s.open_task where s.open_task is not null""")
def q_time_box(spark, sf):
    return FO.time_box(run_markers(spark, sf), B.b_tasks(spark, sf))


@register("finish_room", ["b_rooms", "o_cmd"], """select r.room_id, r.is_active and f.deleted is null is_active, f.deleted
from b_rooms r left join (select room_id, min(ts) deleted from o_cmd where kind = 'FinishPlanning' group by room_id) f
  on f.room_id = r.room_id""")
def q_finish_room(spark, sf):
    return FO.finish_room(B.b_rooms(spark, sf), commands(spark, sf))


QUARANTINE_SQL = """select room_id, event_id, reason from (
  select room_id, event_id, case when len(string_split(msg, '==')) > 2 then 'bad_arity'
    when string_split(msg, '==')[1] not in ('ChangeVote', 'ChangeGetVM', 'StartVoting', 'StopVoting', 'FinishPlanning')
    then 'unknown_kind' end reason from b_messages) where reason is not null
union all select room_id, event_id, 'bad_xml' from b_commands where fault = 'xml'
union all select room_id, event_id, reason from o_votes where reason is not null
union all select room_id, opened_event, 'unknown_ordinal' from o_seg where opener = 'StartVoting' and mtask is null
union all select s.room_id, s.opened_event, 'overlapping_start' from o_seg s join o_seg p
  on p.room_id = s.room_id and p.seg = s.seg - 1 where s.opener = 'StartVoting' and p.open_task is not null
union all select room_id, opened_event, 'already_completed' from o_seg where opener = 'StartVoting' and already_completed"""


@register("quarantine", ["b_messages", "b_commands", "o_votes", "o_seg"], QUARANTINE_SQL)
def q_quarantine(spark, sf):
    from estimark.operators.quarantine import refused_and_late
    checked = materialize(checked_commands(parse_messages(B.b_messages(spark, sf))).drop("msg", "payload"))
    f = FO.fold(checked.filter(F.col("reason").isNull()).drop("reason"), M.task_ordinals(B.b_tasks(spark, sf)), log_members(spark, sf))
    return refused_and_late(checked, f)


@register("results_grid", ["latest_votes", "b_persons", "task_median", "o_active"], """select v.room_id, v.task_id,
  cast(row_number() over (partition by v.task_id order by v.person_id) as int) person_ord, v.person_id, p.login_name,
  case when coalesce(a.has_active, false) then null else v.score end score, m.median
from latest_votes v join b_persons p on p.person_id = v.person_id
left join task_median m on m.task_id = v.task_id left join o_active a on a.room_id = v.room_id""")
def q_results_grid(spark, sf):
    from estimark.operators.grid import results_grid
    votes = materialize(V.latest_vote(B.b_vote_log(spark, sf)))  # reduced once, read for ordinals and medians
    return results_grid(votes, B.b_persons(spark, sf), V.task_median(votes, B.b_dictionary(spark)), active_rooms(spark, sf))


APPLY_SQL = """select room_id, task_id, person_no, vote, score from (
  select *, row_number() over (partition by room_id, task_id, person_no order by ts desc, event_id desc) rn
  from o_votes where reason is null) where rn = 1"""

VIEWS_AFTER_LOG_SQL = f"""select r.room_id, case when r.is_active then null else 'UnknownRoom' end error,
  case when r.is_active then r.name_room end name_room,
  case when r.is_active then cast((select count(*) from b_slots m
    join b_persons p on m.person_no = p.person_id where m.room_id = r.room_id) as int) end n_persons,
  case when r.is_active then cast((select count(*) from b_tasks t where t.room_id = r.room_id) as int) end n_tasks,
  case when r.is_active then cast((select count(*) from ({APPLY_SQL}) v join b_tasks t on v.task_id = t.task_id
    where t.room_id = r.room_id) as int) end n_person_tasks,
  case when r.is_active then cast(coalesce((select sum(v.score) from ({APPLY_SQL}) v join b_tasks t on v.task_id = t.task_id
    where t.room_id = r.room_id), 0) as bigint) end sum_scores,
  case when r.is_active then cast((select count(*) from o_results m join b_tasks t on m.task_id = t.task_id
    where t.room_id = r.room_id and m.median is not null) as int) end n_medians,
  case when r.is_active then cast(nullif((select count(*) from b_slots m
    join b_persons p on m.person_no = p.person_id where m.room_id = r.room_id), 0) as int) end last_person_id
from (select b.* replace (b.is_active and f.room_id is null as is_active) from b_rooms b
  left join (select distinct room_id from o_cmd where kind = 'FinishPlanning') f on f.room_id = b.room_id) r
where r.room_id in (select room_id from o_cmd)"""
VIEW_BLOCKS = ["b_rooms", "b_tasks", "b_persons", "b_slots", "o_cmd", "o_votes", "o_results"]


@register("snapshot_on_change", VIEW_BLOCKS, VIEWS_AFTER_LOG_SQL)
def q_snapshot_on_change(spark, sf):
    """Views of the rooms the log touched, rebuilt from the folded state:
    tasks with their active / completed flags, the applied votes and results."""
    from estimark.operators.views import views_after_log
    f = run_fold(spark, sf)
    snap = views_after_log(f, B.b_rooms(spark, sf), B.b_tasks(spark, sf), B.b_persons(spark, sf),
                           log_members(spark, sf), B.b_dictionary(spark))
    return S.snapshot_summary(snap)


OPEN_ROOMS_SQL = """(select b.room_id from b_rooms b where b.is_active and b.room_id in (select room_id from o_cmd)
  and b.room_id not in (select room_id from o_cmd where kind = 'FinishPlanning'))"""
CELLS_AFTER_LOG_SQL = f"""select r.room_id, t.task_ord, t.name, coalesce(s.completed, false) completed,
  coalesce(a.active_task = t.task_id, false) on_active, t.minutes, m.median, v.vote_ord, v.vote, v.score
from {OPEN_ROOMS_SQL} r join (select *, cast(row_number() over (partition by room_id order by task_id) as int) task_ord from b_tasks) t
  on t.room_id = r.room_id
left join (select open_task, bool_or(completed) completed from o_seg where open_task is not null group by open_task) s on s.open_task = t.task_id
left join o_active a on a.room_id = t.room_id left join o_results m on m.task_id = t.task_id
left join (select task_id, cast(row_number() over (partition by task_id order by person_no) as int) vote_ord, vote, score
  from ({APPLY_SQL})) v on v.task_id = t.task_id"""
CELL_BLOCKS = ["b_rooms", "b_tasks", "b_persons", "o_cmd", "o_seg", "o_active", "o_votes", "o_results"]


@register("snapshot_on_change_cells", CELL_BLOCKS, CELLS_AFTER_LOG_SQL)
def q_snapshot_on_change_cells(spark, sf):
    """Contents of the views of the rooms the log touched, as flat cells."""
    from estimark.operators.views import views_after_log
    f = run_fold(spark, sf)
    return S.snapshot_cells(views_after_log(f, B.b_rooms(spark, sf), B.b_tasks(spark, sf), B.b_persons(spark, sf),
                                            log_members(spark, sf), B.b_dictionary(spark)))

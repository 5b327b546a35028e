"""The stand-in input blocks as portable SQL, for the DuckDB oracle.

They mirror ``estimark.sources.bindings`` one to one.
"""

from __future__ import annotations

CARD = ("case {n} % 11 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 5 when 5 then 8 "
        "when 6 then 13 when 7 then 20 when 8 then 40 when 9 then 777 else 999 end")

BLOCKS: dict[str, str] = {
    "b_rooms": """select distinct cast(substr(p_brand, 7) as int) room_id, p_brand name_room,
  substr(md5(p_brand),1,8) || '-' || substr(md5(p_brand),9,4) || '-' || substr(md5(p_brand),13,4) || '-' ||
  substr(md5(p_brand),17,4) || '-' || substr(md5(p_brand),21,12) room_guid,
  cast(substr(p_brand, 7) as int) % 5 <> 0 is_active, cast(substr(p_brand, 7) as bigint) creator
from part""",
    "b_tasks": "select p_partkey task_id, cast(substr(p_brand, 7) as int) room_id, p_name name, p_size % 12 as minutes from part",
    "b_persons": "select s_suppkey person_id, s_name login_name, lower(replace(s_name, '#', '.')) || '@ex.io' email from supplier",
    "b_vote_log": f"""select cast(substr(p_brand, 7) as int) room_id, l_partkey task_id, l_suppkey person_id,
  {CARD.format(n='cast(l_quantity as int)')} score,
  l_shipdate ts, l_orderkey, l_linenumber, l_quantity
from lineitem join part on l_partkey = p_partkey""",
    "b_connections": """select cast(substr(p_brand, 7) as int) room_id, l_suppkey person_id, l_shipdate ts
from lineitem join part on l_partkey = p_partkey""",
    "b_dictionary": "select 999 score, 'Coffee break' meaning union all select 777, 'Question' union all select 0, 'Not voice'",
    "b_accounts": """select c_custkey account_id, c_name login_name,
  lower(case when c_custkey % 2 = 0 then replace(c_name, '#', '.') else c_name end) || '@ex.io' email from customer""",
    "b_credentials": """select c_custkey account_id, lower(replace(c_name, '#', '.')) || '@ex.io' email,
  md5(case c_custkey % 3 when 0 then '1-URGENT' when 1 then '2-HIGH' else '3-MEDIUM' end) password from customer""",
    "b_attempts": """select o_orderkey attempt_id, lower(replace(c_name, '#', '.')) || '@ex.io' email, o_orderpriority plain,
  case when o_orderkey % 2 = 0 then replace(c_name, '#', '') else c_name end username
from orders join customer on o_custkey = c_custkey""",
    "b_redeems": """select o_orderkey redeem_id, o_orderdate ts, md5(cast(o_orderkey - o_orderkey % 2 as string)) link,
  md5(o_orderpriority) new_password from orders""",
    "b_room_requests": """select cast(floor(p_partkey / 4) as bigint) request_id, p_partkey % 4 as pos, p_name as name,
  p_size % 12 as mins from part""",
    "b_registrations": """select o_orderkey request_id, o_orderdate ts,
  case when o_orderkey % 3 = 0 then c_name else 'new' || cast(o_orderkey % 5000 as string) end login_name,
  case when o_orderkey % 4 in (0, 3) then lower(case when c_custkey % 2 = 0 then replace(c_name, '#', '.') else c_name end)
    else 'new.' || cast(o_orderkey % 7000 as string) end || '@ex.io' email
from orders join customer on o_custkey = c_custkey""",
    "b_recovery_requests": """select o_custkey account_id, o_orderdate ts, o_orderkey, md5(cast(o_orderkey as string)) link,
  o_orderstatus = 'F' is_base, o_orderkey % 3 <> 0 is_active
from orders""",
    "b_commands": f"""select user_id room_id, ts, event_id, event_id % 7 person_no,
  case event_type when 'signup' then 'StartVoting' when 'purchase' then 'StopVoting' when 'click' then 'ChangeVote'
    when 'view' then case when event_id % 23 = 11 then 'FinishPlanning' else 'ChangeGetVM' end else 'Bogus' end kind,
  case when event_id % 41 = 5 then 'arity' when event_id % 43 = 7 and event_type in ('signup', 'click') then 'xml' end fault,
  cast(regexp_extract(props, '[0-9]+', 0) as int) % 5 + 1 task_ordinal,
  {CARD.format(n="cast(regexp_extract(props, '[0-9]+', 0) as int)")} score
from events""",
}

GUID = ("substr(md5({c}),1,8) || '-' || substr(md5({c}),9,4) || '-' || substr(md5({c}),13,4) || '-' || "
        "substr(md5({c}),17,4) || '-' || substr(md5({c}),21,12)")

BLOCKS["b_room_probes"] = (f"select case p_partkey % 3 when 0 then {GUID.format(c='p_brand')} "
                           f"when 1 then {GUID.format(c='p_type')} "
                           f"else substr({GUID.format(c='p_brand')}, 1, 35) end probe from part")
BLOCKS["b_room_history"] = "select o_orderkey room_id, o_custkey creator, o_orderdate created from orders"

BLOCKS["b_messages"] = """select room_id, ts, event_id, person_no,
  case when kind = 'ChangeGetVM' then kind else kind || '==' || case when fault = 'xml' then '<Change><AddVote vote='
    when kind = 'StartVoting' then '<Change><StartVoting taskId="' || cast(task_ordinal as varchar) || '" isCurrentActive="1"/></Change>'
    when kind = 'ChangeVote' then '<Change><AddVote vote="1" score="' || cast(score as varchar) || '"/></Change>'
    else '' end end || case when fault = 'arity' then '==a==b' else '' end msg
from b_commands"""
BLOCKS["b_slots"] = "select distinct room_id, person_no from b_commands where (room_id * 7 + person_no) % 11 <> 0"

# Imported tables as they may arrive, with NULL, orphan and duplicate keys, for the audits.  ``{name}`` is another
# block; the text runs on Spark (``bindings.faulty``) and DuckDB alike.
FAULTY: dict[str, tuple[tuple[str, ...], str]] = {
    "d_rooms": (("b_rooms",), """select room_id, case when room_id % 11 = 4 then null else name_room end name_room,
  case when room_id % 13 = 5 then null else creator end creator, room_guid from {b_rooms}
union all select room_id + 1000, name_room, creator, upper(room_guid) || '  ' from {b_rooms} where room_id % 6 = 1"""),
    "d_persons": (("b_persons",), """select person_id,
  case when person_id % 19 = 4 then null when person_id % 10 = 2 then 'Same ' || cast(person_id % 4 as string) else login_name end login_name,
  case when person_id % 23 = 6 then null when person_id % 10 = 3 then 'DUP' || cast(person_id % 3 as string) || '@ex.io ' else email end email
from {b_persons}"""),
    "d_accounts": (("b_accounts",), """select account_id, login_name, email from {b_accounts}
union all select account_id + 1000000, upper(login_name), 'x' || email from {b_accounts} where account_id % 97 = 1
union all select account_id + 2000000, 'x' || login_name, email || ' ' from {b_accounts} where account_id % 89 = 2"""),
    "d_tasks": (("b_tasks",), """select task_id, case when task_id % 37 = 6 then null when task_id % 31 = 5 then 9999 else room_id end room_id,
  case when task_id % 41 = 7 then null else name end name, case when task_id % 43 = 8 then null else minutes end as minutes,
  case when task_id % 47 = 9 then null else task_id % 2 = 0 end on_active,
  case when task_id % 53 = 10 then null else task_id % 3 = 0 end completed,
  case when task_id % 59 = 11 then null else task_id end changed from {b_tasks}"""),
    "d_connections": (("b_connections",), """select case when person_id % 17 = 3 then null when room_id % 7 = 2 and person_id % 5 = 1
  then room_id + 500 else room_id end room_id, case when person_id % 29 = 8 then person_id + 100000 else person_id end person_id
from {b_connections}"""),
    "d_votes": (("b_vote_log",), """select case when l_orderkey % 61 = 1 then null when l_orderkey % 67 = 2 then room_id + 500 else room_id end room_id,
  case when l_orderkey % 71 = 3 then null when l_orderkey % 73 = 4 then task_id + 5000000 else task_id end task_id,
  case when l_orderkey % 79 = 5 then null when l_orderkey % 83 = 6 then person_id + 100000 else person_id end person_id,
  case when l_orderkey % 89 = 7 then null else l_orderkey % 2 = 0 end vote,
  case when l_orderkey % 97 = 8 then null else score end score from {b_vote_log}"""),
    "d_results": (("task_median",), """select case when task_id % 29 = 4 then null when task_id % 31 = 5 then task_id + 5000000 else task_id end task_id,
  case when task_id % 37 = 6 then null when task_id % 41 = 7 then room_id + 500 else room_id end room_id,
  case when task_id % 43 = 8 then null else task_id end created from {task_median}
union all select task_id, room_id, task_id from {task_median} where task_id % 47 = 9"""),
    "d_recovery": (("b_recovery_requests",), """select case when o_orderkey % 61 = 1 then null when o_orderkey % 67 = 2
  then account_id + 10000000 else account_id end account_id, case when o_orderkey % 71 = 3 then null else link end link,
  case when o_orderkey % 73 = 4 then null else is_active end is_active, case when o_orderkey % 79 = 5 then null else ts end requested
from {b_recovery_requests}"""),
    "d_views": (("b_rooms",), "select case when room_id % 8 = 3 then null when room_id % 9 = 2 then room_id + 700 else room_id end room_id from {b_rooms}"),
    "d_dictionary": (("b_dictionary",), "select score, meaning from {b_dictionary} union all select cast(null as int), 'Lost card'"),
    "d_errors": (("b_commands",), """select event_id error_id, case when event_id % 101 = 7 then null else kind end error_text,
  case when event_id % 103 = 9 then null else ts end ts from {b_commands} where kind = 'Bogus'"""),
}

# Blocks that other blocks or oracles reuse, defined on top of BLOCKS.
DERIVED: dict[str, str] = {
    "latest_votes": """select room_id, task_id, person_id, score from (
  select *, row_number() over (partition by task_id, person_id
    order by ts desc, l_orderkey desc, l_linenumber desc, l_quantity desc) rn
  from b_vote_log) where rn = 1""",
}

DERIVED["task_median"] = """select room_id, task_id,
  cast(quantile_cont(case when score not in (select score from b_dictionary) then score end, 0.5) as decimal(9,2)) median
from latest_votes group by room_id, task_id"""
DERIVED["members"] = "select distinct room_id, person_id from b_connections"

KNOWN_KINDS = "('ChangeVote', 'ChangeGetVM', 'StartVoting', 'StopVoting', 'FinishPlanning')"
DERIVED["o_cmd"] = f"""select room_id, ts, event_id, person_no, kind,
  case when kind = 'StartVoting' then task_ordinal end task_ordinal,
  case when kind = 'ChangeVote' then score end score, case when kind = 'ChangeVote' then true end vote
from b_commands where kind in {KNOWN_KINDS} and fault is null"""
DERIVED["o_tord"] = """select room_id, task_id, cast(row_number() over (partition by room_id order by task_id) as int) task_ord
from b_tasks"""
DERIVED["o_ev"] = """select c.*, t.task_id start_task,
  cast(sum(case when c.kind in ('StartVoting', 'StopVoting') then 1 else 0 end) over (partition by c.room_id
    order by c.ts, c.event_id rows between unbounded preceding and current row) as bigint) seg
from o_cmd c left join o_tord t on c.kind = 'StartVoting' and t.room_id = c.room_id and t.task_ord = c.task_ordinal"""
DERIVED["o_mk"] = """select room_id, seg, kind opener, start_task mtask, ts opened_ts, event_id opened_event,
  task_ordinal opened_ordinal from o_ev where kind in ('StartVoting', 'StopVoting')"""
DERIVED["o_seg0"] = """select m.*, n.opener closer, n.opened_ts closed_ts, n.opened_event closed_event,
  case when m.opener = 'StartVoting' then m.mtask end open_task
from o_mk m left join o_mk n on n.room_id = m.room_id and n.seg = m.seg + 1"""
DERIVED["o_first"] = """select room_id, task_id, first_seg, completed_ts from (
  select room_id, open_task task_id, seg first_seg, closed_ts completed_ts,
    row_number() over (partition by room_id, open_task order by seg) rn
  from o_seg0 where open_task is not null and closer = 'StopVoting') where rn = 1"""
DERIVED["o_seg"] = """select s.*, coalesce(s.open_task is not null and s.closer = 'StopVoting', false) completed,
  coalesce(s.seg > f.first_seg, false) already_completed
from o_seg0 s left join o_first f on f.room_id = s.room_id and f.task_id = s.open_task"""
DERIVED["o_votes"] = """select e.room_id, e.event_id, e.ts, e.person_no, e.score, e.vote, e.seg, s.open_task task_id,
  case when s.open_task is null then 'no_active_task' when m.room_id is null then 'no_slot' end reason
from o_ev e left join o_seg s on s.room_id = e.room_id and s.seg = e.seg
left join b_slots m on m.room_id = e.room_id and m.person_no = e.person_no
where e.kind = 'ChangeVote'"""
DERIVED["o_results"] = """select f.room_id, f.task_id, f.completed_ts, m.median from o_first f left join (
  select room_id, task_id,
    cast(quantile_cont(case when score not in (select score from b_dictionary) then score end, 0.5) as decimal(9,2)) median
  from (select v.*, row_number() over (partition by v.room_id, v.task_id, v.person_no order by v.ts desc, v.event_id desc) rn
        from o_votes v join o_first f on f.room_id = v.room_id and f.task_id = v.task_id
        where v.reason is null and v.seg <= f.first_seg) where rn = 1
  group by room_id, task_id) m on m.room_id = f.room_id and m.task_id = f.task_id"""
DERIVED["o_active"] = """select r.room_id, l.active_task, coalesce(l.active_task is not null, false) has_active
from (select distinct room_id from o_cmd) r left join (
  select room_id, open_task active_task from (
    select *, row_number() over (partition by room_id order by seg desc) rn from o_seg) where rn = 1) l
on l.room_id = r.room_id"""

# 48 bits of a cell of a view; a view's digest is the sum over its cells, kept along the log as running sums of what changed
HASH = "cast('0x' || substr(md5({x}), 1, 12) as bigint)"
VOTE_CELL = HASH.format(x="'v|' || task_id || '|' || person_no || '|' || coalesce(cast({v} as varchar), 'none') || '|' || "
                          "coalesce(cast({s} as varchar), 'none')")
DERIVED["o_views"] = f"""select room_id, cast(row_number() over w as bigint) seq, event_id, ts, kind, task_id, person_no, vote, score, active_task,
  cast(sum(new_cell) over w as bigint) n_cells, cast(sum(score_change) over w as bigint) sum_scores,
  cast(sum(new_done) over w as bigint) n_completed, bool_or(kind = 'FinishPlanning') over w finished,
  cast((sum(cell_change + done_change) over w + {HASH.format(x="'a|' || coalesce(cast(active_task as varchar), 'none')")}
    + case when bool_or(kind = 'FinishPlanning') over w then {HASH.format(x="'f'")} else 0 end) % 281474976710656 as bigint) digest
from (select e.room_id, e.event_id, e.ts, e.kind, e.person_no, v.vote, v.score, s.open_task active_task,
    case e.kind when 'ChangeVote' then v.task_id when 'StartVoting' then e.start_task when 'StopVoting' then p.open_task end task_id,
    coalesce(v.new_cell, 0) new_cell, coalesce(v.score_change, 0) score_change, coalesce(v.cell_change, 0) cell_change,
    case when f.task_id is not null then 1 else 0 end new_done,
    case when f.task_id is not null then {HASH.format(x="'t|' || f.task_id || '|' || coalesce(cast(r.median as varchar), 'none')")} else 0 end done_change
  from o_ev e left join o_seg s on s.room_id = e.room_id and s.seg = e.seg
  left join o_seg p on e.kind = 'StopVoting' and p.room_id = e.room_id and p.seg = e.seg - 1
  left join o_first f on f.room_id = p.room_id and f.task_id = p.open_task and f.first_seg = p.seg
  left join o_results r on r.room_id = f.room_id and r.task_id = f.task_id
  left join (select room_id, event_id, task_id, vote, score, case when pe is null then 1 else 0 end new_cell,
      coalesce(score, 0) - case when pe is null then 0 else coalesce(ps, 0) end score_change,
      cast({VOTE_CELL.format(v="vote", s="score")} as hugeint) - case when pe is null then 0 else {VOTE_CELL.format(v="pv", s="ps")} end cell_change
    from (select *, lag(event_id) over k pe, lag(vote) over k pv, lag(score) over k ps from o_votes where reason is null
      window k as (partition by room_id, task_id, person_no order by ts, event_id))) v on v.room_id = e.room_id and v.event_id = e.event_id)
window w as (partition by room_id order by ts, event_id rows between unbounded preceding and current row)"""
SENDER = "case when {n} < 10 then 'supplier.' || lpad(cast({n} as varchar), 9, '0') || '@ex.io' else 'nobody@ex.io' end"
BLOCKS["b_raw_messages"] = f"""select event_id, ts,
  case when event_id % 3 = 0 then upper(g) when event_id % 4 = 1 then g || '  ' else g end room_guid,
  case when event_id % 5 = 0 then upper(m) || ' ' else m end email
from (select event_id, ts, {GUID.format(c="('Brand#' || user_id)")} g, {SENDER.format(n="(event_id % 13)")} m from events)"""
BLOCKS["b_connects"] = "select event_id connect_id, user_id room_id, event_id % 7 person_no, ts from events where event_id % 9 = 4"

DEPENDS = {"o_views": ["o_ev", "o_seg", "o_first", "o_results", "o_votes"], "o_cmd": ["b_commands"], "o_tord": ["b_tasks"], "o_ev": ["o_cmd", "o_tord"], "o_mk": ["o_ev"],
           "o_seg0": ["o_mk"], "o_first": ["o_seg0"], "o_seg": ["o_seg0", "o_first"],
           "o_votes": ["o_ev", "o_seg", "b_slots"], "b_slots": ["b_commands"], "o_results": ["o_votes", "o_first", "b_dictionary"],
           "o_active": ["o_cmd", "o_seg"],
           "b_messages": ["b_commands"], "latest_votes": ["b_vote_log"], "task_median": ["latest_votes", "b_dictionary"],
           "members": ["b_connections"]}


for _name, (_deps, _text) in FAULTY.items():
    DERIVED[_name] = _text.format(**{d: d for d in _deps})
    DEPENDS[_name] = list(_deps)


def with_blocks(names: list[str], body: str, recursive: bool = False) -> str:
    """``WITH`` clause holding ``names`` (and what they depend on), then ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as ({BLOCKS.get(n) or DERIVED[n]})" for n in order]
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n" + body

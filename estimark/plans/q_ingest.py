"""Queries on ingest: XML task lists, change messages, account rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.functions import rules as R
from estimark.operators import accounts as A
from estimark.operators import requests as RQ
from estimark.plans.registry import register
from estimark.sources import bindings as B
from estimark.sources.messages import parse_messages
from estimark.sources.xml import shred_tasks, with_change

REQ_SQL = """select request_id, cast(row_number() over (partition by request_id order by pos) - 1 as int) pos,
  name, mins as minutes from b_room_requests"""


@register("xml_task_shred", ["b_room_requests"], REQ_SQL)
def q_xml_task_shred(spark, sf):
    return shred_tasks(B.b_room_request_xml(spark, sf))


BAD_TASK = "(name is null or rtrim(name) = '' or mins is null or mins = 0 or mins not between 0 and 10)"
UI_BAD_TASK = "(name is null or length(name) <= 1 or mins is null or mins not between 1 and 10)"


@register("room_request_valid", ["b_room_requests"], f"""select request_id, cast(count(*) as int) n_tasks,
  not bool_or({BAD_TASK}) is_valid from b_room_requests group by request_id""")
def q_room_request_valid(spark, sf):
    return RQ.room_request_valid(B.b_room_request_xml(spark, sf))


@register("task_request_valid_ui", ["b_room_requests"], f"""select request_id, cast(count(*) as int) n_tasks,
  not bool_or({UI_BAD_TASK}) is_valid from b_room_requests group by request_id""")
def q_task_request_valid_ui(spark, sf):
    return RQ.room_request_valid(B.b_room_request_xml(spark, sf), strict=True)


@register("create_rooms", ["b_room_requests"], f"""select request_id room_id,
  cast(row_number() over (partition by request_id order by pos) as int) task_ord, name, mins as minutes
from b_room_requests where request_id in (
  select request_id from b_room_requests group by request_id having not bool_or({BAD_TASK}))""")
def q_create_rooms(spark, sf):
    rooms, tasks = RQ.create_rooms(B.b_room_request_xml(spark, sf))
    return tasks.join(rooms.select("room_id"), "room_id", "left_semi")


@register("distinct_task_names", ["b_room_requests"], f"""select request_id, pos, name, minutes from ({REQ_SQL.replace(
    "from b_room_requests", ", row_number() over (partition by request_id, name order by pos) rn from b_room_requests")})
where rn = 1""")
def q_distinct_task_names(spark, sf):
    return RQ.distinct_task_names(shred_tasks(B.b_room_request_xml(spark, sf)))


PARSE_SQL = """select room_id, ts, event_id, person_no, msg,
  case when len(string_split(msg, '==')) <= 2 then string_split(msg, '==')[1] end kind,
  case len(string_split(msg, '==')) when 2 then string_split(msg, '==')[2] when 1 then '' end payload,
  case when len(string_split(msg, '==')) > 2 then 'bad_arity'
       when string_split(msg, '==')[1] not in ('ChangeVote', 'ChangeGetVM', 'StartVoting', 'StopVoting', 'FinishPlanning')
       then 'unknown_kind' end reason
from b_messages"""


@register("parse_messages", ["b_messages"], PARSE_SQL)
def q_parse_messages(spark, sf):
    return parse_messages(B.b_messages(spark, sf))


@register("xml_change_parse", ["b_messages"], f"""select event_id, kind,
  case when kind = 'ChangeVote' then try_cast(regexp_extract(payload, 'vote="(-?[0-9]+)"', 1) as int) <> 0 end vote,
  case when kind = 'ChangeVote' then try_cast(regexp_extract(payload, 'score="(-?[0-9]+)"', 1) as int) end score,
  case when kind = 'StartVoting' then try_cast(regexp_extract(payload, 'taskId="(-?[0-9]+)"', 1) as int) end task_ordinal,
  payload not like '%</Change>' bad_xml
from ({PARSE_SQL}) where kind in ('ChangeVote', 'StartVoting') and reason is null""")
def q_xml_change_parse(spark, sf):
    p = parse_messages(B.b_messages(spark, sf)).filter(F.col("reason").isNull() & F.col("kind").isin(
        "ChangeVote", "StartVoting"))
    return with_change(p.select("event_id", "kind", "payload"), name="c").select(
        "event_id", "kind", F.when(F.col("kind") == "ChangeVote", F.col("c.vote")).alias("vote"),
        F.when(F.col("kind") == "ChangeVote", F.col("c.score")).alias("score"),
        F.when(F.col("kind") == "StartVoting", F.col("c.task_ordinal")).alias("task_ordinal"),
        F.col("c.bad_xml").alias("bad_xml"))


EMAIL_RE = R.EMAIL_PATTERN
PASSWORD_SQL = ("regexp_full_match(plain, '[" + R.PASSWORD_ALLOWED.replace("'", "''") + "]{6,24}') and "
                "regexp_matches(plain, '[" + R.PASSWORD_NEEDS_ONE.replace("'", "''") + "]')")


@register("email_valid", ["b_registrations"], f"""select request_id, email,
  coalesce(regexp_full_match(email, '{EMAIL_RE}'), false) email_valid from b_registrations""")
def q_email_valid(spark, sf):
    r = B.b_registrations(spark, sf)
    return r.select("request_id", "email", R.email_valid(F.col("email")).alias("email_valid"))


@register("password_valid", ["b_attempts"], f"""select attempt_id, plain,
  coalesce({PASSWORD_SQL}, false) password_valid from b_attempts""")
def q_password_valid(spark, sf):
    a = B.b_attempts(spark, sf)
    return a.select("attempt_id", "plain", R.password_valid(F.col("plain")).alias("password_valid"))


@register("username_valid", ["b_attempts"], """select attempt_id, username,
  coalesce(regexp_full_match(username, '[A-Za-z0-9]{3,24}'), false) username_valid from b_attempts""")
def q_username_valid(spark, sf):
    a = B.b_attempts(spark, sf)
    return a.select("attempt_id", "username", R.username_valid(F.col("username")).alias("username_valid"))


@register("resolve_keys", ["b_registrations", "b_accounts"], """select r.request_id, r.ts, r.login_name, r.email,
  a.account_id, case when a.account_id is null then 'unknown_email' end reason
from b_registrations r left join (select lower(rtrim(email)) k, min(account_id) account_id from b_accounts group by 1) a
  on lower(rtrim(r.email)) = a.k""")
def q_resolve_keys(spark, sf):
    return A.resolve_keys(B.b_registrations(spark, sf), B.b_accounts(spark, sf))


@register("email_known", ["b_registrations", "b_accounts"], """select r.*,
  exists (select 1 from b_accounts a where lower(rtrim(a.email)) = lower(rtrim(r.email))) known
from b_registrations r""")
def q_email_known(spark, sf):
    return A.email_known(B.b_registrations(spark, sf), B.b_accounts(spark, sf))


@register("credential_match", ["b_attempts", "b_credentials"], """select t.*,
  exists (select 1 from b_credentials c where lower(rtrim(c.email)) = lower(rtrim(t.email)) and c.password = md5(t.plain)) matched
from b_attempts t""")
def q_credential_match(spark, sf):
    return A.credential_match(B.b_attempts(spark, sf), B.b_credentials(spark, sf))


@register("register_users", ["b_registrations", "b_accounts"], """select r.*,
  case when exists (select 1 from b_accounts a where lower(rtrim(a.email)) = lower(rtrim(r.email))
                    and lower(rtrim(a.login_name)) = lower(rtrim(r.login_name))) then 'pair_exists'
       when exists (select 1 from b_accounts a where lower(rtrim(a.email)) = lower(rtrim(r.email))) then 'email_exists'
       when exists (select 1 from b_accounts a where lower(rtrim(a.login_name)) = lower(rtrim(r.login_name))) then 'login_exists'
       else 'inserted' end outcome
from b_registrations r""")
def q_register_users(spark, sf):
    return A.register_users(B.b_registrations(spark, sf), B.b_accounts(spark, sf))


RECOVERY_SQL = """select account_id, coalesce(c_link, b_link) link, c_link is not null or b_active is_active,
  coalesce(c_ts, b_ts) requested from (
  select coalesce(b.account_id, c.account_id) account_id, b.link b_link, b.ts b_ts, b.is_active b_active, c.link c_link, c.ts c_ts
  from (select * from (select *, row_number() over (partition by account_id order by ts desc, o_orderkey desc) rn
        from b_recovery_requests where is_base and account_id in (select account_id from b_accounts)) where rn = 1) b
  full join (select * from (select *, row_number() over (partition by account_id order by ts desc, o_orderkey desc) rn
        from b_recovery_requests where not is_base and account_id in (select account_id from b_accounts)) where rn = 1) c
  on b.account_id = c.account_id)"""


def _recovery(spark, sf):
    return A.recovery_state(B.b_recovery_requests(spark, sf), B.b_accounts(spark, sf))


@register("recovery_upsert", ["b_recovery_requests", "b_accounts"], RECOVERY_SQL)
def q_recovery_upsert(spark, sf):
    return _recovery(spark, sf)


@register("recovery_link_of", ["b_recovery_requests", "b_accounts"], f"""select a.account_id, a.email, s.link
from b_accounts a join ({RECOVERY_SQL}) s on a.account_id = s.account_id""")
def q_recovery_link_of(spark, sf):
    return A.recovery_link_of(B.b_accounts(spark, sf), _recovery(spark, sf))


@register("recovery_redeem", ["b_recovery_requests", "b_accounts", "b_redeems"], f"""select r.redeem_id, r.ts, r.link,
  case when ok then s.account_id end account_id, coalesce(ok, false) ok from (
  select r.*, s.account_id is not null and row_number() over (partition by lower(rtrim(r.link)) order by r.ts, r.redeem_id) = 1 ok,
    s.account_id from b_redeems r left join (select lower(rtrim(link)) k, max(account_id) account_id from ({RECOVERY_SQL})
    where is_active group by 1) s on lower(rtrim(r.link)) = s.k) r""".replace("case when ok then s.account_id", "case when ok then r.account_id"))
def q_recovery_redeem(spark, sf):
    return A.recovery_redeem(B.b_redeems(spark, sf), _recovery(spark, sf))


REDEEMED_SQL = f"""select r.*, row_number() over (partition by r.account_id order by r.ts desc, r.redeem_id desc) rn from (
  select d.redeem_id, d.ts, lower(rtrim(d.link)) k, d.new_password, s.account_id,
    row_number() over (partition by lower(rtrim(d.link)) order by d.ts, d.redeem_id) nth
  from b_redeems d join (select lower(rtrim(link)) k, max(account_id) account_id from ({RECOVERY_SQL}) where is_active group by 1) s
    on lower(rtrim(d.link)) = s.k) r where nth = 1"""


@register("recovery_redeem_passwords", ["b_recovery_requests", "b_accounts", "b_redeems"],
          f"select account_id, new_password as password from ({REDEEMED_SQL}) where rn = 1")
def q_recovery_redeem_passwords(spark, sf):
    """Passwords set by redeeming."""
    return A.redeemed_tables(B.b_redeems(spark, sf), _recovery(spark, sf))[0]


@register("recovery_redeem_links", ["b_recovery_requests", "b_accounts", "b_redeems"],
          f"""select account_id, link, is_active and lower(rtrim(link)) not in (select k from ({REDEEMED_SQL})) is_active, requested
from ({RECOVERY_SQL})""")
def q_recovery_redeem_links(spark, sf):
    """The links table after redeeming: used links inactive."""
    return A.redeemed_tables(B.b_redeems(spark, sf), _recovery(spark, sf))[1]


@register("register_users_rows", ["b_registrations", "b_accounts"], """select r.request_id, r.login_name, r.email,
  md5(r.login_name) as password, md5(cast(r.request_id as varchar) || '|' || lower(rtrim(r.email))) token
from b_registrations r
where not exists (select 1 from b_accounts a where lower(rtrim(a.email)) = lower(rtrim(r.email)))
  and not exists (select 1 from b_accounts a where lower(rtrim(a.login_name)) = lower(rtrim(r.login_name)))""")
def q_register_users_rows(spark, sf):
    """The Persons rows that the registrations insert (the binding's password is the login)."""
    out = A.register_users(B.b_registrations(spark, sf), B.b_accounts(spark, sf))
    return A.inserted_persons(out.withColumn("password", F.col("login_name")))


@register("latest_link", ["b_recovery_requests"],
          "select lower(rtrim(link)) link, arg_max(account_id, o_orderkey) account_id from b_recovery_requests group by 1")
def q_latest_link(spark, sf):
    return A.latest_link(B.b_recovery_requests(spark, sf))


REG_BATCH_SQL = """, base as (
  select r.*, lower(rtrim(r.email)) e, lower(rtrim(r.login_name)) l,
    row_number() over (order by r.ts, r.request_id) o,
    exists (select 1 from b_accounts a where lower(rtrim(a.email)) = lower(rtrim(r.email))
            and lower(rtrim(a.login_name)) = lower(rtrim(r.login_name))) bp,
    exists (select 1 from b_accounts a where lower(rtrim(a.email)) = lower(rtrim(r.email))) be,
    exists (select 1 from b_accounts a where lower(rtrim(a.login_name)) = lower(rtrim(r.login_name))) bl
  from b_registrations r),
rounds as (
  select 0 rnd, request_id, e, l, o, case when bp or be or bl then 'b' else 'u' end st from base
  union all
  select rnd + 1, request_id, e, l, o,
    case when st <> 'u' then st when nw then 'a' when ne or nl then 'r' else 'u' end
  from (select *, bool_or(nw) over (partition by e) ne, bool_or(nw) over (partition by l) nl from (
          select *, st = 'u' and o = min(case when st = 'u' then o end) over (partition by e)
                   and o = min(case when st = 'u' then o end) over (partition by l) nw,
                 count(case when st = 'u' then 1 end) over () n_u
          from rounds) where n_u > 0)),
final as (select * from rounds where rnd = (select max(rnd) from rounds)),
acc as (select * from final where st = 'a')
select b.request_id, b.ts, b.login_name, b.email,
  case when f.st = 'a' then 'inserted'
       when b.bp or exists (select 1 from acc where acc.e = b.e and acc.l = b.l and acc.o < b.o) then 'pair_exists'
       when b.be or exists (select 1 from acc where acc.e = b.e and acc.o < b.o) then 'email_exists'
       when b.bl or exists (select 1 from acc where acc.l = b.l and acc.o < b.o) then 'login_exists'
       else 'inserted' end outcome
from base b join final f on f.request_id = b.request_id"""


@register("register_users_batch", ["b_registrations", "b_accounts"], REG_BATCH_SQL, recursive=True)
def q_register_users_batch(spark, sf):
    """Registrations of one batch decided one at a time in (ts, request_id)
    order against the accounts and the requests accepted before them."""
    return A.register_users_in_batch(B.b_registrations(spark, sf), B.b_accounts(spark, sf))

"""Queries: constraint audits, texts, URL parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimark.functions import texts as TX
from estimark.operators import accounts as A
from estimark.operators import audits as AU
from estimark.operators import votes as V
from estimark.plans.oracle_bindings import FAULTY
from estimark.plans.registry import register
from estimark.sources import bindings as B
from estimark.sources.tables import read_table


def _latest(spark, sf):
    return V.latest_vote(B.b_vote_log(spark, sf))


def _faulty(spark, sf, *names):
    """The audited tables: imports with NULL, orphan and duplicate keys (``oracle_bindings.FAULTY``)."""
    make = {"b_rooms": B.b_rooms, "b_persons": B.b_persons, "b_accounts": B.b_accounts, "b_tasks": B.b_tasks,
            "b_connections": B.b_connections, "b_vote_log": B.b_vote_log, "b_recovery_requests": B.b_recovery_requests,
            "b_commands": B.b_commands, "b_dictionary": lambda s, _: B.b_dictionary(s),
            "task_median": lambda s, d: V.task_median(_latest(s, d), B.b_dictionary(s))}
    return {n: B.faulty(spark, n, **{d: make[d](spark, sf) for d in FAULTY[n][0]}) for n in names}


UNIQUE = [("rooms_guid", "d_rooms", "room_guid"), ("persons_login", "d_persons", "login_name"), ("persons_email", "d_persons", "email"),
          ("accounts_login", "d_accounts", "login_name"), ("accounts_email", "d_accounts", "email"),
          ("results_task", "d_results", "task_id")]


@register("audit_unique", ["d_rooms", "d_persons", "d_accounts", "d_results"], "\nunion all ".join(
    f"select '{n}' constraint_name, lower(rtrim(cast({c} as varchar))) key_value, count(*) n_rows from {t} "
    f"where {c} is not null group by 2 having count(*) > 1" for n, t, c in UNIQUE))
def q_audit_unique(spark, sf):
    t = _faulty(spark, sf, *dict.fromkeys(t for _, t, _ in UNIQUE))
    return AU.audit_unique({n: (t[table], c) for n, table, c in UNIQUE})


# The source's declared foreign keys (child table, key, parent table).
FOREIGN = [("connections_room", "d_connections", "room_id", "b_rooms"), ("connections_person", "d_connections", "person_id", "b_persons"),
           ("tasks_room", "d_tasks", "room_id", "b_rooms"), ("votes_task", "d_votes", "task_id", "b_tasks"),
           ("votes_room", "d_votes", "room_id", "b_rooms"), ("votes_person", "d_votes", "person_id", "b_persons"),
           ("results_task", "d_results", "task_id", "b_tasks"), ("results_room", "d_results", "room_id", "b_rooms"),
           ("recovery_account", "d_recovery", "account_id", "b_accounts"), ("views_room", "d_views", "room_id", "b_rooms")]


@register("audit_foreign_keys", ["b_rooms", "b_persons", "b_tasks", "b_accounts", "d_connections", "d_tasks", "d_votes", "d_results",
                                 "d_recovery", "d_views"], "\nunion all ".join(
    f"select '{n}' constraint_name, count(*) n_orphans from {c} c where {k} is not null "
    f"and not exists (select 1 from {p} p where p.{k} = c.{k})" for n, c, k, p in FOREIGN))
def q_audit_foreign_keys(spark, sf):
    child = _faulty(spark, sf, *dict.fromkeys(c for _, c, _, _ in FOREIGN))
    parent = {"b_rooms": B.b_rooms(spark, sf), "b_persons": B.b_persons(spark, sf), "b_tasks": B.b_tasks(spark, sf),
              "b_accounts": B.b_accounts(spark, sf)}
    return AU.audit_foreign_keys({c: (df, {n: (k, parent[p], k) for n, cc, k, p in FOREIGN if cc == c}) for c, df in child.items()})


@register("audit_check", ["b_tasks"],
          "select task_id, room_id, minutes from b_tasks where not (minutes >= 1 and minutes <= 10)")
def q_audit_check(spark, sf):
    return AU.audit_check(B.b_tasks(spark, sf))


# The source's NOT NULL columns.
NOT_NULL = {"rooms": ("d_rooms", ["name_room", "creator"]), "persons": ("d_persons", ["login_name", "email"]),
            "tasks": ("d_tasks", ["name", "minutes", "on_active", "completed", "changed"]),
            "votes": ("d_votes", ["room_id", "task_id", "person_id", "vote", "score"]),
            "task_results": ("d_results", ["task_id", "room_id", "created"]),
            "recovery": ("d_recovery", ["account_id", "link", "is_active", "requested"]),
            "dictionary": ("d_dictionary", ["score"]), "errors": ("d_errors", ["error_id", "error_text", "ts"])}


@register("audit_not_null", [t for t, _ in NOT_NULL.values()], "\nunion all ".join(
    f"select '{n}' table_name, '{c}' column_name, count(*) filter (where {c} is null) n_nulls from {t}"
    for n, (t, cols) in NOT_NULL.items() for c in cols))
def q_audit_not_null(spark, sf):
    t = _faulty(spark, sf, *(t for t, _ in NOT_NULL.values()))
    return AU.audit_not_null({n: (t[table], cols) for n, (table, cols) in NOT_NULL.items()})


@register("url_param", sql="""select page_id, url,
  nullif(regexp_extract(url, '^[^?#]*\\?(?:[^#]*&)?page=([^&#]*)', 1), '') page,
  nullif(regexp_extract(url, '^[^?#]*\\?(?:[^#]*&)?ref=([^&#]*)', 1), '') ref,
  nullif(regexp_extract(url, '^[^?#]*\\?(?:[^#]*&)?utm_source=([^&#]*)', 1), '') utm_source
from pages""")
def q_url_param(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", "url", *[TX.url_param(F.col("url"), k).alias(k) for k in ("page", "ref", "utm_source")])


@register("message_texts", ["b_registrations", "b_accounts", "b_recovery_requests"], f"""
select 'welcome' kind, r.email recipient,
  'Dear User!, ' || r.email || '. You have successfully registered with the estimation room with login: ' || r.login_name text
from b_registrations r
where not exists (select 1 from b_accounts a where lower(rtrim(a.email)) = lower(rtrim(r.email)))
  and not exists (select 1 from b_accounts a where lower(rtrim(a.login_name)) = lower(rtrim(r.login_name)))
union all
select 'recovery', a.email, 'Dear User!, ' || a.email ||
  '. An attempt was made to restore your account. To change your password, follow the link: http://localhost/'
  || 'change-password-form?linkRestore=' || lower(s.link)
from b_accounts a join (__RECOVERY__) s on a.account_id = s.account_id""")
def q_message_texts(spark, sf):
    reg = A.register_users(B.b_registrations(spark, sf), B.b_accounts(spark, sf)).filter(F.col("outcome") == "inserted")
    welcome = reg.select(F.lit("welcome").alias("kind"), F.col("email").alias("recipient"),
                         TX.welcome_text(F.col("email"), F.col("login_name")).alias("text"))
    links = A.recovery_link_of(B.b_accounts(spark, sf),
                               A.recovery_state(B.b_recovery_requests(spark, sf), B.b_accounts(spark, sf)))
    rec = links.select(F.lit("recovery").alias("kind"), F.col("email").alias("recipient"),
                       TX.recovery_text(F.col("email"), F.col("link")).alias("text"))
    return welcome.unionByName(rec)

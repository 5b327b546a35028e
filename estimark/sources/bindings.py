"""Stand-in inputs built from the driver's test tables.

These only reshape test-table rows into the schemas of the estimation data
model (rooms, tasks, persons, vote log, command log, accounts ...).  They do
none of the operators' work; every operator is generic over its schema.
The same blocks exist as SQL text in ``estimark.plans.oracle_bindings`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estimark.sources.tables import read_table

# Fixed values of the bindings: l_quantity % 11 (and the number in events.props % 11)
# picks a card from this list, in this order.
CARD_BY_REMAINDER = [0, 1, 2, 3, 5, 8, 13, 20, 40, 777, 999]


def _card(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in CARD_BY_REMAINDER]), (n % 11 + 1).cast("int"))


def _room_of_brand(c: Column) -> Column:
    return F.substr(c, F.lit(7)).cast("int")


def _guid(c: Column) -> Column:
    h = F.md5(c)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def _mail(c: Column) -> Column:
    return F.concat(F.lower(F.replace(c, F.lit("#"), F.lit("."))), F.lit("@ex.io"))


def b_rooms(spark: SparkSession, sf: str) -> DataFrame:
    brand = read_table(spark, sf, "part", "p_brand").distinct()
    rid = _room_of_brand(F.col("p_brand"))
    return brand.select(
        rid.alias("room_id"), F.col("p_brand").alias("name_room"), _guid(F.col("p_brand")).alias("room_guid"),
        (rid % 5 != 0).alias("is_active"), rid.cast("bigint").alias("creator"))


def b_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part", "p_partkey", "p_brand", "p_name", "p_size").select(
        F.col("p_partkey").alias("task_id"), _room_of_brand(F.col("p_brand")).alias("room_id"),
        F.col("p_name").alias("name"), (F.col("p_size") % 12).alias("minutes"))


def b_persons(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier", "s_suppkey", "s_name").select(
        F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("login_name"),
        _mail(F.col("s_name")).alias("email"))


def _line_part(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem", *cols)
    pa = read_table(spark, sf, "part", "p_partkey", "p_brand")
    return li.join(pa, li.l_partkey == pa.p_partkey)


def b_vote_log(spark: SparkSession, sf: str) -> DataFrame:
    j = _line_part(spark, sf, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    return vote_log_of(j)


def vote_log_of(j: DataFrame) -> DataFrame:
    """Vote log rows from lineitem joined with part (batch or stream)."""
    return j.select(
        _room_of_brand(F.col("p_brand")).alias("room_id"), F.col("l_partkey").alias("task_id"),
        F.col("l_suppkey").alias("person_id"), _card(F.col("l_quantity").cast("int")).alias("score"),
        F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_quantity")


def b_connections(spark: SparkSession, sf: str) -> DataFrame:
    j = _line_part(spark, sf, "l_partkey", "l_suppkey", "l_shipdate")
    return j.select(_room_of_brand(F.col("p_brand")).alias("room_id"), F.col("l_suppkey").alias("person_id"),
                    F.col("l_shipdate").alias("ts"))


def b_dictionary(spark: SparkSession) -> DataFrame:
    """The score dictionary (fixed values of the data model: coffee break,
    question, not voted), as an inline JVM table (no Python-side rows)."""
    return spark.sql("SELECT * FROM VALUES (999, 'Coffee break'), (777, 'Question'), (0, 'Not voice') "
                     "AS dictionary(score, meaning)")


def b_accounts(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer", "c_custkey", "c_name")
    name = F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit("."))).otherwise(F.col("c_name"))
    return c.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("login_name"),
                    F.concat(F.lower(name), F.lit("@ex.io")).alias("email"))


def b_credentials(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer", "c_custkey", "c_name")
    plain = (F.when(F.col("c_custkey") % 3 == 0, "1-URGENT").when(F.col("c_custkey") % 3 == 1, "2-HIGH")
             .otherwise("3-MEDIUM"))
    return c.select(F.col("c_custkey").alias("account_id"), _mail(F.col("c_name")).alias("email"),
                    F.md5(plain).alias("password"))


def _orders_customers(spark: SparkSession, sf: str, *ocols: str) -> DataFrame:
    o = read_table(spark, sf, "orders", *ocols)
    c = read_table(spark, sf, "customer", "c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey)


def b_attempts(spark: SparkSession, sf: str) -> DataFrame:
    j = _orders_customers(spark, sf, "o_orderkey", "o_custkey", "o_orderpriority")
    user = (F.when(F.col("o_orderkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit("")))
            .otherwise(F.col("c_name")))
    return j.select(F.col("o_orderkey").alias("attempt_id"), _mail(F.col("c_name")).alias("email"),
                    F.col("o_orderpriority").alias("plain"), user.alias("username"))


def b_redeems(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    return o.select(F.col("o_orderkey").alias("redeem_id"), F.col("o_orderdate").alias("ts"),
                    F.md5((F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("string")).alias("link"),
                    F.md5("o_orderpriority").alias("new_password"))


def b_room_requests(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    return p.select(F.floor(F.col("p_partkey") / 4).cast("bigint").alias("request_id"),
                    (F.col("p_partkey") % 4).alias("pos"), F.col("p_name").alias("name"),
                    (F.col("p_size") % 12).alias("mins"))


def b_registrations(spark: SparkSession, sf: str) -> DataFrame:
    j = _orders_customers(spark, sf, "o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    login = F.when(k % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("new"), (k % 5000).cast("string")))
    acct = F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit("."))).otherwise(F.col("c_name"))
    local = F.when((k % 4).isin(0, 3), F.lower(acct)).otherwise(F.concat(F.lit("new."), (k % 7000).cast("string")))
    return j.select(k.alias("request_id"), F.col("o_orderdate").alias("ts"), login.alias("login_name"),
                    F.concat(local, F.lit("@ex.io")).alias("email"))


def b_recovery_requests(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return o.select(F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("ts"), "o_orderkey",
                    F.md5(F.col("o_orderkey").cast("string")).alias("link"),
                    (F.col("o_orderstatus") == "F").alias("is_base"),
                    (F.col("o_orderkey") % 3 != 0).alias("is_active"))


# Fixed values of the bindings: events.event_type to message kind.
KIND_BY_EVENT_TYPE = {"signup": "StartVoting", "purchase": "StopVoting", "click": "ChangeVote", "view": "ChangeGetVM"}


def b_commands(spark: SparkSession, sf: str) -> DataFrame:
    return commands_of(read_table(spark, sf, "events", "user_id", "ts", "event_id", "event_type", "props"))


def commands_of(e: DataFrame) -> DataFrame:
    """Command rows from event rows (batch or stream)."""
    kind = F.lit("Bogus")
    for et, k in reversed(list(KIND_BY_EVENT_TYPE.items())):
        kind = F.when(F.col("event_type") == et, k).otherwise(kind)
    n = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    kind = F.when((kind == "ChangeGetVM") & (F.col("event_id") % 23 == 11), "FinishPlanning").otherwise(kind)
    fault = F.when(F.col("event_id") % 41 == 5, "arity").when(
        (F.col("event_id") % 43 == 7) & F.col("event_type").isin("signup", "click"), "xml")
    return e.select(F.col("user_id").alias("room_id"), "ts", "event_id", (F.col("event_id") % 7).alias("person_no"),
                    kind.alias("kind"), fault.alias("fault"), (n % 5 + 1).alias("task_ordinal"), _card(n).alias("score"))


def b_room_probes(spark: SparkSession, sf: str) -> DataFrame:
    """GUID probes: a room's GUID, a GUID of no room, and a 35-character stub."""
    p = read_table(spark, sf, "part", "p_partkey", "p_brand", "p_type")
    k = F.col("p_partkey") % 3
    probe = (F.when(k == 0, _guid(F.col("p_brand"))).when(k == 1, _guid(F.col("p_type")))
             .otherwise(F.substring(_guid(F.col("p_brand")), 1, 35)))
    return p.select(probe.alias("probe"))


def b_room_history(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms as created over time: one per order, created by its customer."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return o.select(F.col("o_orderkey").alias("room_id"), F.col("o_custkey").alias("creator"),
                    F.col("o_orderdate").alias("created"))


def b_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The command log as the text messages a room receives: ``Kind==payload``
    (ChangeGetVM is sent bare).  Only the text goes on; kinds, ordinals and
    scores are recovered by the parser under test."""
    return messages_of(b_commands(spark, sf))


def messages_of(c: DataFrame) -> DataFrame:
    """Message texts from command rows (batch or stream); some have too many parts or broken XML."""
    payload = (F.when(F.col("fault") == "xml", "<Change><AddVote vote=").when(F.col("kind") == "StartVoting",
                      F.format_string('<Change><StartVoting taskId="%d" isCurrentActive="1"/></Change>',
                                      F.col("task_ordinal")))
               .when(F.col("kind") == "ChangeVote",
                     F.format_string('<Change><AddVote vote="1" score="%d"/></Change>', F.col("score")))
               .otherwise(F.lit("")))
    msg = F.when(F.col("kind") == "ChangeGetVM", F.col("kind")).otherwise(F.concat("kind", F.lit("=="), payload))
    msg = F.concat(msg, F.when(F.col("fault") == "arity", "==a==b").otherwise(""))
    return c.select("room_id", "ts", "event_id", "person_no", msg.alias("msg"))


def _sender_mail(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("supplier."), F.lpad(n.cast("string"), 9, "0"), F.lit("@ex.io"))).otherwise(F.lit("nobody@ex.io"))


def b_raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as they arrive: a room's GUID and a sender's e-mail, in any case and with trailing blanks."""
    e = read_table(spark, sf, "events", "event_id", "ts", "user_id")
    guid = _guid(F.concat(F.lit("Brand#"), F.col("user_id").cast("string")))
    guid = F.when(F.col("event_id") % 3 == 0, F.upper(guid)).when(F.col("event_id") % 4 == 1, F.concat(guid, F.lit("  "))).otherwise(guid)
    mail = _sender_mail(F.col("event_id") % 13)
    mail = F.when(F.col("event_id") % 5 == 0, F.concat(F.upper(mail), F.lit(" "))).otherwise(mail)
    return e.select("event_id", "ts", guid.alias("room_guid"), mail.alias("email"))


def b_posted_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """Room requests with who posted them and when."""
    k = F.col("request_id")
    mail = _sender_mail(k % 11)
    return b_room_request_xml(spark, sf).select("*", F.when(k % 2 == 0, F.upper(mail)).otherwise(mail).alias("creator_email"),
                                                F.timestamp_add("SECOND", k, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))


def b_posted_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Task lists as posted; in every seventh the first task's element is not closed."""
    r = b_room_request_xml(spark, sf)
    broken = F.regexp_replace("tasks_xml", '^(.*?)"/>', '$1">')
    return r.select("request_id", F.when(F.col("request_id") % 7 == 3, broken).otherwise(F.col("tasks_xml")).alias("tasks_xml"))


def connects_of(e: DataFrame) -> DataFrame:
    """Connections that open in the rooms of the log, from event rows (batch or stream)."""
    return e.filter(F.col("event_id") % 9 == 4).select(F.col("event_id").alias("connect_id"), F.col("user_id").alias("room_id"),
                                                       (F.col("event_id") % 7).alias("person_no"), "ts")


def faulty(spark: SparkSession, name: str, **inputs: DataFrame) -> DataFrame:
    """A table with faults for the audits (``oracle_bindings.FAULTY``), from clean ``inputs``."""
    from estimark.plans.oracle_bindings import FAULTY
    return spark.sql(FAULTY[name][1], **inputs)


def b_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Who holds a slot in a room of the log (some senders don't)."""
    c = b_commands(spark, sf).select("room_id", "person_no").distinct()
    return c.filter((F.col("room_id") * 7 + F.col("person_no")) % 11 != 0)


def b_room_request_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Room requests as the form posts them: a room name and the XML task list
    (tasks in position order).  Grouping is by request: four rows each."""
    from estimark.sources.xml import task_list_xml
    r = b_room_requests(spark, sf)
    items = F.array_sort(F.collect_list(F.struct("pos", task_list_xml(F.col("name"), F.col("mins")).alias("x"))))
    return r.groupBy("request_id").agg(items.alias("__i")).select(
        "request_id", F.concat(F.lit("Room "), F.col("request_id").cast("string")).alias("name_room"),
        F.concat(F.lit("<tasks>"), F.array_join(F.transform("__i", lambda s: s["x"]), ""), F.lit("</tasks>"))
        .alias("tasks_xml"))

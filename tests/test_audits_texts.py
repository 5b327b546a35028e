from pyspark.sql import functions as F

from conftest import rows_of

from estimark.functions import texts as TX
from estimark.operators import audits as AU


def test_audit_unique_case_and_blanks(spark):
    df = spark.createDataFrame([(1, "Ann@x.io"), (2, "ann@x.io  "), (3, "bob@x.io"), (4, None), (5, None)],
                               "id long, email string")
    got = rows_of(AU.audit_unique({"persons_email": (df, "email")}))
    assert got == [("persons_email", "ann@x.io", 2)]


def test_audit_foreign_keys_counts_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,)], "room_id long")
    child = spark.createDataFrame([(1,), (3,), (3,), (None,)], "room_id long")
    got = rows_of(AU.audit_foreign_keys({"tasks": (child, {"tasks_room": ("room_id", parent, "room_id")}),
                                         "rooms": (parent, {"ok": ("room_id", parent, "room_id")})}))
    assert got == [("ok", 0), ("tasks_room", 2)]


def test_audit_check_null_passes(spark):
    t = spark.createDataFrame([(1, 1, 0), (2, 1, 10), (3, 1, 11), (4, 1, None), (5, 1, 1)],
                              "task_id long, room_id long, minutes int")
    assert rows_of(AU.audit_check(t), "task_id") == [(1,), (3,)]


def test_audit_not_null(spark):
    t = spark.createDataFrame([(None, 1), ("a", None), (None, None)], "name string, minutes int")
    got = rows_of(AU.audit_not_null({"tasks": (t, ["name", "minutes"])}))
    assert got == [("tasks", "minutes", 2), ("tasks", "name", 2)]


def test_url_param(spark):
    df = spark.createDataFrame([("http://h/rooms?roomId=ab-1&x=2",), ("http://h/p?x=1&roomId=zz#frag",),
                                ("http://h/p",), ("not a url ::",)], "u string")
    got = [r[0] for r in df.select(TX.url_param(F.col("u"), "roomId")).collect()]
    assert got == ["ab-1", "zz", None, None]


def test_texts(spark):
    df = spark.createDataFrame([("a@x.io", "ann", "ABC-DEF")], "email string, login string, link string")
    r = df.select(TX.welcome_text(F.col("email"), F.col("login"), app_name="Estimates").alias("w"),
                  TX.recovery_text(F.col("email"), F.col("link")).alias("r"),
                  TX.invitation_link(F.col("link")).alias("i")).collect()[0]
    assert r["w"] == "Dear User!, a@x.io. You have successfully registered with Estimates with login: ann"
    assert r["r"].endswith("follow the link: http://localhost/change-password-form?linkRestore=abc-def")
    assert r["i"] == "http://localhost/rooms?roomId=abc-def"

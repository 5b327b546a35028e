import datetime as dt

from conftest import rows_of

from estimark.operators import accounts as A


def test_registration_precedence(spark):
    acc = spark.createDataFrame([(1, "ann", "ann@x.io"), (2, "bob", "bob@x.io")],
                                "account_id long, login_name string, email string")
    req = spark.createDataFrame([(10, "ann", "ANN@x.io "), (11, "bob", "ann@x.io"), (12, "ann", "new@x.io"),
                                 (13, "cy", "cy@x.io")], "request_id long, login_name string, email string")
    got = rows_of(A.register_users(req, acc), "request_id", "outcome")
    assert got == [(10, "pair_exists"), (11, "email_exists"), (12, "login_exists"), (13, "inserted")]


def _t(d):
    return dt.datetime(2024, 1, d)


def test_recovery_one_row_latest_link(spark):
    acc = spark.createDataFrame([(1, "a@x.io")], "account_id long, email string")
    req = spark.createDataFrame([(1, _t(1), 5, "old", False, False), (1, _t(2), 6, "new", False, False), (9, _t(3), 7, "x", False, False)],
                                "account_id long, ts timestamp_ntz, o_orderkey long, link string, is_base boolean, is_active boolean")
    got = rows_of(A.recovery_state(req, acc), "account_id", "link", "is_active")
    assert got == [(1, "new", True)]


def test_redeem_twice(spark):
    links = spark.createDataFrame([(1, "L", True)], "account_id long, link string, is_active boolean")
    red = spark.createDataFrame([(1, _t(1), "L"), (2, _t(2), "L"), (3, _t(1), "nope")],
                                "redeem_id long, ts timestamp_ntz, link string")
    got = rows_of(A.recovery_redeem(red, links), "redeem_id", "ok", "account_id")
    assert got == [(1, True, 1), (2, False, None), (3, False, None)]


def test_credentials(spark):
    import hashlib
    cred = spark.createDataFrame([(1, "a@x.io", hashlib.md5(b"pw1234").hexdigest())],
                                 "account_id long, email string, password string")
    att = spark.createDataFrame([(1, "a@x.io", "pw1234"), (2, "a@x.io", "nope"), (3, "b@x.io", "pw1234")],
                                "attempt_id long, email string, plain string")
    assert rows_of(A.credential_match(att, cred), "attempt_id", "matched") == [(1, True), (2, False), (3, False)]


def _sequential(base_accounts, reqs):
    """Brute force: one request at a time, as the stored procedure does."""
    emails = {e.lower().rstrip() for _, _, e in base_accounts}
    logins = {lg.lower().rstrip() for _, lg, _ in base_accounts}
    pairs = {(e.lower().rstrip(), lg.lower().rstrip()) for _, lg, e in base_accounts}
    out = {}
    for rid, _, login, email in sorted(reqs, key=lambda r: (r[1], r[0])):
        e, lg = email.lower().rstrip(), login.lower().rstrip()
        if (e, lg) in pairs:
            out[rid] = "pair_exists"
        elif e in emails:
            out[rid] = "email_exists"
        elif lg in logins:
            out[rid] = "login_exists"
        else:
            out[rid] = "inserted"
            emails.add(e)
            logins.add(lg)
            pairs.add((e, lg))
    return out


def test_registration_in_batch_equals_one_at_a_time(spark):
    import random
    rnd = random.Random(11)
    base = [(i, f"u{i}", f"u{i}@x.io") for i in range(5)]
    reqs = [(100 + i, _t(1 + rnd.randint(0, 5)), f"u{rnd.randint(0, 12)}", f"u{rnd.randint(0, 12)}@x.io")
            for i in range(80)]
    acc = spark.createDataFrame(base, "account_id long, login_name string, email string")
    rq = spark.createDataFrame(reqs, "request_id long, ts timestamp_ntz, login_name string, email string")
    got = dict(rows_of(A.register_users_in_batch(rq, acc), "request_id", "outcome"))
    assert got == _sequential(base, reqs)


def test_redeem_link_ignores_case(spark):
    links = spark.createDataFrame([(1, "ABC-DEF", True)], "account_id long, link string, is_active boolean")
    red = spark.createDataFrame([(1, _t(1), "abc-def")], "redeem_id long, ts timestamp_ntz, link string")
    assert rows_of(A.recovery_redeem(red, links), "redeem_id", "ok") == [(1, True)]


def test_recovery_keeps_a_used_link_inactive(spark):
    import datetime as dt

    from estimark.operators import accounts as A
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 1, "used", True, False), (2, t, 2, "open", True, True), (3, t, 3, "used", True, False), (3, t, 4, "new", False, False)]
    req = spark.createDataFrame(rows, "account_id long, ts timestamp_ntz, o_orderkey long, link string, is_base boolean, is_active boolean")
    acc = spark.createDataFrame([(1,), (2,), (3,)], "account_id long")
    got = {r.account_id: (r.link, r.is_active) for r in A.recovery_state(req, acc).collect()}
    assert got == {1: ("used", False), 2: ("open", True), 3: ("new", True)}

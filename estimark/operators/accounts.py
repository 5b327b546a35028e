"""Accounts: key resolution, credentials, registration, recovery links.

Each procedure of the original works on one user; here each is a set
operation between a base table and a batch of requests.  Emails and logins
are compared case-insensitively with trailing blanks ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimark.functions.rules import key_text


def _unique_on(df: DataFrame, key_col, key_name: str, value: str) -> DataFrame:
    """A lookup side with one row per key (the smallest ``value`` wins), so the
    join cannot multiply request rows even if the base breaks UNIQUE."""
    return df.groupBy(key_col.alias(key_name)).agg(F.min(value).alias(value))


def resolve_keys(requests: DataFrame, accounts: DataFrame, email: str = "email",
                 id_col: str = "account_id") -> DataFrame:
    """Natural key to surrogate key: email to account id by a left join;
    unknown emails get reason 'unknown_email' (quarantine)."""
    look = _unique_on(accounts, key_text(F.col("email")), "__k", id_col)
    r = requests.withColumn("__k", key_text(F.col(email)))
    j = r.join(look, "__k", "left").drop("__k")
    return j.withColumn("reason", F.when(F.col(id_col).isNull(), "unknown_email"))


def email_known(requests: DataFrame, accounts: DataFrame, email: str = "email") -> DataFrame:
    """Is the request's email present among the accounts?"""
    look = accounts.select(key_text(F.col("email")).alias("__k")).distinct().withColumn("known", F.lit(True))
    j = requests.withColumn("__k", key_text(F.col(email))).join(look, "__k", "left").drop("__k")
    return j.withColumn("known", F.coalesce("known", F.lit(False)))


def credential_match(attempts: DataFrame, credentials: DataFrame) -> DataFrame:
    """EXISTS(account with this email and md5(password)) for every attempt:
    the password is hashed (lower-hex md5) and both keys are joined at once."""
    look = (credentials.select(key_text(F.col("email")).alias("__k"), F.col("password").alias("__h"))
            .distinct().withColumn("matched", F.lit(True)))
    a = attempts.withColumn("__k", key_text(F.col("email"))).withColumn("__h", F.md5(F.col("plain")))
    j = a.join(look, ["__k", "__h"], "left").drop("__k", "__h")
    return j.withColumn("matched", F.coalesce("matched", F.lit(False)))


def _base_matches(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests with their comparison keys (__e, __l) and flags: an account
    holds the pair (__p), the email (__em), the login (__lg)."""
    acc = accounts.select(key_text(F.col("email")).alias("__e"), key_text(F.col("login_name")).alias("__l"))
    pairs = acc.distinct().withColumn("__p", F.lit(True))
    emails = acc.select("__e").distinct().withColumn("__em", F.lit(True))
    logins = acc.select("__l").distinct().withColumn("__lg", F.lit(True))
    return (requests.withColumn("__e", key_text(F.col("email"))).withColumn("__l", key_text(F.col("login_name")))
            .join(pairs, ["__e", "__l"], "left").join(emails, "__e", "left").join(logins, "__l", "left"))


def _outcome(pair, email, login):
    return (F.when(F.coalesce(pair, F.lit(False)), "pair_exists").when(F.coalesce(email, F.lit(False)), "email_exists")
            .when(F.coalesce(login, F.lit(False)), "login_exists").otherwise("inserted"))


def register_users(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Classify each registration against the existing accounts, with the
    original precedence: 'pair_exists' (one account holds both), else
    'email_exists', else 'login_exists', else 'inserted'.  Three equi-joins
    on distinct key sets; no request row is multiplied."""
    r = _base_matches(requests, accounts)
    return (r.withColumn("outcome", _outcome(F.col("__p"), F.col("__em"), F.col("__lg")))
            .drop("__e", "__l", "__p", "__em", "__lg"))


def recovery_state(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Recovery links after a batch of requests (MERGE on account):
    base rows (``is_base``) give the stored table, the latest per account;
    the other rows are new requests, the latest per account wins and replaces
    the link, re-activating it.  An account without a new request keeps its
    stored row, a used (inactive) link included.  Requests of unknown accounts
    are ignored.
    Returns (account_id, link, is_active, requested)."""
    order = F.struct("ts", "o_orderkey")
    known = requests.join(accounts.select("account_id").distinct(), "account_id", "left_semi")
    base = (known.filter("is_base").groupBy("account_id")
            .agg(F.max_by(F.struct("link", "ts", "is_active"), order).alias("b")))
    chg = (known.filter(~F.col("is_base")).groupBy("account_id")
           .agg(F.max_by(F.struct("link", "ts"), order).alias("c")))
    j = base.join(chg, "account_id", "full")
    return j.select("account_id",
                    F.coalesce(F.col("c.link"), F.col("b.link")).alias("link"),
                    F.when(F.col("c").isNotNull(), True).otherwise(F.col("b.is_active")).alias("is_active"),
                    F.coalesce(F.col("c.ts"), F.col("b.ts")).alias("requested"))


def recovery_link_of(accounts: DataFrame, links: DataFrame) -> DataFrame:
    """The link of each account's email."""
    return accounts.select("account_id", "email").join(links.select("account_id", "link"), "account_id")


def recovery_redeem(redeems: DataFrame, links: DataFrame) -> DataFrame:
    """Redeem links: a redeem succeeds when its link exists and is active and
    it is the first redeem of that link (by ts, id); success deactivates the
    link, so later redeems of it fail.  Links compare without case (mails
    carry them lower-cased).  Returns every redeem with ``ok`` and
    the account whose password it sets."""
    r = redeems.withColumn("__k", key_text(F.col("link")))
    first = r.groupBy("__k").agg(F.min_by("redeem_id", F.struct("ts", "redeem_id")).alias("__first"))
    act = (links.filter("is_active").groupBy(key_text(F.col("link")).alias("__k"))
           .agg(F.max("account_id").alias("account_id")))
    j = r.join(first, "__k", "left").join(act, "__k", "left")
    ok = F.col("account_id").isNotNull() & (F.col("redeem_id") == F.col("__first"))
    return j.select("redeem_id", "ts", "link", F.when(ok, F.col("account_id")).alias("account_id"),
                    F.coalesce(ok, F.lit(False)).alias("ok"))


def redeemed_tables(redeems: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What redeeming changes: (account_id, password) of every account that got
    a new password (the last successful redeem wins), and the links table with
    the used links deactivated."""
    done = recovery_redeem(redeems, links).filter("ok")
    done = done.join(redeems.select("redeem_id", "new_password"), "redeem_id")
    passwords = done.groupBy("account_id").agg(F.max_by("new_password", F.struct("ts", "redeem_id")).alias("password"))
    used = done.select(key_text(F.col("link")).alias("__k")).distinct().withColumn("__used", F.lit(True))
    after = links.withColumn("__k", key_text(F.col("link"))).join(used, "__k", "left")
    after = after.withColumn("is_active", F.col("is_active") & F.col("__used").isNull()).select(*links.columns)
    return passwords, after


def inserted_persons(outcomes: DataFrame, password: str = "password") -> DataFrame:
    """The Persons rows that accepted registrations insert: login, email,
    password and a repeatable token (a digest of the request)."""
    new = outcomes.filter(F.col("outcome") == "inserted")
    token = F.md5(F.concat_ws("|", F.col("request_id").cast("string"), key_text(F.col("email"))))
    return new.select("request_id", "login_name", "email", F.md5(password).alias("password"), token.alias("token"))


def latest_link(links: DataFrame, id_col: str = "o_orderkey") -> DataFrame:
    """``TOP(1) AccountId ... WHERE Link = l ORDER BY Id DESC`` per link, links
    compared as in ``recovery_redeem``."""
    return links.groupBy(key_text(F.col("link")).alias("link")).agg(F.max_by("account_id", id_col).alias("account_id"))


def register_users_in_batch(requests: DataFrame, accounts: DataFrame, order=("ts", "request_id"),
                            checkpoint: bool = True) -> DataFrame:
    """Registration of a whole batch with the original's one-at-a-time
    semantics: requests are taken in ``order``; each is checked against the
    accounts *and the requests accepted before it*; a rejected request blocks
    nothing.  Outcome precedence as in ``register_users``.

    Exact, without a sequential loop over rows: in each round every undecided
    request that comes first on both its email and its login among the
    undecided ones is accepted (nothing earlier can block it), then every
    undecided request sharing a key with a newly accepted one is rejected
    (that one is earlier by construction).  The earliest undecided request is
    always decided, so the rounds end; each round is two aggregations and a
    few semi/anti joins, and the undecided set is checkpointed between rounds.
    Rejected requests are classified at the end against the accepted requests
    that precede them (accepted requests never share a key, so each key join
    finds at most one partner)."""
    from estimark.session import materialize

    ord_col = F.struct(*order)
    base = _base_matches(requests, accounts).withColumn("__o", ord_col)
    clean = ~(F.coalesce("__p", F.lit(False)) | F.coalesce("__em", F.lit(False)) | F.coalesce("__lg", F.lit(False)))
    undecided = base.filter(clean).select("request_id", "__e", "__l", "__o")
    accepted = None
    while True:
        if checkpoint:
            undecided = materialize(undecided)
        if undecided.isEmpty():
            break
        fe = undecided.groupBy("__e").agg(F.min("__o").alias("__fe"))
        fl = undecided.groupBy("__l").agg(F.min("__o").alias("__fl"))
        newly = (undecided.join(fe, "__e").join(fl, "__l")
                 .filter((F.col("__o") == F.col("__fe")) & (F.col("__o") == F.col("__fl")))
                 .select("request_id", "__e", "__l", "__o"))
        if checkpoint:
            newly = materialize(newly)
        accepted = newly if accepted is None else accepted.unionByName(newly)
        rest = undecided.join(newly.select("request_id"), "request_id", "left_anti")
        clash_e = rest.join(newly.select("__e"), "__e", "left_semi").select("request_id")
        clash_l = rest.join(newly.select("__l"), "__l", "left_semi").select("request_id")
        undecided = rest.join(clash_e.unionByName(clash_l), "request_id", "left_anti")
    if accepted is None:
        accepted = base.select("request_id", "__e", "__l", "__o").filter(F.lit(False))  # none accepted
    elif checkpoint:
        accepted = materialize(accepted)
    a_ids = accepted.select("request_id", F.lit(True).alias("__acc"))
    a_pair = accepted.select("__e", "__l", F.col("__o").alias("__op"))
    a_e = accepted.select("__e", F.col("__o").alias("__oe"))
    a_l = accepted.select("__l", F.col("__o").alias("__ol"))
    j = (base.join(a_ids, "request_id", "left").join(a_pair, ["__e", "__l"], "left")
         .join(a_e, "__e", "left").join(a_l, "__l", "left"))
    earlier = lambda c: F.coalesce(F.col(c) < F.col("__o"), F.lit(False))
    outcome = F.when(F.col("__acc"), "inserted").otherwise(_outcome(
        F.col("__p") | earlier("__op"), F.col("__em") | earlier("__oe"), F.col("__lg") | earlier("__ol")))
    return j.withColumn("outcome", outcome).drop("__e", "__l", "__o", "__p", "__em", "__lg", "__acc",
                                                 "__op", "__oe", "__ol")

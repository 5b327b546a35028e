"""Validation rules as Column expressions (JVM-side, no Python per row).

Java's ``$`` also matches before a trailing newline, so the patterns are
anchored with ``\\A`` and ``\\z`` to give whole-string semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The account rules of the web form.
EMAIL_PATTERN = r"[-\w.]+@([A-z0-9][-A-z0-9]+\.)+[A-z]{2,4}"
PASSWORD_MIN, PASSWORD_MAX = 6, 24
PASSWORD_ALLOWED = r"A-Za-z0-9!#$%&'()*+,\-./:;<=>?@\[\\\]^_{|}~"
PASSWORD_NEEDS_ONE = r"0-9!#$%&'()*+,\-./:;<=>?@\[\\\]^_{|}~"
USERNAME_MIN, USERNAME_MAX = 3, 24
USERNAME_ALLOWED = "A-Za-z0-9"


def _whole(pattern: str) -> str:
    return r"\A(?:" + pattern + r")\z"


def email_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(_whole(EMAIL_PATTERN)), F.lit(False))


def password_valid(c: Column) -> Column:
    ok = c.rlike(_whole(f"[{PASSWORD_ALLOWED}]{{{PASSWORD_MIN},{PASSWORD_MAX}}}")) & c.rlike(f"[{PASSWORD_NEEDS_ONE}]")
    return F.coalesce(ok, F.lit(False))


def username_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(_whole(f"[{USERNAME_ALLOWED}]{{{USERNAME_MIN},{USERNAME_MAX}}}")), F.lit(False))


def is_blank(c: Column) -> Column:
    """``x IS NULL OR x = ''`` with the server's trailing-blank-insensitive ``=``."""
    return c.isNull() | (F.rtrim(c) == "")


def key_text(c: Column) -> Column:
    """Comparison form of a login or email: case and trailing blanks ignored."""
    return F.lower(F.rtrim(c))

"""Texts and URLs: mail texts as projections, query parameters, countdowns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text templates and link paths of the original mails.  The
# application name and host are settings, so they are parameters here.
WELCOME = "Dear User!, %s. You have successfully registered with %s with login: %s"
RECOVERY = "Dear User!, %s. An attempt was made to restore your account. To change your password, follow the link: %s"
ROOM_PATH = "rooms?roomId="
RESTORE_PATH = "change-password-form?linkRestore="


def welcome_text(email: Column, login: Column, app_name: str = "the estimation room") -> Column:
    return F.format_string(WELCOME, email, F.lit(app_name), login)


def recovery_text(email: Column, link: Column, host: str = "http://localhost/") -> Column:
    return F.format_string(RECOVERY, email, F.concat(F.lit(host + RESTORE_PATH), F.lower(link)))


def invitation_link(room_guid: Column, host: str = "http://localhost/") -> Column:
    return F.concat(F.lit(host + ROOM_PATH), F.lower(room_guid))


def url_param(url: Column, key: str) -> Column:
    """First value of query parameter ``key`` (NULL if absent or the URL is malformed)."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))

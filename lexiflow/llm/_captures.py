"""Captures of the pages table: host, sort key and time of capture.

The table has no time of capture. One is derived from page_id: minutes after 2024-01-01, 7919 a page, over a year of 525,600;
a null page_id has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH, STEP, SPAN = "2024-01-01 00:00:00", 7919, 525_600
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
REST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)"


def captured_at(page_id: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + 60 * F.pmod(page_id * STEP, F.lit(SPAN)))


def host(url: Column) -> Column:
    """Lower case, no user, port or final dot; an IPv6 address with its brackets; '' where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"[.]+$", ""), F.lit(""))


def url_key(url: Column) -> Column:
    """The host's labels reversed, without a leading www, then path and query without a final slash; what has no host keeps its
    whole string, null counts as ''."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(url, REST, 1), "/+$", "")
    return F.coalesce(F.when(h == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(h, r"\.")), ","), F.lit(")"), rest)), F.lit(""))


SQL_TIME = f"(TIMESTAMP '{EPOCH}' + to_minutes(((page_id * {STEP} % {SPAN}) + {SPAN}) % {SPAN}))"
SQL_HOST = f"coalesce(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '[.]+$', ''), '')"
SQL_KEY = f"""coalesce(CASE WHEN regexp_replace({SQL_HOST}, '^www\\.', '') = '' THEN url ELSE
  array_to_string(list_reverse(string_split(regexp_replace({SQL_HOST}, '^www\\.', ''), '.')), ',') || ')' || regexp_replace(regexp_extract(url, '{REST}', 1), '/+$', '') END, '')"""

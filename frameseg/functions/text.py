"""Scalar functions on text: clocks, ids of recordings, file names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of recording ids and pages in addresses.
BV, AV, PAGE = r"(BV[0-9A-Za-z]{10})", r"(?i)av(\d+)", r"[?&]p=(\d+)"
ILLEGAL = r"[\\/:*?\"<>|\s]+"
HOSTS = ("bilibili.com", "b23.tv")


def clock_seconds(c: Column) -> Column:
    """[H:]M:SS.mmm, any number of parts."""
    parts = F.transform(F.split(F.trim(c), ":"), lambda z: z.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, z: a * 60 + z)


def clock_text(seconds: Column) -> Column:
    """M:SS.mmm, or H:MM:SS.mmm from an hour on."""
    ms = F.floor(seconds * 1000 + 0.5).cast("long")
    h, m, s, r = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    return F.when(h > 0, F.format_string("%d:%02d:%02d.%03d", h, m, s, r)).otherwise(F.format_string("%d:%02d.%03d", m, s, r))


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def recording_id(c: Column) -> Column:
    """The BV id, or av and its number; null where there is none."""
    return F.coalesce(_found(c, BV), F.concat(F.lit("av"), _found(c, AV)))


def page_number(c: Column) -> Column:
    return F.coalesce(_found(c, PAGE).cast("int"), F.lit(1))


def is_address(c: Column) -> Column:
    """Whether an input names a recording rather than a file."""
    known = c.rlike(r"^BV[0-9A-Za-z]{10}$") | c.rlike(r"(?i)^av\d+$")
    for h in HOSTS:
        known = known | c.contains(h)
    return known


def safe_name(c: Column, default: str = "video") -> Column:
    """Characters that file names can't have, and white space, become _; no _ at the ends; 80 characters."""
    x = F.regexp_replace(c, ILLEGAL, "_")
    x = F.substring(F.regexp_replace(x, "^_+|_+$", ""), 1, 80)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def streamer_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def clip_name(stem: Column, number: Column) -> Column:
    return F.format_string("%s_song%02d.mp4", stem, number)

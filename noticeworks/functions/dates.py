"""Deadlines: parsing, expiry and visibility. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import extract, trim


def is_placeholder(c: Column) -> Column:
    v = trim(c)
    return (v == "") | v.rlike("(?i)" + L.NO_DEADLINE)


def deadline_end(c: Column) -> Column:
    """23:59:59 of the date that an ISO start or a written date names; months and days beyond the last roll over."""
    v = trim(c)
    shapes = (r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})年(\d{1,2})月(\d{1,2})日")
    part = lambda i: F.coalesce(*[extract(v, p, i) for p in shapes]).cast("int")
    day = F.date_add(F.add_months(F.make_date(part(1), F.lit(1), F.lit(1)), part(2) - 1), part(3) - 1)
    return F.when(~is_placeholder(c), F.timestamp_add("SECOND", F.lit(86399), day.cast("timestamp")))


def is_expired(end: Column, now: Column, grace_days: Column | int = 0) -> Column:
    """Past the end by more than the grace; never without an end."""
    grace = F.lit(grace_days) if isinstance(grace_days, int) else grace_days
    return F.coalesce(F.timestamp_add("DAY", grace, end) < now, F.lit(False))


def is_archivable_text(deadline: Column, now: Column) -> Column:
    """The regime of written deadlines: past, or none that can be read."""
    return F.coalesce(deadline_end(deadline) < now, F.lit(True))


def is_visible(end: Column, now: Column) -> Column:
    return F.coalesce(end >= now, F.lit(False))


def days_left(end: Column, now: Column) -> Column:
    return F.ceil((F.unix_micros(end) - F.unix_micros(now)) / F.lit(86_400_000_000.0)).cast("int")


def days_label(end: Column, now: Column) -> Column:
    n = days_left(end, now)
    return F.when(n.isNull(), "open").when(n < 0, "closed").when(n == 0, "closes today").otherwise(F.concat(n.cast("string"), F.lit(" days left")))


def grace(c: Column) -> Column:
    """Rounded half up, held to 0 to 365; 5 for what is no number."""
    n = F.try_to_number(trim(c), F.lit("S99999999.999")).cast("double")
    return F.coalesce(F.least(F.greatest(F.floor(n + 0.5), F.lit(0)), F.lit(365)), F.lit(5)).cast("int")

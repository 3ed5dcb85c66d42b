"""Profiles of applicants as they are stored and as a request gives them, and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, text, trim

DEFAULT_AGE, DEFAULT_MAJOR = 28, "辅导员"
MEMBER, OTHERS = "党员", "群众"


def whole_number(c: Column) -> Column:
    """The whole number that a text starts with; null for none."""
    return F.nullif(F.regexp_extract(trim(c), r"^([+-]?[0-9]{1,9})", 1), F.lit("")).try_cast("int")


def stored(age: Column, major: Column, member: Column, politics: Column) -> Column:
    """struct of age, major, member and politics as they are stored: what isn't given or can't be read is the default."""
    is_member = F.coalesce(member, F.lit(False)) | F.contains(text(politics), F.lit(MEMBER))
    return F.struct(F.coalesce(whole_number(age), F.lit(DEFAULT_AGE)).alias("age"), F.coalesce(F.nullif(trim(major), F.lit("")), F.lit(DEFAULT_MAJOR)).alias("major"), is_member.alias("member"), F.when(is_member, MEMBER).otherwise(OTHERS).alias("politics"))


def requested(match: Column, age: Column, major: Column, member: Column, politics: Column) -> Column:
    """struct of age, major, member and politics of a request's parameters; null if none is given or matching is turned off.

    A membership that is given decides; else a politics that names members, unless it says that it's none.
    """
    said = trim(politics)
    named = said.rlike(MEMBER) & ~said.rlike(f"非{MEMBER}|{OTHERS}")
    is_member = F.when(member.isNotNull(), member.isin("1", "true")).otherwise(named)
    given = match.isNotNull() | age.isNotNull() | major.isNotNull() | member.isNotNull() | politics.isNotNull()
    default = F.when(is_member, MEMBER).otherwise(OTHERS)
    profile = F.struct(F.coalesce(whole_number(age), F.lit(DEFAULT_AGE)).alias("age"), trim(major).alias("major"), is_member.alias("member"), bind(said, lambda v: F.when(v != "", v).otherwise(default)).alias("politics"))
    return F.when(given & ~F.coalesce(match == "0", F.lit(False)), profile)


def label(age: Column, member: Column, major: Column) -> Column:
    return F.concat_ws(" · ", F.concat(age.cast("string"), F.lit(" 岁")), F.when(member, MEMBER).otherwise(OTHERS), F.coalesce(F.nullif(text(major), F.lit("")), F.lit("—")))

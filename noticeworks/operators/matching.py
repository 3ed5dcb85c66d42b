"""Profiles against postings: three checks, one status, a stable ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules
from ..functions.text import any_of, text, trim

RANK = {"PERFECT": 0, "NORMAL": 1, "CONFLICT": 2}


def status(age: Column, party: Column, major: Column, limit_text: Column, job_text: Column, majors: Column) -> Column:
    """struct<status, reasons>: an age above the limit or a missing membership conflicts, a fitting major is perfect.

    The limit's own text comes before the posting's. What isn't known (null age or membership) passes; a blank
    major fits nothing, and a major that doesn't fit is no conflict.
    """
    limit = F.coalesce(rules.age_limit(limit_text), rules.age_limit(job_text))
    over = F.coalesce(age > limit, F.lit(False))
    barred = rules.needs_party(job_text) & F.coalesce(party == F.lit(False), F.lit(False))
    listed = F.exists(majors, lambda m: (m != "") & (F.contains(m, major) | F.contains(major, m)))
    blob = F.concat_ws("\n", F.coalesce(job_text, F.lit("")), majors)
    everything = any_of(blob, L.ANY_MAJOR_WORDS)
    fits = (F.coalesce(major, F.lit("")) != "") & (everything | listed | F.contains(F.coalesce(job_text, F.lit("")), major))
    name = F.when(over | barred, "CONFLICT").when(fits, "PERFECT").otherwise("NORMAL")
    reasons = F.array_compact(F.array(F.when(over, F.concat(F.lit("over age by "), (age - limit).cast("string"))), F.when(barred, F.lit("party membership"))))
    return F.struct(name.alias("status"), reasons.alias("reasons"))


def text_status(age: Column, party: Column, major: Column, job_text: Column) -> Column:
    """The status by a posting's text alone, with that matcher's own patterns; a blank text is NORMAL."""
    v = trim(job_text)
    over = F.coalesce(age > rules.age_limit(v, L.TEXT_AGE_LIMITS), F.lit(False))
    barred = any_of(v, L.TEXT_PARTY_WORDS) & F.coalesce(party == F.lit(False), F.lit(False))
    fits = (trim(major) != "") & F.contains(v, text(major))
    return F.when(v == "", "NORMAL").when(over | barred, "CONFLICT").when(fits, "PERFECT").otherwise("NORMAL")


def rank(name: Column) -> Column:
    out = F.lit(len(RANK))
    for k, v in RANK.items():
        out = F.when(name == k, v).otherwise(out)
    return out

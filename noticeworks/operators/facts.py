"""Facts of a notice out of its own text and of its tables, merged field by field, with where each comes from.

Each reading is a row: key, kind (`main` or `table`), rank among its kind, and the fields below, of which any may be null. One
aggregation merges any number of them; what depends on order takes the least (kind, rank), main before tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, fields, rules
from ..functions.text import text, with_once

#: Fields and their types: texts, and for tables the sum of their headcount column and the slots of their rows.
FACTS = {"age": "string", "party": "string", "education": "string", "gender": "string", "fresh": "boolean", "majors": "array<string>", "notes": "string", "deadline": "string", "positions": "string", "table_sum": "int", "job_slots": "array<string>", "no_recruitment": "boolean"}


def _first(value: Column, valid: Column) -> Column:
    """struct of the first valid value by order and its kind; null for none."""
    return F.min_by(F.struct(value.alias("v"), F.col("kind").alias("origin")), F.when(valid, F.col("_order")))


def _has(name: str) -> Column:
    return text(F.col(name)) != ""


def main_facts(c: Column) -> dict[str, Column]:
    """The fields that a notice's text states, by name; see FACTS."""
    return {"age": rules_age(c), "party": fields.party(c), "education": F.nullif(rules.normal_education(c), F.lit("")), "gender": fields.gender(c), "fresh": fields.fresh_graduates(c), "notes": fields.notes(c), "deadline": fields.deadline_in(c), "positions": fields.headcount_in(c)}


def rules_age(c: Column) -> Column:
    n = rules.age_limit(c)
    return F.when(n.isNotNull(), F.concat(n.cast("string"), F.lit("周岁以下")))


def merge_facts(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, the merged fields, deadline_source, positions_source and origins (kind by field) of each key.

    age, party, gender and fresh: the first that is stated. education: the label of the first stated one; if that is the
    main text's and has none, the tables' as written. majors and notes: all, each once and in order, notes on lines of their own.
    deadline: the first that is a day and no placeholder. positions: a table's sum, else the sum of its rows, else its own
    number, else the main text's. Where a main text announces no recruitment, neither it nor any deadline or headcount counts,
    and the tables' education stays as written. Nulls and empty texts are no facts; equal (kind, rank) are taken in any order.
    """
    order = F.struct((F.col("kind") != "main").alias("later"), F.col("rank").alias("rank"))
    main = F.col("kind") == "main"
    silent = F.coalesce(main & F.col("no_recruitment"), F.lit(False))
    read = readings.select(*keys, "kind", *[F.col(f).cast(t).alias(f) for f, t in FACTS.items()], order.alias("_order"), silent.alias("_silent"))
    numbers = F.filter(F.transform("job_slots", lambda s: fields.headcount(s).try_cast("int")), lambda n: n > 0)
    marked = with_once(read, _deadline=fields.deadline_text(F.col("deadline")), _positions=fields.headcount(F.col("positions")), _rows=F.aggregate(F.coalesce(numbers, F.array().cast("array<int>")), F.lit(0), lambda a, n: a + n), _any=F.exists(F.coalesce("job_slots", F.array().cast("array<string>")), lambda s: fields.headcount(s).isNotNull()))
    used, table = ~F.col("_silent"), ~main
    listed = lambda name, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("_order", F.col(name).alias("v"))))), lambda x: x["v"])
    origin_of = lambda name, when: F.array_sort(F.collect_set(F.when(when, F.col("kind"))))
    picked = {f: _first(F.col(f), used & _has(f)) for f in ("age", "party", "gender")} | {"fresh": _first(F.col("fresh"), used & F.col("fresh").isNotNull())}
    grouped = marked.groupBy(*keys).agg(
        *[c.alias(f) for f, c in picked.items()],
        _first(F.col("education"), used & _has("education")).alias("_e"),
        _first(F.col("education"), table & _has("education")).alias("_te"),
        F.array_distinct(F.flatten(listed("majors", used & F.col("majors").isNotNull()))).alias("majors"),
        origin_of("majors", used & (F.size(F.coalesce("majors", F.array().cast("array<string>"))) > 0)).alias("_mo"),
        F.nullif(F.array_join(F.array_distinct(listed("notes", used & _has("notes"))), "\n"), F.lit("")).alias("notes"),
        origin_of("notes", used & _has("notes")).alias("_no"),
        _first(F.col("_deadline"), used & F.col("_deadline").isNotNull()).alias("_d"),
        F.min_by("_deadline", F.when(used & main, F.col("_order"))).alias("_md"),
        _first(F.col("table_sum").cast("string"), table & (F.col("table_sum") > 0)).alias("_sum"),
        _first(F.col("_rows").cast("string"), table & (F.col("_rows") > 0)).alias("_counted"),
        _first(F.col("_positions"), table & F.col("_positions").isNotNull()).alias("_tp"),
        _first(F.col("_positions"), used & main & F.col("_positions").isNotNull()).alias("_mp"),
        F.bool_or(table & (F.col("table_sum").isNotNull() | F.col("_any"))).alias("_tabled"),
        F.bool_or("_silent").alias("_silent"),
    )
    label = F.nullif(rules.normal_education(F.col("_e.v")), F.lit(""))
    whole = with_once(grouped, _label=label, _p=F.when(~F.col("_silent"), F.coalesce("_sum", "_counted", "_tp", "_mp")), _dd=F.when(~F.col("_silent"), F.col("_d")))
    raw = F.when(F.col("_e.origin") == "main", F.col("_te")).otherwise(F.col("_e"))
    education = F.when(F.col("_silent"), F.col("_te")).when(F.col("_label").isNotNull(), F.struct(F.col("_label").alias("v"), F.col("_e.origin").alias("origin"))).otherwise(raw)
    whole = with_once(whole, _edu=education)
    both = lambda c: F.nullif(F.array_join(c, "+"), F.lit(""))
    origins = {"age": "age.origin", "party": "party.origin", "gender": "gender.origin", "fresh": "fresh.origin", "education": "_edu.origin", "deadline": "_dd.origin", "positions": "_p.origin"}
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(c).alias("value")) for f, c in origins.items()], F.struct(F.lit("majors").alias("key"), both("_mo").alias("value")), F.struct(F.lit("notes").alias("key"), both("_no").alias("value")))
    number = F.col("_p.v").try_cast("int").isNotNull()
    return whole.select(
        *keys,
        *[F.col(f"{f}.v").alias(f) for f in ("age", "party", "gender", "fresh")],
        F.col("_edu.v").alias("education"),
        "majors",
        "notes",
        F.col("_dd.v").alias("deadline"),
        F.col("_p.v").alias("positions"),
        F.when(F.col("_dd.v") == F.col("_md"), "main").when(F.col("_dd").isNotNull(), "table-fallback").alias("deadline_source"),
        F.when(number & F.col("_tabled"), "table").when(F.col("_p").isNotNull(), "main-fallback").alias("positions_source"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("origins"),
    )


def clean_facts(merged: DataFrame) -> DataFrame:
    """The fields of merge_facts made readable; what isn't any more is null, an empty list of subjects too."""
    cleaned = {f: F.nullif(cleaning.clean_text(F.col(f)), F.lit("")) for f in ("age", "party", "gender", "notes")}
    subjects = F.array_distinct(F.filter(F.transform("majors", cleaning.clean_text), lambda v: v != ""))
    cleaned |= {"majors": F.when(F.size(subjects) > 0, subjects), "education": F.nullif(rules.normal_education(F.col("education")), F.lit("")), "deadline": fields.deadline_text(F.col("deadline")), "positions": fields.headcount(F.col("positions"))}
    return merged.withColumns(cleaned)


def is_useful(facts: DataFrame) -> Column:
    """Whether any of the fields is stated."""
    named = [F.col(f).isNotNull() for f in ("age", "party", "education", "gender", "fresh", "notes", "deadline", "positions")]
    out = F.size(F.coalesce(F.col("majors"), F.array().cast("array<string>"))) > 0
    for c in named:
        out = out | c
    return out

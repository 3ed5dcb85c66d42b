"""Jobs of a notice's sheets: once each over all attachments, as lines, and rolled up to what the notice demands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import majors
from ..functions.text import text, with_once
from .tables import clean_cell

HEAD = ("岗位", "单位", "专业要求", "学历", "年龄", "人数", "其他要求")
NONE = "—"


def stated(c: str) -> Column:
    return F.when(~text(F.col(c)).isin("", NONE), F.col(c))


def with_columns_count(mended: DataFrame) -> DataFrame:
    """Rows of tables.mended_rows with n_columns: headers that have a cell, equal ones once."""
    filled = F.filter(F.transform("headers", lambda h, i: F.when((h != "") & (F.coalesce(F.get("cells", i), F.lit("")) != ""), clean_cell(h))), lambda h: h.isNotNull())
    return mended.withColumn("n_columns", F.size(F.array_distinct(filled)))


def once_each(jobs: DataFrame, keys: Sequence[str], sheet: str, row: str) -> DataFrame:
    """The jobs of all sheets of a key, each once: place and the columns of jobs.

    Two jobs are one if they have the same post code, else if sheet, title, organisation and row are the same. The fuller one
    stays, by the letters of its subjects and the number of its columns, and of equal ones the first; its place is that of the
    first. jobs: see tables.jobs, with n_columns. Sheets come in their order, null ones first.
    """
    made_up = F.col("id") == F.concat(F.lit("job-"), F.col(row).cast("string"))
    coded = F.col("id").isNotNull() & (F.col("id") != "") & ~made_up & ~F.col("id").rlike(r"^[0-9]+\z")
    own = F.concat_ws("|", F.coalesce(F.col(sheet).cast("string"), F.lit("")), "title", F.coalesce("organization", F.lit("")), F.col(row).cast("string"))
    key = F.when(coded, F.concat(F.lit("code:"), "id")).otherwise(own)
    score = F.length("major") + F.col("n_columns")
    at = F.struct(F.col(sheet).alias("s"), F.col(row).alias("r"))
    best = F.max_by(F.struct(*jobs.columns), F.struct(score.alias("score"), F.struct(*[-F.col(c).cast("long") for c in (sheet, row)]).alias("early"))).alias("the job")
    grouped = jobs.groupBy(*keys, key.alias("the key")).agg(F.min(at).alias("place"), best)
    return grouped.select("place", "the job.*")


def as_lines(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and tab_text: a header line and a line of tab-separated fields for each job, by place."""
    cells = [F.col("title"), F.col("organization"), stated("major"), stated("education"), stated("age"), F.col("slots").cast("string"), F.col("other")]
    line = F.array_join(F.array(*map(clean_cell, cells)), "\t")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return jobs.groupBy(*keys).agg(F.array_join(F.concat(F.array(F.lit("\t".join(HEAD))), lines), "\n").alias("tab_text"))


def rolled_up(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_jobs, majors (each name once, in order), positions (the sum of slots, null for 0), and the first age, education and notes."""
    named = F.when(F.coalesce(majors.is_major_cell(stated("major")), F.lit(False)), F.when(F.col("major") == majors.UNLIMITED, F.array(F.lit(majors.UNLIMITED))).otherwise(majors.names(F.col("major"))))
    rows = with_once(jobs, _named=F.coalesce(named, F.array().cast("array<string>")))
    first = lambda c: F.min_by(stated(c), F.when(stated(c).isNotNull(), F.col("place")))
    lists = F.array_sort(F.collect_list(F.struct("place", "_named")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_jobs"), F.array_distinct(F.flatten(F.transform(lists, lambda x: x["_named"]))).alias("majors"), F.nullif(F.sum("slots"), F.lit(0)).alias("positions"), first("age").alias("age"), first("education").alias("education"), first("other").alias("notes"))


def crawler_items(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The jobs as rows that are stored: keys, code, title, organization, major, age, education, other, slots and text."""
    code = F.when(~F.col("id").rlike(r"^[0-9]+\z"), F.col("id"))
    blob = F.concat_ws(" ", *[F.nullif(text(c), F.lit("")) for c in (F.col("title"), F.col("organization"), stated("major"), stated("age"), stated("education"), F.col("other"))])
    return jobs.select(*keys, code.alias("code"), "title", F.nullif("organization", F.lit("")).alias("organization"), stated("major").alias("major"), stated("age").alias("age"), stated("education").alias("education"), F.nullif("other", F.lit("")).alias("other"), "slots", blob.alias("text"))

"""The read path: which postings are shown, and as what rows; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import rules, titles
from ..functions.text import with_once
from . import sqlrules as S
from .catalog import query
from .generated import POSTINGS

TITLED = f"SELECT *, {S.trim('title')} AS t FROM {POSTINGS.sql} AS p"


@query(f"WITH a AS ({TITLED}), b AS (SELECT id, t, {S.cut('t')} AS v FROM a) SELECT id, v AS kept, {S.garbled('t')} AS garbled, {S.bad_reason('v')} AS reason FROM b")
def bad_title_reason(spark, sf_dir):
    """What page junk leaves of a title, and why it's none."""
    c = F.col("title")
    return POSTINGS.rows(spark, sf_dir).select("id", rules.cut_scrape_junk(c).alias("kept"), rules.is_garbled(c).alias("garbled"), titles.bad_title_reason(c).alias("reason"))


def _shown(spark, sf_dir):
    """Live postings with the organisation and the card title that are shown."""
    c = F.col
    owner = F.coalesce(F.nullif("organization", F.lit("")), "source")
    rows = POSTINGS.rows(spark, sf_dir).filter(~c("deleted"))
    title = titles.card_title(c("title"), c("announcement"), c("raw_text"), F.coalesce(c("source"), F.lit("")) != "")
    return with_once(rows, owner=titles.organization(owner, c("source")), card_title=title)


def _sql_accept(p: str) -> str:
    return f"CASE WHEN length({p}) BETWEEN 2 AND 40 AND NOT regexp_matches({p}, '{L.NO_POST_NAME}') AND ({S.bad_reason(p)}) IS NULL THEN {p} END"


LINE = S.cut(S.trim("x"))
SHOWN = f"""a AS (
  SELECT *, {S.trim('title')} AS t, {S.trim('announcement')} AS an, coalesce(raw_text, '') AS raw, regexp_replace(coalesce(raw_text, ''), '{S.BLANKS}+', ' ', 'g') AS blob,
         {S.trim("coalesce(nullif(organization, ''), source)")} AS own FROM {POSTINGS.sql} AS p WHERE NOT deleted),
b AS (
  SELECT *, {S.cut('t')} AS v, {S.cut('an')} AS av, {S.cut('own')} AS ov, {S.cut(S.trim(f"regexp_extract(blob, '{L.POST_NAMES[0]}', 1)"))} AS p1,
         {S.cut(S.trim(f"regexp_extract(blob, '{L.POST_NAMES[1]}', 1)"))} AS p2, {S.cut(S.trim(f"regexp_extract(blob, '{L.POST_NAMES[2]}', 1)"))} AS p3,
         list_filter(list_transform(string_split_regex(raw, '\\r?\\n'), lambda x: {LINE}), lambda x: x <> '')[1:40] AS lines FROM a),
c AS (
  SELECT *, {S.trim(f"regexp_replace(regexp_replace(v, '{L.LIST_TAIL}', ''), '{L.LIST_FILE}', '')")} AS bare,
         CASE WHEN ({S.bad_reason('v')}) IS NULL THEN left(v, 120) END AS direct, CASE WHEN ({S.bad_reason('av')}) IS NULL THEN left(av, 120) END AS stated,
         coalesce({_sql_accept('p1')}, {_sql_accept('p2')}, {_sql_accept('p3')}) AS post,
         list_filter(lines, lambda x: regexp_matches(x, '{L.TITLE_LINE}') AND length(x) BETWEEN 6 AND 60 AND NOT {S.header('x')} AND ({S.bad_reason('x')}) IS NULL)[1] AS line,
         CASE WHEN {S.garbled('ov')} THEN source ELSE left(ov, 60) END AS owner FROM b),
d AS (
  SELECT *, coalesce(CASE WHEN regexp_matches(v, '{L.LIST_TITLE}') AND length(bare) >= 8 AND contains(bare, '招聘') AND ({S.bad_reason('bare')}) IS NULL THEN left(bare, 120) END,
         direct, post, CASE WHEN NOT regexp_matches(stated, '{L.GENERIC_TITLE}') THEN stated END, line, stated, CASE WHEN coalesce(source, '') <> '' THEN '招聘岗位' ELSE '招聘公告' END) AS picked FROM c),
shown AS (
  SELECT *, CASE WHEN NOT starts_with(picked, '非事业编制') AND regexp_matches(concat_ws(chr(10), an, t, trim(left(raw, 2000))), '{L.OUTSIDE_STAFF}')
         THEN '非事业编制 · ' || picked ELSE picked END AS card_title FROM d)"""
REBUILT = S.trim("concat_ws(' ', nullif(title, ''), nullif(owner, ''), '年龄要求：' || nullif(age_limit, ''), '政治面貌：' || nullif(party, ''), '专业要求：' || nullif(major, ''), '学历：' || nullif(education, ''), nullif(notes, ''))")


@query(f"WITH {SHOWN} SELECT id, owner, card_title FROM shown")
def card_titles(spark, sf_dir):
    """The title and owner of each live posting's card."""
    return _shown(spark, sf_dir).select("id", "owner", "card_title")


LISTED = "coalesce(nullif(announcement, ''), title)"


@query(f"""
WITH {SHOWN}, e AS (SELECT *, {S.trim(LISTED)} AS lt, {S.collapse(LISTED)} AS lc FROM shown)
SELECT id, card_title AS title, province, nullif(source, '') AS source, published, deadline, left(CASE WHEN {S.garbled(S.trim('raw'))} THEN {REBUILT} ELSE raw END, 800) AS raw_text,
       coalesce(nullif(status, ''), 'NORMAL') AS status FROM e
WHERE NOT {S.other_notice('lc')} AND NOT {S.other_notice('card_title')} AND NOT {S.garbled('lt')} AND NOT {S.garbled('card_title')}""")
def feed_rows(spark, sf_dir):
    """What the feed admits, as its default rows."""
    c = F.col
    listed = F.coalesce(F.nullif("announcement", F.lit("")), "title")
    admitted = _shown(spark, sf_dir).filter(~rules.is_other_notice(listed) & ~rules.is_other_notice(c("card_title")) & ~rules.is_garbled(listed) & ~rules.is_garbled(c("card_title")))
    made = titles.display_text(c("raw_text"), c("title"), c("owner"), c("age_limit"), c("party"), F.array_compact(F.array(F.nullif("major", F.lit("")))), c("education"), c("notes"))
    text = F.left(F.when(rules.is_garbled(c("raw_text")), made).otherwise(c("raw_text")), F.lit(800))
    return admitted.select("id", c("card_title").alias("title"), "province", F.nullif("source", F.lit("")).alias("source"), "published", "deadline", text.alias("raw_text"), F.coalesce("status", F.lit("NORMAL")).alias("status"))


@query(f"WITH {SHOWN} SELECT id, title, raw AS raw_text, coalesce(status, 'NORMAL') AS status, []::VARCHAR[] AS conflicts FROM shown WHERE published IS NOT NULL")
def feed_lines(spark, sf_dir):
    """The lines form of postings."""
    rows = POSTINGS.rows(spark, sf_dir).filter("NOT deleted AND published IS NOT NULL")
    return rows.select("id", "title", F.coalesce("raw_text", F.lit("")).alias("raw_text"), F.coalesce("status", F.lit("NORMAL")).alias("status"), F.array().cast("array<string>").alias("conflicts"))

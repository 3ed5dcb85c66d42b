"""Signs of code, row titles, publication dates and urgency; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, signals
from . import sqlrules as S
from .catalog import query
from .generated import BODIES, HEADS, NOW, Made

SNIPPETS = Made(
    "orders",
    "o_orderkey",
    code=(["", "function a() {} ", "function _nl_x(a) { b } ", "var _nl_q = 1; ", "document.write(x) ", "window.openx ", "eval (x) ", "招聘公告"], ["", "function b(", "var a let b const c ", "var a let b const c window ", "function", "公开招聘岗位若干名请按时报名参加考试并关注通知"], ["", "window d", "字" * 20, "字" * 60]),
    title=(HEADS, BODIES, ["", " · 二级", "，详见附件", "及其他若干相关岗位的补充说明文字内容"]),
    label=(["", "发布时间：", "日期 "], ["2026-03-01", "2026.3.1", "2026/12/31", "2026-02-30", "2026年3月5日", "2026年13月1日", "昨天", "26-3-1", ""], ["", " 10:00"]),
    deadline=(["2026-03-01", "2026-03-05", "2026-03-06", "2026-03-07", "2026-02-01", "长期", ""],),
)
ROW = S.collapse("title")


@query(f"""
WITH a AS (SELECT *, {ROW} AS v, {S.trim('label')} AS l, length(regexp_replace(code, '[^一-龥]', '', 'g')) AS cjk,
  len(regexp_extract_all(code, '\\bfunction\\s+\\w+\\s*\\(')) AS f, len(regexp_extract_all(code, '\\b(?:var|let|const|document|window|eval|jQuery|\\$\\()\\b')) AS k FROM {SNIPPETS.sql} AS s),
b AS (SELECT *, {S.cut('v')} AS cv, CASE WHEN regexp_matches(l, '{signals.DATES[0]}') THEN regexp_extract(l, '{signals.DATES[0]}') ELSE regexp_extract(l, '{signals.DATES[1]}') END AS d FROM a)
SELECT id, f >= 2 OR (f >= 1 AND cjk < 20) OR (k >= 4 AND cjk / greatest(length(code), 1) < 0.08) OR {' OR '.join(f"regexp_matches(code, '{p}')" for p in signals.CODE[:7])} AS heavy_code,
  v <> '' AND ({S.bad_reason('cv')}) IS NULL AND v NOT IN ('岗位', '未命名岗位') AND (contains(v, ' · ') OR (length(v) <= 32 AND NOT regexp_matches(v, '[，。；：]')) OR length(v) <= 24) AS row_title,
  try_strptime(regexp_replace(d, '([0-9]+)[^0-9]+([0-9]+)[^0-9]+([0-9]+)日?', '\\1-\\2-\\3'), '%Y-%m-%d') + INTERVAL 4 HOUR AS published,
  coalesce(date_diff('second', TIMESTAMP '{NOW}', try_strptime(deadline, '%Y-%m-%d') + INTERVAL 86399 SECOND) <= 5 * 86400, false) AS urgent FROM b""")
def notice_signals(spark, sf_dir):
    """Scripts in texts, titles of rows, dates of publication, and what closes within five days."""
    c = F.col
    left = dates.days_left(dates.deadline_end(c("deadline")), F.lit(NOW).cast("timestamp"))
    return SNIPPETS.rows(spark, sf_dir).select("id", signals.is_heavy_code(c("code")).alias("heavy_code"), signals.is_row_title(c("title")).alias("row_title"), signals.publish_time(c("label")).alias("published"), signals.is_urgent(left).alias("urgent"))

"""Addresses: scores, shapes and whether they're taken; with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from .catalog import query
from .generated import Made

LINKS = Made(
    "orders",
    "o_orderkey",
    url=(["https://", "http://", "HTTPS://", "ftp://", "", "javascript:"], ["rsc.hnu.edu.cn", "www.school.edu.cn", "rst.hunan.gov.cn", "hr.corp.com", "zp.site.org"], ["", "/", "/info/1012/3456.htm", "/info/1012/x.htm", "/content.jsp", "/2026/03/99", "/2026/3/99", "/article_12.html", "/zczd/a.html", "/column/5", "/list.htm", "/lists.htm", "/index.html", "/zpxx/index.htm", "/rsxx/index.shtml", "/t20260301_12345.html", "/t2026_1.html", "/a/notice.pdf", "/招聘/index.html"], ["", "", "?id=1", "#top", "?x=/info/1/2.html", ".docx"]),
    title=(["招聘信息", "人才引进", "通知公告", "HR login", ""],),
    list_url=(["https://rsc.hnu.edu.cn/list.htm", "http://www.school.edu.cn", "", "none"],),
)
RULES = " + ".join(f"CASE WHEN regexp_matches(u, '{p}') THEN {n} ELSE 0 END" for p, n in urls.SCORES)
HOST = r"lower(nullif(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), ''))"


@query(f"""
WITH a AS (SELECT *, lower(url) AS u FROM {LINKS.sql} AS l),
b AS (SELECT id, u, {RULES} + CASE WHEN regexp_matches(title, '招聘|招贤|引才|人才|人事') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(u, 'index\\.html?(?:\\?|#|$)') AND regexp_matches(u, 'zpxx|zp|rsxx|招聘') THEN 1 ELSE 0 END AS score FROM a)
SELECT id, score, score >= 4 AS is_list FROM b ORDER BY score DESC, id LIMIT 500""")
def list_page_scores(spark, sf_dir):
    """The best-scored links, and which are lists of notices."""
    rows = LINKS.rows(spark, sf_dir).select("id", urls.score(F.col("url"), F.col("title")).alias("score"))
    return rows.withColumn("is_list", F.col("score") >= 4).orderBy(F.desc("score"), "id").limit(500)


@query(f"""
WITH a AS (SELECT *, {HOST.format('url')} AS h, {HOST.format('list_url')} AS lh, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^#]*)', 1) AS p FROM {LINKS.sql} AS l)
SELECT id, h AS host, coalesce(regexp_matches(lower(url), '^https?://') AND (list_url = '' OR h = lh)
    AND (regexp_matches(p, '{urls.DETAIL[0]}') OR regexp_matches(p, '{urls.DETAIL[1]}')), false) AS is_detail,
  h IS NOT NULL AND regexp_matches(lower(regexp_replace(p, '\\?.*$', '')), '{urls.COLUMN_PAGES}') AS is_column FROM a""")
def link_shapes(spark, sf_dir):
    """pages of single notices on the list's host, and pages of columns."""
    c = F.col
    return LINKS.rows(spark, sf_dir).select("id", urls.host(c("url")).alias("host"), urls.is_detail_page(c("url"), c("list_url")).alias("is_detail"), urls.is_column_page(c("url")).alias("is_column"))

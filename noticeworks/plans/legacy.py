"""Legacy jobs, raw jobs and sources: lists, creation and changes; with equal SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, legacy, rules
from ..functions import lexicon as L
from ..functions.text import bind, preview, trim, with_once
from ..operators import dedupe, snapshots
from . import sqlrules as S
from .catalog import query
from .generated import NOW, POSTINGS, Made

JOBS = Made(
    "part",
    "p_partkey",
    title=(["", "[南方大学] ", "[ ] ", "湖南师范大学", "长沙市", "《某研究院", "《"], ["招聘公告", "博士后招聘公告", "选调公务员", "公开招聘》", "", "事业单位招聘》"]),
    deadline=(["2026-03-31", "2026-02-01", "2026年3月1日", "长期", "", "2026-03-01", "未知", None],),
    majors=(["", "法学", "计算机 硕士", "本科 不限", None],),
    slots=(["3", "3-5人", "", "若干", "0", None],),
    category=(["", "高校院所招聘", "事业编岗位", "博士后招聘", "其他", "人才引进 高校", None],),
    organization=(["", "某市人社局", None],),
    place=(["", "湖南·长沙", "北京", None],),
    education=(["", "本科", None],),
    summary=(["", "摘要", None],),
    content=(["", "在武汉招聘 若干人员", "北京高校辅导员  大专以上\n报名", "长" , None], ["", "文字内容" * 100, "字" * 400, "字" * 401]),
    published=(["", "2026-02-02", None],),
    created=["2026-01-01", "2026-02-15", "2026-02-28"],
    status=(["PENDING", "PUBLISHED", "IGNORED"],),
    deleted=([True, False, False],),
)
END = f"""(CASE WHEN NOT regexp_matches({S.trim('deadline')}, '(?i){L.NO_DEADLINE}') AND {S.trim('deadline')} <> '' THEN
  try_strptime(CASE WHEN regexp_matches({S.trim('deadline')}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN regexp_extract({S.trim('deadline')}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}')
    ELSE regexp_replace(regexp_extract({S.trim('deadline')}, '\\d{{4}}年\\d{{1,2}}月\\d{{1,2}}日'), '(\\d+)年(\\d+)月(\\d+)日', '\\1-\\2-\\3') END, '%Y-%m-%d') + INTERVAL 86399 SECOND END)"""


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


@query(f"SELECT id, title, created, row_number() OVER (ORDER BY created DESC, id) AS nth FROM {JOBS.sql} AS j WHERE NOT deleted QUALIFY nth <= 100")
def legacy_newest(spark, sf_dir):
    """All live legacy jobs, newest first; the first hundred, numbered."""
    rows = JOBS.rows(spark, sf_dir).filter("NOT deleted").select("id", "title", "created").orderBy(F.desc("created"), "id").limit(100)
    return rows.withColumn("nth", F.row_number().over(snapshots.everything().orderBy(F.desc("created"), "id")).cast("long"))


@query(f"SELECT id, title, published FROM {JOBS.sql} AS j WHERE status = 'PENDING' AND NOT deleted ORDER BY published DESC NULLS LAST, id LIMIT 50")
def raw_pending(spark, sf_dir):
    """Raw jobs that wait, by their date as text."""
    return JOBS.rows(spark, sf_dir).filter("status = 'PENDING' AND NOT deleted").select("id", "title", "published").orderBy(F.desc_nulls_last("published"), "id").limit(50)


def _case(c: str, rules, default: str) -> str:
    return f"CASE {' '.join(f'''WHEN {test} THEN '{name}' ''' for name, test in rules)} ELSE '{default}' END"


CITY = _case("x", [(n, f"contains(context, '{n}')") for n in legacy.CITIES], "长沙")
CATEGORY = _case("x", [("高校编制" if n == "高校教师" else n, " OR ".join(f"contains(context, '{w}')" for w in words)) for n, words in legacy.CATEGORIES], "事业编")
LEVEL = _case("x", [(n, f"regexp_matches(level_text, '{p}')") for n, p in legacy.EDUCATION], "")
OWNED = f"""a AS (SELECT *, {S.trim('title')} AS t, {END} AS deadline_end FROM {JOBS.sql} AS j),
o AS (SELECT *, regexp_extract(t, '^\\[([^\\]]+)\\]\\s*(.*)$', 1) AS inside, {S.trim("regexp_extract(t, '^\\[([^\\]]+)\\]\\s*(.*)$', 2)")} AS rest FROM a),
p AS (SELECT *, CASE WHEN inside <> '' THEN {S.trim('inside')} ELSE {S.trim(f"regexp_extract(t, '{legacy.OWNER}', 1)")} END AS owner, CASE WHEN inside <> '' AND rest <> '' THEN rest ELSE t END AS own_title FROM o)"""


@query(f"""
WITH {OWNED},
b AS (SELECT *, CASE WHEN starts_with(own_title, '《') AND ends_with(own_title, '》') THEN {S.trim('substr(own_title, 2, length(own_title) - 2)')} ELSE own_title END AS shown,
  coalesce(nullif({S.trim('organization')}, ''), nullif(owner, ''), '招聘单位') AS org, {S.trim('majors')} AS m, {S.trim('content')} AS body FROM p WHERE NOT deleted AND deadline_end >= TIMESTAMP '{NOW}'),
c AS (SELECT *, org || shown || m || body AS context, m || body || shown AS level_text, {S.collapse("coalesce(nullif(body, ''), m)")} AS flat FROM b)
SELECT id, org AS organization, shown AS title, coalesce(nullif({S.trim('published')}, ''), created) AS published, deadline,
  coalesce(nullif({S.trim('category')}, ''), {CATEGORY}) AS category, coalesce(nullif({S.trim('place')}, ''), {CITY}) AS place, coalesce(try_cast(regexp_replace(coalesce(slots, ''), '[^0-9]', '', 'g') AS INT), 0) AS slots, m AS majors,
  coalesce(nullif({S.trim('education')}, ''), nullif({LEVEL}, ''), '详见原文') AS education,
  CASE WHEN {S.trim('summary')} <> '' THEN {S.trim('summary')} WHEN length(flat) > 320 THEN left(flat, 320) || '…' ELSE flat END AS summary FROM c""")
def home_cards(spark, sf_dir):
    """Visible legacy jobs as home cards."""
    c = F.col
    rows = JOBS.rows(spark, sf_dir).filter(~c("deleted") & dates.is_visible(dates.deadline_end(c("deadline")), now()))
    split = with_once(rows, split=legacy.owner_and_title(c("title")))

    def stated(name: str) -> Column:
        return bind(trim(c(name)), lambda v: F.when(v != "", v))

    named = with_once(split, shown=legacy.bare_title(c("split.title")), org=F.coalesce(stated("organization"), F.nullif(c("split.owner"), F.lit("")), F.lit("招聘单位")), m=trim(c("majors")), body=trim(c("content")))
    context = F.concat("org", "shown", "m", "body")
    level = legacy.education(F.concat("m", "body", "shown"))
    return named.select(
        "id",
        c("org").alias("organization"),
        c("shown").alias("title"),
        F.coalesce(stated("published"), c("created")).alias("published"),
        "deadline",
        F.coalesce(stated("category"), legacy.category_label(legacy.category(context))).alias("category"),
        F.coalesce(stated("place"), legacy.city(context)).alias("place"),
        legacy.slots(c("slots")).alias("slots"),
        c("m").alias("majors"),
        F.coalesce(stated("education"), bind(level, lambda v: F.when(v != "", v)), F.lit("详见原文")).alias("education"),
        legacy.summary(c("summary"), F.when(c("body") != "", c("body")).otherwise(c("m"))).alias("summary"),
    )


TRACK = "CASE " + f"WHEN k IN ({', '.join(repr(n) for n, _ in L.TRACKS)}) THEN k " + " ".join(f"WHEN regexp_matches(k, '{p}') THEN '{n}'" for n, p in L.TRACKS) + " ELSE '' END"


@query(f"""
WITH {OWNED}, b AS (SELECT *, {S.trim('category')} AS k, {S.trim('content')} AS body FROM p)
SELECT id, CASE WHEN own_title = '' OR (starts_with(own_title, '《') AND ends_with(own_title, '》')) THEN own_title ELSE '《' || own_title || '》' END AS title, {TRACK} AS category,
  coalesce(try_cast(regexp_replace(coalesce(slots, ''), '[^0-9]', '', 'g') AS INT), 0) AS slots, coalesce(nullif({S.trim('organization')}, ''), owner) AS organization,
  CASE WHEN {S.trim('summary')} <> '' THEN {S.trim('summary')} WHEN length(body) > 400 THEN left(body, 400) || '…' ELSE body END AS summary,
  coalesce(nullif({S.trim('published')}, ''), '{NOW[:10]}') AS published
FROM b WHERE own_title <> '' AND {TRACK} <> ''""")
def legacy_create(spark, sf_dir):
    """Rows that may be created as legacy jobs, in their stored form."""
    c = F.col
    rows = with_once(JOBS.rows(spark, sf_dir), split=legacy.owner_and_title(c("title")), k=rules.track(c("category")), body=trim(c("content")))
    organization = F.when(trim(c("organization")) != "", trim(c("organization"))).otherwise(c("split.owner"))
    summary = F.when(trim(c("summary")) != "", trim(c("summary"))).otherwise(preview(c("body"), 400))
    published = F.when(trim(c("published")) != "", trim(c("published"))).otherwise(NOW[:10])
    return rows.filter((c("split.title") != "") & (c("k") != "")).select("id", legacy.book_title(c("split.title")).alias("title"), c("k").alias("category"), legacy.slots(c("slots")).alias("slots"), organization.alias("organization"), summary.alias("summary"), published.alias("published"))


@query(f"""
WITH a AS (SELECT id, category, status, {S.trim('category')} AS k FROM {JOBS.sql} AS j)
SELECT id, CASE WHEN id % 3 = 0 AND {TRACK} <> '' THEN {TRACK} ELSE category END AS category, CASE WHEN id % 5 = 0 THEN 'PUBLISHED' ELSE status END AS status FROM a""")
def raw_patch(spark, sf_dir):
    """K9: some raw jobs get a normalised category, some another status; what isn't patched stays."""
    c = F.col
    rows = with_once(JOBS.rows(spark, sf_dir), k=rules.track(c("category")))
    return snapshots.patch(rows, {"category": ((c("id") % 3 == 0) & (c("k") != ""), c("k")), "status": (c("id") % 5 == 0, F.lit("PUBLISHED"))}).select("id", "category", "status")


@query(f"""
WITH s AS (SELECT *, published IS NULL AND deadline IS NULL AND coalesce(slots, 0) <= 0 AND NOT coalesce(try_cast(positions AS INT) > 0, false) AS empty FROM {POSTINGS.sql} AS p)
SELECT id, deleted OR empty AS is_deleted, CASE WHEN empty AND NOT deleted THEN TIMESTAMP '{NOW}' END AS deleted_at FROM s""")
def purge_incomplete(spark, sf_dir):
    """Postings without dates and slots are deleted softly, all at once."""
    c = F.col
    rows = POSTINGS.rows(spark, sf_dir).select("id", "published", "deadline", "slots", "positions", c("deleted").alias("is_deleted"), F.lit(None).cast("timestamp").alias("deleted_at"))
    number = rules.slots(c("slots"), c("positions").try_cast("int"))
    return snapshots.soft_delete(rows, rules.is_incomplete(c("deadline"), c("published"), number), now()).select("id", "is_deleted", "deleted_at")


@query("""
WITH s AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS priority, {'a': c_nationkey, 'b': 1} AS old FROM customer),
n AS (SELECT s_suppkey AS k, 'Customer#' || lpad((s_suppkey * 7)::VARCHAR, 9, '0') AS name, s_acctbal AS priority, s_nationkey AS c FROM supplier),
last AS (SELECT name, arg_max(priority, k) AS priority, arg_max(c, k) AS c FROM n GROUP BY name)
SELECT coalesce(s.name, l.name) AS name, coalesce(l.priority, s.priority) AS priority,
  CASE WHEN s.name IS NULL THEN '{"c":' || l.c || '}' WHEN l.name IS NULL THEN '{"a":' || s.old.a || ',"b":1}' ELSE '{"a":' || s.old.a || ',"b":1,"c":' || l.c || '}' END AS config
FROM s FULL JOIN last l ON s.name = l.name""")
def source_upsert(spark, sf_dir):
    """Sources by name; keys of the new configuration are laid over the old ones."""
    c = F.col
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c("c_name").alias("name"), c("c_acctbal").alias("priority"), F.create_map(F.lit("a"), "c_nationkey", F.lit("b"), F.lit(1)).alias("config"))
    new = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("Customer#"), F.lpad((c("s_suppkey") * 7).cast("string"), 9, "0")).alias("name"), c("s_acctbal").alias("priority"), F.create_map(F.lit("c"), "s_nationkey").alias("config"), "s_suppkey")
    merged = snapshots.upsert_merging(old, new, ["name"], ["priority"], "config", [c("s_suppkey")])
    return merged.select("name", "priority", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("config")))).alias("config"))


@query(f"""
WITH bad AS (SELECT id, regexp_matches(title || chr(10) || coalesce(raw_text, ''), '工作表|Sheet[0-9]|^---') AS dirty, title FROM {POSTINGS.sql} AS p)
SELECT id, title FROM bad WHERE NOT dirty ORDER BY id LIMIT 5""")
def seed_cleaning(spark, sf_dir):
    """Rows with traces of sheets go; the first five that stay are the seed."""
    c = F.col
    dirty = F.concat_ws("\n", "title", F.coalesce("raw_text", F.lit(""))).rlike("工作表|Sheet[0-9]|^---")
    return POSTINGS.rows(spark, sf_dir).filter(~dirty).select("id", c("title")).orderBy("id").limit(5)


@query("SELECT 'default' AS name, 1 AS priority WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_name = 'default') UNION ALL SELECT s_name, s_suppkey::INT FROM supplier")
def default_source(spark, sf_dir):
    """The default source is added where there is none."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("int").alias("priority"))
    return own.union(snapshots.without(spark.createDataFrame([("default", 1)], "name string, priority int"), own, ["name"]))


@query("SELECT coalesce((SELECT least(greatest(floor(max(s_acctbal) / 1000 + 0.5), 0), 365)::INT FROM supplier WHERE s_suppkey < 0), 5) AS absent, coalesce((SELECT least(greatest(floor(max(s_acctbal) / 1000 + 0.5), 0), 365)::INT FROM supplier), 5) AS present")
def settings_read(spark, sf_dir):
    """One stored number, held to its range, and 5 where none is stored."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    kept = F.coalesce(F.max(F.when(F.col("s_suppkey") < 0, F.col("s_acctbal"))).cast("string"), F.lit(""))
    return s.agg(kept.alias("a"), (F.max("s_acctbal") / 1000).cast("decimal(12,3)").cast("string").alias("b")).select(dates.grace(F.col("a")).alias("absent"), dates.grace(F.col("b")).alias("present"))


STORED = Made("customer", "c_custkey", source=([1, 2, 3],), url=(["/a", "/b", "/c", "/d", None], ["", "1", "2", "3", "4", "5", "6", "7"]), title=(["公开招聘辅导员公告", "某大学公开招聘教师公告", "报名表", "Sheet1", "首页", "", None],), raw_text=(["旧文一段", "旧文"],), status=(["PERFECT", None],), deleted=([True, False, False],))
COMING = Made("orders", "o_orderkey", source=([1, 2, 3, 3],), url=(["/a", "/b", "/c", "/e", None], ["", "1", "2", "3", "4", "5", "6", "7"]), title=(["公开招聘辅导员公告", "某大学公开招聘教师公告", "某大学公开招聘教师公告 {color:red}", "·.tab{", "报名表", "招聘启事", None],), raw_text=(["新文第", "", "---", "某县招聘"], ["一段", "二段", ""]))


@query(f"""
WITH old AS (SELECT id, source, url, title, raw_text, status, deleted FROM {STORED.sql} AS s QUALIFY row_number() OVER (PARTITION BY source, url, title ORDER BY id) = 1),
cut AS (SELECT id, source, url, {S.cut(S.trim('title'))} AS v, raw_text, {S.trim('raw_text')} AS raw FROM {COMING.sql} AS c),
clean AS (SELECT *, CASE WHEN ({S.bad_reason('v')}) IS NOT NULL THEN '未命名岗位' ELSE left(v, 120) END AS t FROM cut),
good AS (SELECT * FROM clean WHERE t <> '' AND NOT {S.garbled('t')} AND raw <> '' AND NOT {S.garbled('raw')}),
fresh AS (SELECT source, url, t, min(id) AS first, arg_max(raw_text, id) AS raw_text, max(id) AS id FROM good GROUP BY ALL),
alone AS (SELECT source, url, any_value(v) AS v, any_value(title) AS lone FROM (SELECT *, {S.cut(S.trim('title'))} AS v FROM old) WHERE url IS NOT NULL GROUP BY source, url HAVING count(*) = 1),
bad AS (SELECT * FROM alone WHERE lone IS NOT NULL AND ({S.bad_reason('v')}) IS NOT NULL),
exact AS (SELECT f.*, o.title IS NOT NULL AS same FROM fresh f LEFT JOIN (SELECT DISTINCT source, url, title FROM old) o ON o.source = f.source AND o.url = f.url AND o.title = f.t),
placed AS (SELECT e.*, CASE WHEN same THEN t WHEN b.lone IS NOT NULL AND row_number() OVER (PARTITION BY e.source, e.url, same ORDER BY first) = 1 THEN b.lone END AS target FROM exact e LEFT JOIN bad b ON b.source = e.source AND b.url = e.url),
changes AS (SELECT *, row_number() OVER (PARTITION BY source, url, target ORDER BY (t <> target) DESC) AS k FROM placed WHERE target IS NOT NULL)
SELECT o.id, o.source, o.url, coalesce(c.t, o.title) AS title, coalesce(c.raw_text, o.raw_text) AS raw_text, o.status, o.deleted, CASE WHEN c.t IS NULL THEN 'kept' ELSE 'updated' END AS outcome
FROM old o LEFT JOIN changes c ON c.source = o.source AND c.url = o.url AND c.target = o.title AND c.k = 1
UNION ALL SELECT id, source, url, t, raw_text, NULL, NULL, 'created' FROM placed WHERE target IS NULL""")
def postings_upsert(spark, sf_dir):
    """K1: readable postings update those of their title, replace a lone title that is none, or are added."""
    old = dedupe.pick(STORED.rows(spark, sf_dir), ["source", "url", "title"], [F.col("id")])
    return snapshots.upsert_postings(old, COMING.rows(spark, sf_dir), ["source", "url"], "title", "raw_text", ["raw_text"], [F.col("id")])

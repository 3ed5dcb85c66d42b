"""Registered queries over the notice operators, and equal SQL for each that SQL can express.

The driver's tables stand in for postings (orders), sources (customer, supplier), structured rows (lineitem), crawl
events, list and detail pages and raw texts. Rules in Chinese have queries over generated rows in the other modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, rules, urls
from ..functions.text import hits, preview
from ..operators import dedupe, matching, merging, sequences, snapshots
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "1998-01-01 00:00:00"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def fixture(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def values(rows: list[tuple], names: str) -> str:
    """The fixture as an SQL relation."""

    def cell(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS f({names})"


# --- scans, joins, ranking, pages -------------------------------------------------------------------------------


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and pending postings with their source and its region; F stands for deleted."""
    o = t(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    c, n = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


@query("""
SELECT o_orderkey AS posting, c_name AS source, n_name AS city, o_orderdate AS published,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'PERFECT' WHEN o_orderpriority LIKE '5%' THEN 'CONFLICT' ELSE 'NORMAL' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus <> 'F'
ORDER BY CASE status WHEN 'PERFECT' THEN 0 WHEN 'NORMAL' THEN 1 ELSE 2 END, published DESC NULLS LAST, posting LIMIT 20""")
def feed_ranked(spark, sf_dir):
    """The first page of the live feed by match status, newest first."""
    status = F.when(F.col("o_orderpriority").startswith("1"), "PERFECT").when(F.col("o_orderpriority").startswith("5"), "CONFLICT").otherwise("NORMAL")
    feed = _postings(spark, sf_dir).select(F.col("o_orderkey").alias("posting"), F.col("c_name").alias("source"), F.col("n_name").alias("city"), F.col("o_orderdate").alias("published"), status.alias("status"))
    return sequences.page(feed, [matching.rank(F.col("status")), F.desc_nulls_last("published"), F.col("posting")], 1)


@query("SELECT o_orderkey AS posting, o_custkey AS source, o_orderdate AS published FROM orders WHERE o_orderstatus <> 'F' ORDER BY published DESC NULLS LAST, posting LIMIT 20 OFFSET 40")
def pagination_page_n(spark, sf_dir):
    """The third page."""
    live = t(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("posting"), F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("published"))
    return sequences.page(live, [F.desc_nulls_last("published"), F.col("posting")], 3)


@query("SELECT o_orderkey AS posting, o_orderdate AS deleted_at, c_name AS source FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def trash_list(spark, sf_dir):
    """Deleted postings with their source; the list's order is the reader's."""
    o, c = t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), t(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("posting"), F.col("o_orderdate").alias("deleted_at"), F.col("c_name").alias("source"))


@query("SELECT s_suppkey, s_name, n_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_name, s_suppkey) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY place <= 3")
def multi_key_sources(spark, sf_dir):
    """Each city's first three sources by priority, then name."""
    s, n = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "nation")
    joined = s.join(n, s.s_nationkey == n.n_nationkey)
    order = [F.desc_nulls_last("s_acctbal"), F.col("s_name"), F.col("s_suppkey")]
    return dedupe.ranked(joined.withColumn("place", F.row_number().over(sequences.W.partitionBy("s_nationkey").orderBy(*order))), ["s_nationkey"], order, 3).select("s_suppkey", "s_name", "n_name", "place")


@query("SELECT event_type, CASE WHEN count(*) FILTER (value < 1) * 50 > count(*) THEN 'BROKEN' ELSE 'HEALTHY' END AS status, count(*) AS n, count(DISTINCT user_id) AS sources, max(ts) AS last_run FROM events GROUP BY event_type")
def health_summary(spark, sf_dir):
    """State of each kind of crawl."""
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.when(F.count_if(F.col("value") < 1) * 50 > F.count("*"), "BROKEN").otherwise("HEALTHY").alias("status"), F.count("*").alias("n"), F.count_distinct("user_id").alias("sources"), F.max("ts").alias("last_run"))


# --- snapshots ---------------------------------------------------------------------------------------------------


def _snapshot(spark, sf_dir) -> DataFrame:
    deleted = F.col("o_orderstatus") == "F"
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("posting"), F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("deadline"), deleted.alias("is_deleted"), F.when(deleted, F.col("o_orderdate")).alias("deleted_at"))


EXPIRED = "NOT is_deleted AND deadline + INTERVAL 5 DAY < TIMESTAMP '1998-01-01'"
SNAPSHOT = "SELECT o_orderkey AS posting, o_custkey AS source, o_orderdate AS deadline, o_orderstatus = 'F' AS is_deleted, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders"


@query(f"WITH s AS ({SNAPSHOT}) SELECT posting, source, deadline, is_deleted OR deadline + INTERVAL 5 DAY < TIMESTAMP '{NOW}' AS is_deleted, CASE WHEN {EXPIRED} THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at FROM s")
def expire_snapshot(spark, sf_dir):
    """Postings past their deadline and grace are deleted softly."""
    return snapshots.soft_delete(_snapshot(spark, sf_dir), dates.is_expired(F.col("deadline"), now(), 5), now())


@query(f"WITH s AS ({SNAPSHOT}) SELECT count(*) AS n, count(*) FILTER ({EXPIRED}) AS expired, count(*) FILTER (is_deleted AND deleted_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS purged, count(*) FILTER (NOT is_deleted AND deadline >= TIMESTAMP '{NOW}') AS visible FROM s")
def janitor_counts(spark, sf_dir):
    """What one run of the janitor does."""
    s = _snapshot(spark, sf_dir)
    expired = ~F.col("is_deleted") & dates.is_expired(F.col("deadline"), now(), 5)
    old = F.col("is_deleted") & (F.col("deleted_at") < F.timestamp_add("DAY", F.lit(-7), now()))
    return s.agg(F.count("*").alias("n"), F.count_if(expired).alias("expired"), F.count_if(old).alias("purged"), F.count_if(~F.col("is_deleted") & dates.is_visible(F.col("deadline"), now())).alias("visible"))


@query(f"WITH s AS ({SNAPSHOT}) SELECT * FROM s WHERE NOT coalesce(is_deleted AND deleted_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY, false)")
def purge_snapshot(spark, sf_dir):
    """Without what was deleted more than a week ago."""
    return snapshots.purge(_snapshot(spark, sf_dir), now())


@query(f"WITH s AS ({SNAPSHOT}) SELECT posting, source, deadline, is_deleted AND source % 7 <> 0 AS is_deleted, CASE WHEN source % 7 <> 0 THEN deleted_at END AS deleted_at FROM s")
def restore_snapshot(spark, sf_dir):
    """K6, K7: some sources' postings come back from the trash."""
    return snapshots.restore(_snapshot(spark, sf_dir), F.col("source") % 7 == 0)


@query("""
WITH new AS (
  SELECT l_orderkey AS posting, arg_max(l_suppkey, (l_shipdate, l_linenumber)) AS source, arg_max(l_shipdate, (l_shipdate, l_linenumber)) AS deadline
  FROM (SELECT l_orderkey + 100 AS l_orderkey, l_suppkey, l_shipdate, l_linenumber FROM lineitem) GROUP BY 1)
SELECT coalesce(o_orderkey, posting) AS posting, CASE WHEN o_orderkey IS NULL THEN source ELSE o_custkey END AS source, coalesce(deadline, o_orderdate) AS deadline,
       CASE WHEN o_orderkey IS NULL THEN false ELSE o_orderstatus = 'F' END AS is_deleted, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at
FROM orders FULL JOIN new ON o_orderkey = posting""")
def upsert_snapshot(spark, sf_dir):
    """K1, K3: a batch whose last row of a key wins sets deadlines and adds postings; deleted ones stay deleted."""
    batch = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 100).alias("posting"), F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("deadline"), F.lit(False).alias("is_deleted"), F.lit(None).cast("timestamp").alias("deleted_at"), F.struct("l_shipdate", "l_linenumber").alias("at"))
    return snapshots.upsert(_snapshot(spark, sf_dir), batch, ["posting"], ["deadline"], [F.col("at")])


@query("SELECT s_suppkey, s_name, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_shipdate >= TIMESTAMP '1999-06-01') AS in_use FROM supplier")
def delete_guard_semi(spark, sf_dir):
    """A source with live children can't be deleted."""
    s, used = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP '1999-06-01'").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("in_use", F.lit(True))
    return s.join(used, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("in_use", F.lit(False)).alias("in_use"))


@query("SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.page_id AND e.event_type = 'purchase')")
def anti_join_seen_links(spark, sf_dir):
    """Pages that no event of a kind has taken in yet."""
    seen = t(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("page_id"))
    return snapshots.without(t(spark, sf_dir, "pages").select("page_id", "url"), seen, ["page_id"])


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def stale_placeholder_delete(spark, sf_dir):
    """K2, U4: texts that aren't in the set of titles."""
    return snapshots.without(t(spark, sf_dir, "documents").select("doc_id", "text"), t(spark, sf_dir, "benchmark"), ["text"]).select("doc_id")


@query("""
WITH cursors AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS last FROM events GROUP BY user_id)
SELECT event_id, e.user_id, ts FROM events e LEFT JOIN cursors c USING (user_id)
WHERE coalesce(CASE WHEN event_type <> 'error' THEN ts END >= last - INTERVAL 48 HOUR, true)""")
def incremental_cutoff(spark, sf_dir):
    """What is new since each source's cursor less 48 hours; undated rows stay."""
    e = t(spark, sf_dir, "events")
    cursors = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last"))
    dated = e.withColumn("published", F.when(F.col("event_type") != "error", F.col("ts")))
    return snapshots.after_cursor(dated, cursors, "user_id", "published", "last").select("event_id", "user_id", "ts")


# --- text and page rules -----------------------------------------------------------------------------------------

WORDS = ("that", "the", "und", "que", "les", "con", "der", "este", "pour", "with")
ONE_OF = " + ".join(f"contains(text, '{w}')::INT" for w in WORDS)
FLAT = r"trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, {ONE_OF} AS n_hits, {ONE_OF} >= 3 OR ({ONE_OF} >= 2 AND length({FLAT}) > 36) AS is_menu FROM documents")
def keyword_hits(spark, sf_dir):
    """Words of a list in each text, and the menu test over them."""
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", hits(F.col("text"), WORDS).alias("n_hits"), rules.is_navigation(F.col("text"), WORDS, "Start").alias("is_menu"))


@query(f"""
SELECT doc_id, CASE WHEN {FLAT} = '' THEN 'empty' WHEN length({FLAT}) < 150 THEN 'short' WHEN {ONE_OF} > 4 THEN 'spam'
       WHEN NOT (contains({FLAT}, 'ing') OR contains({FLAT}, 'ung') OR contains({FLAT}, 'tion')) THEN 'off_topic' END AS reason FROM documents""")
def content_gate_reason(spark, sf_dir):
    """The first reason to turn a text away."""
    return t(spark, sf_dir, "documents").select("doc_id", rules.content_reason(F.col("text"), ("ing", "ung", "tion"), WORDS, 150, 4).alias("reason"))


@query("SELECT doc_id, contains(source, 'src1') OR (contains(text, 'idiot') AND contains(text, 'this')) AS blocked, contains(source || chr(10) || text, 'tion') AS on_track FROM documents")
def red_list_gate(spark, sf_dir):
    """result notices by title or by all markers, and the track's words."""
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", rules.is_result_notice(F.col("source"), F.col("text"), ("src1",), ("idiot", "this")).alias("blocked"), rules.on_track(F.col("source"), F.col("text"), ("tion",)).alias("on_track"))


@query(r"SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1') AND p_size BETWEEN 5 AND 30")
def composite_keyword_filter(spark, sf_dir):
    """a keyword over several fields beside plain filters."""
    p = t(spark, sf_dir, "part")
    return p.filter(F.col("p_size").between(5, 30) & F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("brand#1"))).select("p_partkey", "p_name")


@query("""
WITH s AS (SELECT l_orderkey, count(*) AS n_rows, nullif(sum(CASE WHEN floor(l_quantity) > 10 THEN floor(l_quantity)::BIGINT - 10 END), 0) AS slots,
  arg_min(nullif(CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END, ''), (l_linenumber, l_partkey, l_suppkey, l_returnflag)) FILTER (l_returnflag <> 'N') AS gender FROM lineitem GROUP BY 1)
SELECT l_orderkey AS posting, n_rows, slots::BIGINT AS slots, gender FROM s""")
def requirements_rollup(spark, sf_dir):
    """A1, A2: rows of a posting to one: sum of positive slots, first value that isn't empty."""
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("posting"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", (F.floor("l_quantity") - 10).alias("slots"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("gender"), F.array("l_linestatus").alias("majors"))
    return merging.roll_up(rows, ["posting"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], ["gender"], "slots", "majors").select("posting", "n_rows", "slots", "gender")


@query("""
SELECT o_orderkey AS posting, CASE WHEN sum(l_quantity) FILTER (l_quantity > 40) IS NULL THEN 0 ELSE sum(floor(l_quantity)::BIGINT) FILTER (l_quantity > 40) END::BIGINT AS slots
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O' GROUP BY 1 HAVING slots = 0""")
def incomplete_rows(spark, sf_dir):
    """Postings without a date or slots."""
    o, li = t(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'"), t(spark, sf_dir, "lineitem")
    sums = li.filter("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.floor("l_quantity")).alias("n"))
    found = o.join(sums, "o_orderkey", "left").select(F.col("o_orderkey").alias("posting"), F.coalesce("n", F.lit(0)).cast("long").alias("slots"))
    return found.filter(rules.is_incomplete(F.lit(None), F.lit(None), F.col("slots")))


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_of_dedupe(spark, sf_dir):
    """The first document of each text; texts meet by a digest."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return dedupe.pick_text(d, "text", [F.col("doc_id")]).select("doc_id", "source", "lang")


@query("SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1")
def best_of_dedupe(spark, sf_dir):
    """The best-scored row of each key, the first of equals."""
    return dedupe.pick(t(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [-F.col("n_chars"), F.col("doc_id")])


@query(r"""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS all_words FROM documents)
SELECT doc_id, len(all_words) AS n_distinct FROM w""")
def distinct_ordered_tokens(spark, sf_dir):
    """Distinct words of each text, order kept."""
    return t(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1))).cast("long").alias("n_distinct"))


@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
       lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, len(list_distinct(regexp_extract_all(html, '<a [^>]*href="([^"#]+)"', 1))) AS n_links FROM pages""")
def html_title_and_links(spark, sf_dir):
    """Title, host and distinct links of each page."""
    return t(spark, sf_dir, "pages").select("page_id", F.coalesce(urls.title(F.col("html")), F.lit("")).alias("title"), urls.host(F.col("url")).alias("host"), F.size(urls.links(F.col("html"))).cast("long").alias("n_links"))


NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '(?i)/index\.html?$', ''), '^([a-zA-Z]+://[^/]+/.*)/$', '\1'))"


@query(f"SELECT {NORMAL} AS url_key, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1")
def url_key_join(spark, sf_dir):
    """Pages by their address in normal form."""
    return t(spark, sf_dir, "pages").groupBy(urls.normal(F.col("url")).alias("url_key")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


FAMILIES = [("size", "medium"), ("size", "small"), ("size", "large"), ("offer", "promo"), ("offer", "promo pack"), ("plain", "stand")]


@query(f"SELECT p_partkey, family FROM part JOIN {values(FAMILIES, 'family, term')} ON contains(lower(p_type), term) OR contains(term, lower(p_type)) GROUP BY ALL")
def theta_family_match(spark, sf_dir):
    """Types to families by containment either way; the terms are a fixed small list."""
    p, f = t(spark, sf_dir, "part"), fixture(spark, FAMILIES, "family string, term string")
    kind = F.lower("p_type")
    return p.join(F.broadcast(f), F.contains(kind, F.col("term")) | F.contains(F.col("term"), kind)).select("p_partkey", "family").distinct()


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, value FROM events")
def json_props_typed(spark, sf_dir):
    """A typed field out of JSON."""
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), "value")


@query("""
WITH r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, min(turn) AS first, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS merged FROM r GROUP BY conv_id, run""")
def pending_row_merge(spark, sf_dir):
    """Lines that continue one are joined to it."""
    return sequences.merge_continuations(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "text")


@query("""
WITH r AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT % 50 END AS given, ts FROM events),
runs AS (SELECT *, count(given) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r)
SELECT event_id, user_id, coalesce(first_value(given) OVER w, 0) + row_number() OVER w - CASE WHEN run > 0 THEN 1 ELSE 0 END AS seq
FROM runs WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)""")
def auto_sequence(spark, sf_dir):
    """Numbers that are written restart the count."""
    e = t(spark, sf_dir, "events").withColumn("given", F.when(F.col("event_type") == "purchase", F.floor("value") % 50))
    return sequences.running_number(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("given")).select("event_id", "user_id", "seq")


# --- streams -------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe_available_now(spark, sf_dir):
    """Events that a stream took in once each, by source and type."""
    once = ingest.distinct_within(ingest.read_files(spark, sf_dir, "events"), ["event_id"], "ts")
    return ingest.run_available(once, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# --- more projections and bookkeeping ----------------------------------------------------------------------------


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
m AS (SELECT *, contains(line, '|') AS is_table FROM l WHERE line <> ''),
s AS (SELECT *, bool_or(is_table) OVER (PARTITION BY doc_id ORDER BY line_no) AS after_table FROM m)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_table) AS table_lines, count(*) FILTER (NOT is_table AND after_table) AS later_text FROM s GROUP BY doc_id""")
def line_split_sections(spark, sf_dir):
    """Lines of a text, with whether a table has begun."""
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter("line <> ''")
    marked = lines.withColumn("is_table", F.contains("line", F.lit("|")))
    flagged = marked.withColumn("after_table", F.bool_or("is_table").over(sequences.W.partitionBy("doc_id").orderBy("line_no")))
    return flagged.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("is_table").alias("table_lines"), F.count_if(~F.col("is_table") & F.col("after_table")).alias("later_text"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"#]+)"', 1)) AS link FROM pages)
SELECT link, min(page_id) AS first_page, count(*) AS n FROM l GROUP BY link""")
def union_dedupe_links(spark, sf_dir):
    """Links of all pages, each once with the first page that has it."""
    found = t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"#]+)"'), 1)).alias("link"))
    return found.groupBy("link").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


@query("""
SELECT user_id AS source, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, max(ts) FILTER (event_type <> 'error') AS cursor,
       CASE WHEN count(*) FILTER (event_type <> 'error') = 0 THEN 'error' ELSE 'active' END AS status FROM events GROUP BY user_id""")
def source_cursor_advance(spark, sf_dir):
    """Each source's new cursor, only where something came in."""
    good = F.col("event_type") != "error"
    return t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("n"), F.count_if(~good).alias("failed"), F.max(F.when(good, F.col("ts"))).alias("cursor"), F.when(F.count_if(good) == 0, "error").otherwise("active").alias("status"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN left(text, 160) || '…' ELSE text END AS preview FROM documents")
def text_previews(spark, sf_dir):
    """The first 160 characters, with an ellipsis where there are more."""
    return t(spark, sf_dir, "documents").select("doc_id", preview(F.col("text"), 160).alias("preview"))


@query(f"""
SELECT o_orderkey AS posting, CASE WHEN d < 0 THEN 'closed' WHEN d = 0 THEN 'closes today' ELSE d::VARCHAR || ' days left' END AS label
FROM (SELECT o_orderkey, ceil(date_diff('second', TIMESTAMP '{NOW}', o_orderdate) / 86400.0)::INT AS d FROM orders)""")
def days_left_label(spark, sf_dir):
    """Days to the deadline in words."""
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("posting"), dates.days_label(F.col("o_orderdate").cast("timestamp"), now()).alias("label"))


@query("""
SELECT c_custkey AS source, count(o_orderkey) AS postings, count(*) FILTER (o_orderstatus = 'O') AS live, coalesce(bool_or(o_orderstatus = 'O'), false) AS has_live
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def postings_per_source(spark, sf_dir):
    """Postings of each source, those without any too."""
    o = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("postings"), F.count_if(F.col("o_orderstatus") == "O").alias("live"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t(spark, sf_dir, "customer").join(o, "c_custkey", "left").select(F.col("c_custkey").alias("source"), zero("postings"), zero("live"), (F.coalesce("live", F.lit(0)) > 0).alias("has_live"))


def _stripped(html: str) -> str:
    for tag in ("script", "style", "noscript", "iframe", "nav", "footer", "header"):
        html = f"regexp_replace({html}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    html = f"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        html = f"replace({html}, '{name}', '{mark}')"
    return rf"trim(regexp_replace({html}, '[\x09-\x0D\x20]+', ' ', 'g'), ' ')"


@query(f"SELECT page_id, {_stripped('html')} AS body, length(body) >= 80 AS is_long FROM pages")
def html_page_text(spark, sf_dir):
    """X53, X54 without selectors: the text of each page, and whether it's long enough to keep."""
    body = urls.page_text(F.col("html"))
    return t(spark, sf_dir, "pages").select("page_id", body.alias("body"), (F.length(body) >= 80).alias("is_long"))


@query("""
WITH r AS (SELECT user_id, event_type = 'error' AS failed, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT user_id, run, count(*) FILTER (failed) AS streak FROM r GROUP BY ALL)
SELECT user_id AS source, max(streak) AS longest, max(streak) >= 3 AS tripped FROM s GROUP BY 1""")
def breaker_state(spark, sf_dir):
    """T4 in a batch: the longest run of failures of each source; three trip its breaker, a success resets the count."""
    at = sequences.W.partitionBy("user_id").orderBy("ts", "event_id")
    runs = t(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") != "error").over(at).alias("run"))
    streaks = runs.groupBy("user_id", "run").agg(F.count_if("failed").alias("streak"))
    return streaks.groupBy(F.col("user_id").alias("source")).agg(F.max("streak").alias("longest"), (F.max("streak") >= 3).alias("tripped"))


@query("""
SELECT o_orderkey AS posting, to_json({'success': true, 'data': {'title': o_orderpriority, 'status': o_orderstatus}}) AS envelope FROM orders WHERE o_orderstatus = 'P'""")
def json_envelopes(spark, sf_dir):
    """Rows as the response's JSON."""
    data = F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"))
    return t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("posting"), F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data"))).alias("envelope"))

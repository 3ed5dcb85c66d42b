"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, host_rules, minhash, mixing, pii, quality, simhash, spelling, token_blocks, token_counts, toxicity, url_filter, vector_codes
from .common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, width=3, radius=2, blocks=4).select("doc_id", "fingerprint", "component_id")


def op3_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sizes(docs, weights=(3, 1, 2), share=1.5).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
stats AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2 * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM stats
  WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap / weight > level
              THEN weight * (SELECT arg_min(level, cap / weight) FROM levels WHERE cap / weight > level)
              ELSE cap::DOUBLE END AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs
  FROM targets),
units AS (
  SELECT source, key, doc_id, size, count(*) AS copies FROM sized GROUP BY ALL),
reached AS (
  SELECT u.*, b.source_size, b.target, b.epochs, floor(b.target + 0.5)::BIGINT - b.epochs * b.source_size AS rest,
         coalesce(sum(u.size * u.copies) OVER (PARTITION BY u.source ORDER BY u.key, u.doc_id, u.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM units u JOIN budgets b ON u.source IS NOT DISTINCT FROM b.source)
SELECT s.doc_id, s.size, r.source_size, r.target,
       (r.epochs * s.size + greatest(0, least(r.size, (r.rest - r.before) // r.copies)))::BIGINT AS taken
FROM sized s JOIN reached r ON s.source IS NOT DISTINCT FROM r.source AND s.key = r.key
 AND s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.size = r.size
"""


URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP4_SQL = r"""
WITH RECURSIVE rules(rule, action, rule_host, rule_path) AS (VALUES
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
  ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
seen AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*[^?#]*(\??[^#]*)', 1) AS query
  FROM pages),
tags AS (
  SELECT host, path, query, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM seen WHERE host <> ''),
found AS (
  SELECT *, replace(CASE
      WHEN regexp_matches(tag, '(?i)^<link\s') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
      WHEN regexp_matches(tag, '(?i)^<meta\s') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
      ELSE '' END, '&amp;', '&') AS address
  FROM tags),
resolved AS (
  SELECT host || CASE WHEN path = '' THEN '/' ELSE path END || query AS u, CASE
      WHEN regexp_matches(address, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN address
      WHEN address LIKE '//%' THEN 'http:' || address
      WHEN address LIKE '/%' THEN 'http://' || host || address
      WHEN address LIKE '?%' THEN 'http://' || host || path || address
      WHEN address LIKE '#%' THEN 'http://' || host || path || query
      ELSE 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || address END AS url
  FROM found WHERE address <> ''),
targets AS (
  SELECT u, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^(?s:.*?)://[^/?#]*[^?#]*(\??[^#]*)', 1) AS query
  FROM resolved),
edges AS (
  SELECT u, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS v FROM targets WHERE host <> ''),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(a, b) AS (
  SELECT u, v FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
places AS (
  SELECT host, path FROM seen UNION
  SELECT regexp_extract(b, '^([^/?#]*)', 1), regexp_extract(b, '^[^/?#]*([^?#]*)', 1) FROM reach),
judged AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path),
shared AS (
  SELECT a, CASE WHEN bool_or(action = 'allow') THEN 'allow' ELSE 'block' END AS action
  FROM reach JOIN judged ON host = regexp_extract(b, '^([^/?#]*)', 1) AND path = regexp_extract(b, '^[^/?#]*([^?#]*)', 1)
  GROUP BY a)
SELECT page_id, s.host, s.path, j.rule, coalesce(j.action, h.action, 'allow') AS verdict
FROM seen s LEFT JOIN judged j ON s.host = j.host AND s.path = j.path
LEFT JOIN shared h ON h.a = s.host || CASE WHEN s.path = '' THEN '/' ELSE s.path END || s.query
"""


def op5_token_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_blocks.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return written.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return host_rules.judge(docs, beyond=3.0, times=2.0).select(*columns)


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
repeated AS (
  SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) AS near(k) GROUP BY r),
lines AS (
  SELECT r, sum(n - 1)::BIGINT AS n
  FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
measured AS (
  SELECT d.doc_id, d.source, len(w.w)::BIGINT AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM docs d JOIN words w USING (r) LEFT JOIN lines l USING (r) LEFT JOIN repeated p USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
failed AS (
  SELECT source, unnest(['few', 'repeats', 'symbols', 'lines']) AS rule,
         unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > n_words]) AS failed FROM judged),
hosts AS (
  SELECT source, rule, count(*) AS n, sum(failed::BIGINT) AS failures FROM failed GROUP BY source, rule),
bins AS (
  SELECT rule, (failures * 10000) // n AS bin, count(*) AS c FROM hosts GROUP BY ALL),
medians AS (
  SELECT rule, min(bin) FILTER (2 * upto >= whole) AS median
  FROM (SELECT *, sum(c) OVER (PARTITION BY rule ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY rule) AS whole FROM bins) GROUP BY rule),
gaps AS (
  SELECT rule, median, abs(bin - median) AS gap, sum(c) AS c FROM bins JOIN medians USING (rule) GROUP BY ALL),
spreads AS (
  SELECT rule, any_value(median) AS median, min(gap) FILTER (2 * upto >= whole) AS apart
  FROM (SELECT *, sum(c) OVER (PARTITION BY rule ORDER BY gap) AS upto, sum(c) OVER (PARTITION BY rule) AS whole FROM gaps) GROUP BY rule),
prior AS (
  SELECT rule, m, CASE WHEN s > 0 THEN least(greatest(m * (1 - m) / (s * s) - 1, 1.0::DOUBLE), 100.0::DOUBLE) ELSE 100.0::DOUBLE END AS strength
  FROM (SELECT rule, greatest(median / 10000, 0.01::DOUBLE) AS m, 1.4826::DOUBLE * apart / 10000 AS s FROM spreads)),
posteriors AS (
  SELECT source, n, m, strength, (failures + m * strength) / (n + strength) AS rate FROM hosts JOIN prior USING (rule)),
sure AS (
  SELECT *, rate - 2 * sqrt(rate * (1 - rate) / (n + strength + 1)) AS least FROM posteriors),
rates AS (
  SELECT source, bool_or(least > m + 3 * sqrt(m * (1 - m) / (strength + 1)) AND least > 2 * m) AS bad FROM sure GROUP BY source)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept
FROM judged j JOIN rates h ON j.source IS NOT DISTINCT FROM h.source
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def _op11_sql(rounds: int = 4) -> str:
    """Lloyd's rounds spelled out, one codebook after the other."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (
  SELECT p.r, p.part, min(p.xx - 2 * list_dot_product(p.x, b.c) + list_dot_product(b.c, b.c))::BIGINT AS error,
         arg_min(b.entry, (p.xx - 2 * list_dot_product(p.x, b.c) + list_dot_product(b.c, b.c)) * 256 + b.entry) AS entry
  FROM cut p JOIN book{i} b USING (part) GROUP BY p.r, p.part),""")
        if i < rounds:
            steps.append(f"""
sums{i} AS (
  SELECT part, entry, place, sum(v) AS s, count(*) AS n
  FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM cut JOIN near{i} USING (r, part))
  GROUP BY ALL),
book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY place) AS c FROM sums{i} GROUP BY part, entry) m USING (part, entry)),""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c
  FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = len(embedding)),
cut AS MATERIALIZED (
  SELECT r, part, x, list_dot_product(x, x) AS xx FROM (
    SELECT r, part, c[part * (len(c) // 4) + 1 : (part + 1) * (len(c) // 4)] AS x FROM kept, range(4) AS parts(part))),
book0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, x AS c FROM cut WHERE r <= 256),{"".join(steps)}
coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM near{rounds} GROUP BY r),
digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS sha FROM book{rounds})
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, d.sha AS codebooks_sha256
FROM kept k JOIN coded c USING (r), digest d
"""


OP11_SQL = _op11_sql()


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i : i + 2], ' ') AS shingle FROM (
    SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (
  SELECT w.r, w.doc_id, count(s.r) AS n FROM words w LEFT JOIN shingles s USING (r) GROUP BY w.r, w.doc_id),
pairs AS MATERIALIZED (
  SELECT a.r AS u, b.r AS v FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.r <> b.r
  JOIN sizes x ON x.r = a.r JOIN sizes y ON y.r = b.r
  GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(u, v) AS (
  SELECT u, v FROM pairs UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u),
least AS (
  SELECT u, min(s.doc_id) AS component_id FROM reach JOIN sizes s ON s.r = v GROUP BY u)
SELECT doc_id, n::BIGINT AS n_shingles, least(doc_id, coalesce(component_id, doc_id)) AS component_id, least(doc_id, coalesce(component_id, doc_id)) = doc_id AS kept
FROM sizes LEFT JOIN least ON u = r
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least_length=7, least_count=2, every=31, times=10)


# crc32 by half bytes; near words by what is left of them without one code point.
OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
coded AS (
  SELECT run, times, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x,
         [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS t
  FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(len(x)),
           lambda i: ('0x' || substr(x, ((i // 2) * 2 + 2 - i % 2)::BIGINT, 1))::UBIGINT)), lambda crc, d: xor(crc >> 4, t[((xor(crc, d) & 15) + 1)::BIGINT]::UBIGINT)), 4294967295::UBIGINT)::BIGINT AS h
  FROM coded),
words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 : ] ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
without AS MATERIALIZED (
  SELECT word, n, i, word[1 : i] || word[i + 2 : ] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
placed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk(word, root) AS (
  SELECT word, form FROM placed WHERE form IS NOT NULL
  UNION ALL SELECT w.word, p.form FROM walk w JOIN placed p ON p.word = w.root WHERE p.form IS NOT NULL),
ends AS (
  SELECT w.word, w.root FROM walk w JOIN placed p ON p.word = w.root WHERE p.form IS NULL)
SELECT p.word, p.form, coalesce(e.root, p.word) AS root, p.n, p.n_near, p.form_n FROM placed p LEFT JOIN ends e USING (word)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_mixing_to_target_weights": op3_mixing_to_target_weights,
    "op4_url_filter": op4_url_filter,
    "op5_token_id_blocks": op5_token_id_blocks,
    "op6_toxicity": op6_toxicity,
    "op7_host_quality_rules": op7_host_quality_rules,
    "op8_pii": op8_pii,
    "op9_bradley_terry_quality": op9_bradley_terry_quality,
    "op10_prefix_token_counts": op10_prefix_token_counts,
    "op11_vector_code_compression": op11_vector_code_compression,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op3_mixing_to_target_weights": OP3_SQL,
    "op4_url_filter": OP4_SQL,
    "op7_host_quality_rules": OP7_SQL,
    "op11_vector_code_compression": OP11_SQL,
    "op12_minhash_near_dedup": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}

"""URL filtering: allow and block rules, and verdicts that spread over redirects and canonical links.

A rule names a host, which stands for its subdomains too, and the start of a path; the longest that fits decides.
Pages that no rule fits may be aliases of others: a canonical link or an immediate refresh makes two URLs
equivalent, and connected components of these edges share their verdicts. A page's own rule comes first. Without
one, a component with an allowed URL is allowed, else one with a blocked URL is blocked, else `default` holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_join, spread_join
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def url_parts(url: Column) -> Column:
    """struct<host, path, query>: A-Z of the host lower-cased; all empty for null and where there is no ://."""
    u = F.coalesce(url, F.lit(""))
    return F.struct(F.translate(F.regexp_extract(u, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(u, PARTS, 2).alias("path"), F.regexp_extract(u, PARTS, 3).alias("query"))


def node(parts: Column) -> Column:
    """What tells a URL from others: host, path and query, without scheme and fragment; null without a host."""
    return F.when(parts["host"] != "", F.concat(parts["host"], F.when(parts["path"] == "", "/").otherwise(parts["path"]), parts["query"]))


def targets(html: Column) -> Column:
    """array<string>: addresses of the canonical links and refreshes of a page, as written."""
    page = F.coalesce(html, F.lit(""))
    links = F.filter(F.regexp_extract_all(page, F.lit(r"(?i)(<link\s[^>]*>)"), 1), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"))
    metas = F.filter(F.regexp_extract_all(page, F.lit(r"(?i)(<meta\s[^>]*>)"), 1), lambda t: t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    found = F.concat(F.transform(links, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)), F.transform(metas, lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)))
    return F.transform(F.filter(found, lambda a: a != ""), lambda a: F.replace(a, F.lit("&amp;"), F.lit("&")))


def resolve(address: Column, base: Column) -> Column:
    """The address as an absolute URL, as seen from a page with the parts `base`; dot segments stay as they are."""
    top = F.concat(F.lit("http://"), base["host"])
    return (
        F.when(address.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), address)
        .when(address.startswith("//"), F.concat(F.lit("http:"), address))
        .when(address.startswith("/"), F.concat(top, address))
        .when(address.startswith("?"), F.concat(top, base["path"], address))
        .when(address.startswith("#"), F.concat(top, base["path"], base["query"]))
        .otherwise(F.concat(top, F.regexp_replace(F.when(base["path"] == "", "/").otherwise(base["path"]), r"[^/]*\z", ""), address))
    )


def rule_verdicts(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, action for the (host, path) of places that a rule fits; rules: (rule, action).

    A host is joined by each of its endings, so rules are looked up and never tried one after another.
    """
    by_host = rules.select("rule", "action", F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = places.filter("host <> ''").select("host", "path", F.explode(endings).alias("rule_host"))
    fits = sized_join(spread, by_host, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
    return best.select("host", "path", "best.rule", "best.action")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html).

    rules: (action, "host/path") with action allow or block. A null url, and one without ://, has an empty host and
    path and fits no rule; it takes part in no component. An address without a path is the same as with / when it's an
    alias, though no rule fits the page's own empty path. Null html has no links. Repeated rows stay repeated. An
    empty table gives an empty result. Other columns of pages are not read.
    """
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r, a) for a, r in rules], "rule string, action string")
    seen = pages.select("page_id", url_parts(F.col("url")).alias("parts"), targets(F.col("html")).alias("targets")).withColumn("node", node(F.col("parts")))
    # A host has no slash and a path begins with one, so these tell places and addresses apart.
    seen = materialize(seen.withColumn("place", F.concat("parts.host", "parts.path")).withColumn("address", F.concat("place", "parts.query")), "pages")
    links = seen.filter("node is not null").select("parts", "node", F.explode("targets").alias("target")).select("node", url_parts(resolve(F.col("target"), F.col("parts"))).alias("to"))
    members = connected_components(links.select(F.col("node").alias("u"), node(F.col("to")).alias("v")).filter("v is not null"))
    own = url_parts(F.concat(F.lit("http://"), F.col("node")))
    members = materialize(members.withColumn("parts", own).withColumn("place", F.concat("parts.host", "parts.path")), "members")

    addresses = materialize(seen.groupBy("address", "place", "node", "parts.host", "parts.path").agg(F.count("*").alias("rows")), "addresses")
    both = addresses.select("place", "host", "path").union(members.select("place", "parts.host", "parts.path"))
    places = materialize(both.groupBy("place", "host", "path").agg(F.count("*").alias("n")), "places")
    judged = materialize(places.join(rule_verdicts(places, listed).hint("merge"), ["host", "path"], "left").select("place", "rule", "action", "n"), "judged")

    voted = materialize(spread_join(members.select("node", "component", "place"), judged, "place").select("node", "component", "action"), "voted")
    allowed, blocked = (F.max(F.coalesce(F.col("action") == a, F.lit(False))) for a in ("allow", "block"))
    shared = materialize(voted.groupBy("component").agg(F.when(allowed, "allow").when(blocked, "block").alias("shared"), F.count("*").alias("n")), "shared")
    aliases = spread_join(voted.select("node", "component"), shared, "component").select("node", "shared")

    ruled = spread_join(addresses, judged, "place").join(aliases.hint("merge"), "node", "left")
    verdicts = ruled.select("address", "host", "path", "rule", F.coalesce("action", "shared", F.lit(default)).alias("verdict"), F.col("rows").alias("n"))
    return spread_join(seen.select("page_id", "address"), materialize(verdicts, "verdicts"), "address").select("page_id", "host", "path", "rule", "verdict")

"""Discovery of sources: a bounded walk over links from seed pages, and the best link to each list of notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import institutions, urls
from ..sources.shared import written


def walk(links: DataFrame, seeds: DataFrame, follow: Column, most_depth: int = 2) -> DataFrame:
    """url and depth of each page within `most_depth` links of a seed, at its least depth.

    links: page, url and title; seeds: url. Of links only those that fit `follow` are walked. Each step joins the pages found in the
    step before with their links and leaves out what has been visited; it is written to the shared folder, so that a lost
    machine costs one step. Null addresses are no pages; cycles and repeated links add nothing.
    """
    steps = [written(seeds.filter("url is not null").select("url").distinct().withColumn("depth", F.lit(0)), "pages")]
    # A link that stands on a page several times is judged once, and all are before the first step.
    walked = written(links.filter(F.col("url").isNotNull()).select("page", "url", "title").distinct().filter(follow).select("page", "url").distinct(), "walked")
    for depth in range(1, most_depth + 1):
        visited = reduce(lambda a, b: a.union(b), steps).select("url")
        found = walked.join(steps[-1].select(F.col("url").alias("page")), "page", "left_semi").select("url").distinct()
        new = written(found.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)), "pages")
        if new.isEmpty():
            break
        steps.append(new)
    return reduce(lambda a, b: a.union(b), steps)


def candidates(links: DataFrame, visited: DataFrame, accepted: Column, least: int = 4, inferred: int = 7) -> DataFrame:
    """key, url, title, score, depth, name and kind: for each address in normal form its best link on a visited page.

    A link that stands on several pages is scored once, at its least depth. Links count if they are accepted and score `least`. A title that names a known institution adds that one's list page with the
    score `inferred`. Of equal scores the less deep one is taken, then the least address and title.
    """
    on = links.select("page", "url", "title").distinct().join(visited.select(F.col("url").alias("page"), "depth"), "page")
    on = written(on.groupBy("url", "title").agg(F.min("depth").alias("depth")), "found")
    scored = on.withColumn("score", urls.score(F.col("url"), F.col("title"))).filter((F.col("score") >= least) & accepted)
    own = scored.select("url", "title", "score", "depth", institutions.name_of(F.col("title"), F.col("url")).alias("name"))
    hit = on.filter(F.col("title").rlike("招聘|引才|人才")).select("title", "depth", institutions.known(F.col("title")).alias("k")).filter("k is not null")
    guessed = hit.select(F.col("k.url").alias("url"), "title", F.lit(inferred).alias("score"), "depth", F.col("k.name").alias("name"))
    every = own.union(guessed).withColumn("key", urls.normal(F.col("url")))
    best = every.groupBy("key").agg(F.min_by(F.struct("url", "title", "score", "depth", "name"), F.struct(-F.col("score"), "depth", "url", "title")).alias("b")).select("key", "b.*")
    return best.withColumn("kind", institutions.kind_of(F.col("name"), F.col("url")))

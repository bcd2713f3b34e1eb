"""Breadth-first reachability over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def hit_edges(results: DataFrame) -> DataFrame:
    """(src, dst): each search hit links to the next hit of the same question."""
    a = results.select("question_id", "hit_rank", F.col("content_id").alias("src"))
    b = results.select("question_id", (F.col("hit_rank") - 1).alias("hit_rank"), F.col("content_id").alias("dst"))
    return a.join(b, ["question_id", "hit_rank"]).select("src", "dst").distinct()


def link_edges(pages: DataFrame, url: str, links: str) -> DataFrame:
    """(src, dst) from a column of arrays of absolute links; repeats and self links dropped."""
    return pages.select(F.col(url).alias("src"), F.explode(links).alias("dst")).filter("src <> dst").distinct()


def within_steps(edges: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """(node, step INT): nodes reachable from ``start`` (column node) in at most ``steps`` steps, with their least step.

    One join and one anti-join a round. The frontier is written out each round, so the plan stays short and a lost
    executor repeats one round; the visited set is distributed.
    """
    edges = cut(edges)
    seen = start.filter("node is not null").distinct().withColumn("step", F.lit(0))
    frontier = seen
    for step in range(1, steps + 1):
        reached = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).filter("node is not null").distinct()
        frontier = cut(reached.join(seen, "node", "left_anti").withColumn("step", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def crawled(links: DataFrame, start: str, most: int = 400, depth: int = 5, multiple: int = 5) -> DataFrame:
    """(url, step INT, place INT): the first ``most`` addresses of a breadth-first crawl from ``start``, by place from 0.

    ``links`` holds (src, pos, dst); its addresses are those that may be collected (pages of the start's host). Pages are
    read in the order in which they were first seen, links in the order on their page; links of pages ``depth`` steps away
    are not followed, and at most ``most * multiple`` addresses wait to be read. A round sorts at most that many rows.
    """
    limit = most * multiple
    links = cut(links.filter(F.col("dst").isNotNull()))
    first = links.sparkSession.createDataFrame([(start, 0, 0)], "url string, step int, place int")
    seen = frontier = first
    total = 1
    for step in range(1, depth + 2):
        if total >= most:
            break
        reached = frontier.join(links, frontier["url"] == links["src"]).groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("place", "pos")).alias("by"))
        fresh = reached.join(seen, "url", "left_anti").orderBy("by", "url").limit(limit - min(total, limit - 1))
        ranked = fresh.withColumn("place", F.row_number().over(Window.orderBy("by", "url")) + F.lit(total - 1))  # at most ``limit`` rows
        frontier = cut(ranked.select("url", F.lit(step).alias("step"), F.col("place").cast("int").alias("place")))
        n = frontier.count()
        if not n:
            break
        total += n
        seen = seen.unionByName(frontier)
    return seen.orderBy("place").limit(most)

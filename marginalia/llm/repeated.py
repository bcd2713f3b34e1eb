"""Blocks of lines repeated over one source's documents, read off suffix arrays.

A line's identifier is a hash of its letters in lower case. The documents of a source are dealt to shards of about
``SHARD_ROWS`` rows, so no source is gathered into one task. In every shard the identifiers of its documents, laid end to
end, get a suffix array; the intervals of its longest common prefixes that cannot be extended to either side without
losing an occurrence are the repeated blocks (single lines included), and those on the asked share of the shard's
documents are candidates. A line that stands on a share of a source's rows stands on that share of the rows of some shard,
and there a maximal block holds it, so no line is lost. Candidate blocks, and the lines they hold, are then counted
exactly over all rows; lines that reach the count are removed.

Edge cases: null text has no lines but its row counts for the source; lines without letters have no identifier and end
blocks; a null source_url and url give the source ``''``; each of repeated rows counts; a line repeated within a row
counts once and is reported at each place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

#: Rows of a source in one shard, about.
SHARD_ROWS = 4_000
#: Candidates up to this number of rows (16 bytes and a host name each) are broadcast.
BROADCAST_ROWS = 100_000


def source_of(source_url, url):
    """Host of ``source_url`` (of ``url`` where null), lower case, without leading ``www.`` and port."""
    host = F.lower(F.regexp_extract(F.coalesce(source_url, url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def line_ids(text):
    """Array with one identifier per line; null for lines without letters."""
    def one(line):
        key = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
        return F.when(key != "", F.xxhash64(key))

    return F.transform(F.split(text, "\n", -1), one)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, longest common prefixes with the previous suffix) of an integer sequence, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while step < n and rank.max(initial=0) < n - 1:
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        pair = rank * (n + 1) + second + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(n - 1 if n else 0, bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        # equal ranks at level k mean 2**k equal identifiers, separators being unique
        lcp[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, lcp


def repeated_blocks(ids: np.ndarray, docs: np.ndarray, least: int) -> list[tuple[np.ndarray, int]]:
    """(block, number of documents) of the maximal repeated blocks that stand on at least ``least`` documents.

    ``ids`` holds the documents end to end, each closed by an identifier that occurs once; ``docs`` names each position's
    document. A block is maximal if no line before or after it is shared by all its occurrences. With ``least`` 1 blocks
    that occur once are left out: each is its whole document.
    """
    out: list[tuple[np.ndarray, int]] = []
    if len(ids) < 2:
        return out
    order, lcp = suffix_array(ids)
    at = docs[order]
    before = np.where(order > 0, ids[np.maximum(order - 1, 0)], np.iinfo(np.int64).min)
    turns = np.cumsum(np.r_[0, (before[1:] != before[:-1]) | (order[1:] == 0)])  # equal at both ends: one line before all
    stack: list[tuple[int, int]] = []
    bounds = lcp.tolist()
    for i in range(1, len(order) + 1):
        here = bounds[i] if i < len(order) else 0
        start = i - 1
        while stack and stack[-1][0] > here:
            size, start = stack.pop()
            if i - start >= least and turns[i - 1] > turns[start] and (n := len(np.unique(at[start:i]))) >= least:
                p = int(order[start])
                out.append((ids[p : p + size], n))
        if here and (not stack or stack[-1][0] < here):
            stack.append((here, start))
    return out


def _laid_out(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers of the documents of a shard end to end, document of each position); blanks and ends are unique."""
    column = table.column("ids").combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.fill_null(0).to_numpy(zero_copy_only=False)
    valid = np.asarray(column.is_valid())
    lens = np.where(valid, offsets[1:] - offsets[:-1], 0)
    ids = np.zeros(int(lens.sum()) + len(lens), np.int64)
    docs = np.repeat(np.arange(len(lens)), lens + 1)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(lens + 1) - 1] = False
    ids[inside] = values[np.repeat(offsets[:-1][valid], lens[valid]) + np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens[valid]) - lens[valid], lens[valid])]
    blank = np.flatnonzero(ids == 0)
    # the least values are taken for blanks and ends; a hash this small is as likely as a collision
    ids[blank] = np.iinfo(np.int64).min + 1 + np.arange(len(blank))
    return ids, docs


def candidate_blocks(shards: DataFrame, least_rows: int, share: float) -> DataFrame:
    """(source, block ARRAY<BIGINT>) of maximal blocks on at least ``share`` of the rows of some shard of the source."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, docs = _laid_out(table)
        local = max(1, int(np.ceil(share * table.num_rows - 1e-9)))
        if table.column("shards")[0].as_py() == 1:
            local = max(local, least_rows)
        first_real = np.iinfo(np.int64).min + 1 + int((ids < np.iinfo(np.int64).min + 1 + len(ids)).sum())
        blocks = [b for b, _ in repeated_blocks(ids, docs, local)]
        blocks = [b[b >= first_real] for b in blocks]
        blocks = [b for b in blocks if len(b)]
        return pa.table({"source": pa.array([key[0].as_py()] * len(blocks), pa.string()), "block": pa.array(blocks, pa.list_(pa.int64()))})

    return shards.groupBy("source", "shard").applyInArrow(run, "source string, block array<bigint>").distinct()


def count_blocks(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, block, rows): in how many rows each block stands, exactly, shard by shard."""

    def run(key: tuple, lines: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, docs = _laid_out(lines)
        order = np.argsort(ids, kind="stable")
        names = ids[order]
        counts = []
        blocks = [np.array(b, np.int64) for b in wanted.column("block").to_pylist()]
        for b in blocks:
            at = order[np.searchsorted(names, b[0], "left") : np.searchsorted(names, b[0], "right")]
            at = at[at + len(b) <= len(ids)]
            for k in range(1, len(b)):
                at = at[ids[at + k] == b[k]]
            counts.append(len(np.unique(docs[at])))
        return pa.table({"source": pa.array([key[0].as_py()] * len(blocks), pa.string()), "block": pa.array(blocks, pa.list_(pa.int64())), "n": pa.array(counts, pa.int64())})

    places = shards.select(F.col("source").alias("s"), F.col("shard").alias("part")).distinct()
    everywhere = blocks.toDF("s", "block").join(places, "s")
    counted = shards.groupBy("source", "shard").cogroup(everywhere.groupBy("s", "part")).applyInArrow(run, "source string, block array<bigint>, n bigint")
    return counted.groupBy("source", "block").agg(F.sum("n").alias("rows"))


def sharded_lines(pages: DataFrame, least_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((page_id, source, ids), those of sources with enough rows with their shard, (source, source_rows))."""
    lines = cut(pages.select("page_id", source_of(F.col("source_url"), F.col("url")).alias("source"), line_ids(F.col("relevant_content")).alias("ids")))
    sizes = broadcast_if_small(lines.groupBy("source").agg(F.count("*").alias("source_rows")).filter(F.col("source_rows") >= least_rows), BROADCAST_ROWS)
    n = F.ceil(F.col("source_rows") / SHARD_ROWS).cast("int")
    shards = lines.join(sizes, "source").select("source", n.alias("shards"), F.pmod(F.xxhash64("page_id", F.size("ids")), n).cast("int").alias("shard"), "ids")
    return lines, shards, sizes


def repeated_lines(pages: DataFrame, least_rows: int = 8, share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """((page_id, source, line_no INT, id) of lines to remove, (source, id, rows) of the repeated lines)."""
    lines, shards, sizes = sharded_lines(pages, least_rows)
    blocks = candidate_blocks(shards, least_rows, share)
    wanted = broadcast_if_small(blocks.select("source", F.explode("block").alias("id")).distinct(), BROADCAST_ROWS)
    counts = lines.select("source", F.explode(F.array_distinct("ids")).alias("id")).join(wanted, ["source", "id"]).groupBy("source", "id").agg(F.count("*").alias("rows"))
    often = counts.join(sizes, "source").filter((F.col("rows") >= least_rows) & (F.col("rows") >= share * F.col("source_rows"))).select("source", "id", "rows")
    often = broadcast_if_small(often, BROADCAST_ROWS)
    found = lines.select("page_id", "source", F.posexplode("ids").alias("pos", "id")).filter(F.col("id").isNotNull()).join(often.drop("rows"), ["source", "id"])
    return found.select("page_id", "source", (F.col("pos") + 1).alias("line_no"), "id"), often


def multi_line_blocks(pages: DataFrame, least_rows: int = 8, share: float = 0.05) -> DataFrame:
    """(source, block ARRAY<BIGINT>, rows) of blocks of several lines on at least so many rows of their source."""
    _, shards, sizes = sharded_lines(pages, least_rows)
    shards = cut(shards)
    blocks = cut(candidate_blocks(shards, least_rows, share).filter(F.size("block") > 1))
    return count_blocks(shards, blocks).join(sizes, "source").filter((F.col("rows") >= least_rows) & (F.col("rows") >= share * F.col("source_rows"))).select("source", "block", "rows")


def without_repeated_lines(pages: DataFrame, least_rows: int = 8, share: float = 0.05, out: str = "clean_content") -> DataFrame:
    """(page_id, ``out``): each text without the lines repeated in its source; null stays null."""
    found, _ = repeated_lines(pages, least_rows, share)
    drop = found.groupBy("page_id").agg(F.collect_set("line_no").alias("__drop"))
    kept = F.filter(F.split("relevant_content", "\n", -1), lambda _, i: ~F.coalesce(F.array_contains(F.col("__drop"), i + 1), F.lit(False)))
    return pages.select("page_id", "relevant_content").join(drop, "page_id", "left").select("page_id", F.when(F.col("relevant_content").isNotNull(), F.array_join(kept, "\n")).alias(out))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Lines whose like stands on at least 8 rows and 5 % of the rows of the page's source."""
    return repeated_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"))[0].select("page_id", "line_no").distinct()


def p4_clean(spark, sf_dir: str) -> DataFrame:
    """What is left of every page: number of lines and a hash of the text."""
    clean = without_repeated_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return clean.select("page_id", F.length("clean_content").cast("bigint").alias("n_chars"), F.md5("clean_content").alias("text_md5"))


def p4_blocks(spark, sf_dir: str) -> DataFrame:
    """Repeated blocks of several lines: their source, length and rows."""
    found = multi_line_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("source", F.hash("block").alias("block"), F.size("block").alias("n_lines"), "rows")


#: The same by plain counting.
P4_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(source_url, url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS source, relevant_content
  FROM pages),
l AS (
  SELECT page_id, source, unnest(string_split(relevant_content, chr(10))) AS line, generate_subscripts(string_split(relevant_content, chr(10)), 1) AS line_no FROM p),
k AS (SELECT page_id, source, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM l),
n AS (SELECT source, count(*) AS source_rows FROM p GROUP BY source),
f AS (
  SELECT k.source, k.key FROM k JOIN n USING (source) WHERE k.key <> '' GROUP BY k.source, k.key, n.source_rows
  HAVING count(DISTINCT page_id) >= 8 AND count(DISTINCT page_id) >= 0.05 * n.source_rows)
SELECT DISTINCT page_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (source, key)
"""
#: Pages without these lines, by plain counting.
P4_CLEAN_SQL = f"""
WITH gone AS ({P4_SQL}), g AS (SELECT page_id, list(line_no) AS drop_ FROM gone GROUP BY page_id),
t AS (SELECT p.page_id, CASE WHEN drop_ IS NULL THEN relevant_content ELSE array_to_string(list_filter(string_split(relevant_content, chr(10)), lambda x, i: NOT list_contains(drop_, CAST(i AS INTEGER))), chr(10)) END AS c FROM pages p LEFT JOIN g USING (page_id))
SELECT page_id, length(c) AS n_chars, md5(c) AS text_md5 FROM t
"""

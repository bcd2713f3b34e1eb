"""Splitting oversized texts at natural boundaries by packing a structure tree.

A text is parsed into a tree: sections nested by the level of their headings (markup, numbering, or short lines), blocks
(a paragraph, a table, a list whose deeper entries hang below their entry), lines, sentences. From the bottom up,
neighbouring siblings are merged as long as they fit; only a node that is too large is opened, and parts of different
parents never share a piece. A heading stays with what follows it. Every piece after the first repeats the last words of
the one before.

Edge cases: null and blank texts have no pieces, a text within the limit is one piece; a sentence longer than the limit
is cut between words; words are runs of characters other than space and line feed, of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boilerplate import slices

_WORD = re.compile(r"[^ \n]+")
_ENTRY = re.compile(r"(\s*)(?:[•*›»–-]\s|\d{1,3}[.)]\s|<li\b)")
_ROW = re.compile(r"\s*<tr\b|.*(?: \| | / | · ).*(?: \| | / | · )|\s*\|.*\|")
_MARKED = re.compile(r"\s*(?:(#{1,6})\s+\S|<h([1-6])\b)", re.I)
_NUMBERED = re.compile(r"\s*(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+\S")
_END = (".", "!", "?", "؟", ";", "…")
#: Words of an unmarked heading at most, and its level (below those of markup and numbering).
HEADING_WORDS, PLAIN_LEVEL = 12, 12


def word_count(text):
    """Number of words of a text column; null for null."""
    return F.when(text.isNotNull(), F.size(F.filter(F.split(text, "[ \n]+"), lambda w: w != "")))


class Node:
    """Words ``first`` to ``end`` with the parts they consist of; ``heads`` marks a heading."""

    __slots__ = ("first", "end", "parts", "heads", "level")

    def __init__(self, first: int, end: int, parts: list[Node] | None = None, heads: bool = False, level: int = 0) -> None:
        self.first, self.end, self.parts, self.heads, self.level = first, end, parts or [], heads, level


def heading_level(line: str, words: int) -> int:
    """Level of a heading (1 is the highest), 0 for other lines."""
    if m := _MARKED.match(line):
        return len(m.group(1)) if m.group(1) else int(m.group(2))
    if words > HEADING_WORDS or line.rstrip().endswith(_END):
        return 0
    m = _NUMBERED.match(line)
    if m and "." in m.group(1):
        return m.group(1).count(".") + 2
    return 0 if _ENTRY.match(line) or _ROW.match(line) else PLAIN_LEVEL


def structure(text: str) -> tuple[list[tuple[int, int]], Node]:
    """(character spans of words, tree)."""
    spans: list[tuple[int, int]] = []
    root = Node(0, 0)
    sections = [root]
    run: tuple[str, Node] | None = None  # an open list or table
    entries: list[tuple[int, Node]] = []  # its open entries with their indents
    at = 0
    for line in text.split("\n"):
        first = len(spans)
        found = [(at + m.start(), at + m.end()) for m in _WORD.finditer(line)]
        at += len(line) + 1
        if not found:
            run = None
            continue
        spans += found
        cuts = [first, *(first + i + 1 for i, (a, b) in enumerate(found[:-1]) if text[a:b].rstrip("»”\")'").endswith(_END)), len(spans)]
        node = Node(first, len(spans), [Node(a, b) for a, b in zip(cuts, cuts[1:], strict=False)])
        level = heading_level(line, len(found))
        if level:
            run = None
            lead = first
            while len(sections) > 1 and sections[-1].level >= level:
                closed = sections.pop()
                if len(closed.parts) == 1 and sections[-1].parts[-1] is closed and closed.end == lead:  # a heading without text goes on here
                    sections[-1].parts.pop()
                    lead = closed.first
            section = Node(lead, len(spans), [Node(lead, len(spans), heads=True)], level=level)
            sections[-1].parts.append(section)
            sections.append(section)
            continue
        entry = _ENTRY.match(line)
        kind = "list" if entry else "table" if _ROW.match(line) else ""
        if not kind:
            run = None
            sections[-1].parts.append(node)
            continue
        if run is None or run[0] != kind:
            run = (kind, Node(first, len(spans)))
            sections[-1].parts.append(run[1])
            entries = []
        indent = len(entry.group(1)) if entry else 0
        while entries and entries[-1][0] >= indent:
            entries.pop()
        (entries[-1][1] if entries else run[1]).parts.append(node)
        entries.append((indent, node))
    _close(root)
    root.first, root.end = 0, len(spans)
    return spans, root


def _close(node: Node) -> None:
    """Set the bounds of a finished node, and hang every heading onto the part after it."""
    for part in node.parts:
        _close(part)
    if node.parts:
        node.first, node.end = node.parts[0].first, max(node.end, node.parts[-1].end)
    out: list[Node] = []
    for part in node.parts:
        out.append(_glue(out.pop(), part) if out and out[-1].heads else part)
    node.parts = out


def _glue(head: Node, body: Node) -> Node:
    """A heading and what follows as one node, which opens into the heading with the body's first part, and the rest."""
    if not body.parts or body.parts[0].end == body.end and not body.parts[0].parts:
        return Node(head.first, body.end)
    return Node(head.first, body.end, [_glue(head, body.parts[0]), *body.parts[1:]])


def pack(node: Node, first_limit: int, limit: int) -> list[tuple[int, int]]:
    """Word ranges that cover the node: at most ``first_limit`` words from word 0, ``limit`` elsewhere."""

    def most(first: int) -> int:
        return first_limit if first == 0 else limit

    if node.end - node.first <= most(node.first):
        return [(node.first, node.end)]
    if not node.parts or len(node.parts) == 1 and not node.parts[0].parts and (node.parts[0].first, node.parts[0].end) == (node.first, node.end):
        cuts = [node.first]  # one sentence beyond the limit: between words
        while cuts[-1] < node.end:
            cuts.append(min(node.end, cuts[-1] + most(cuts[-1])))
        return list(zip(cuts, cuts[1:], strict=False))
    out: list[tuple[int, int]] = []
    whole = False  # whether the last range holds whole siblings and may take another
    for part in node.parts:
        if part.end - part.first <= most(part.first):
            if whole and part.end - out[-1][0] <= most(out[-1][0]):
                out[-1] = (out[-1][0], part.end)
            else:
                out.append((part.first, part.end))
            whole = True
        else:
            out += pack(part, first_limit, limit)
            whole = False
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, body start, end, words) character offsets of each piece; bodies laid end to end give the text again."""
    if overlap >= limit:
        raise ValueError("the overlap must be below the limit")
    spans, tree = structure(text)
    if not spans:
        return []
    ranges = pack(tree, limit, limit - overlap)
    out = []
    for k, (a, b) in enumerate(ranges):
        body = 0 if not k else spans[a][0]
        end = spans[ranges[k + 1][0]][0] if k + 1 < len(ranges) else len(text)
        back = max(0, a - overlap) if k else 0
        out.append((spans[back][0] if k else 0, body, end, b - back))
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 800, overlap: int = 50) -> DataFrame:
    """(key, piece_no INT from 1, piece_start INT, body_start INT from 1, n_words INT, piece STRING) of texts beyond ``limit`` words.

    The words are counted in the JVM, so only oversized texts reach Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows = [
                (i, n, start + 1, body + 1, words, t[start:end])
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for n, (start, body, end, words) in enumerate(pieces(t, limit, overlap), 1)
            ]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=[key, "piece_no", "piece_start", "body_start", "n_words", "piece"])

    return df.select(key, text).filter(word_count(F.col(text)) > limit).mapInArrow(run, f"`{key}` bigint, piece_no int, piece_start int, body_start int, n_words int, piece string")


def _pieces(spark, sf_dir: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "relevant_content")


def p7_pieces(spark, sf_dir: str) -> DataFrame:
    """All pieces of oversized pages, without their text (its length and a hash instead)."""
    return _pieces(spark, sf_dir).select("page_id", "piece_no", "body_start", "n_words", F.length("piece").alias("n_chars"), F.md5("piece").alias("piece_md5"))


def p7_checks(spark, sf_dir: str) -> DataFrame:
    """Per oversized page: words of all bodies, and how many pieces break the limit, the overlap or the text.

    A piece must be the text from its start, bodies must follow each other without a gap, and the words repeated must be
    the 50 before the body (all of them where there are fewer).
    """
    p = _pieces(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("relevant_content").alias("t")), "page_id")
    repeated = word_count(F.expr("substring(t, piece_start, body_start - piece_start)"))
    before = word_count(F.expr("substring(t, 1, body_start - 1)"))
    at = Window.partitionBy("page_id").orderBy("piece_no")
    after = F.lead("body_start").over(at)
    ends = F.col("piece_start") + F.length("piece")
    gap = F.when(after.isNull(), ends != F.length("t") + 1).otherwise(ends != after) | (F.col("piece_no") == 1) & (F.col("body_start") != 1)
    rows = p.select("page_id", (F.col("n_words") - repeated).alias("own"), (word_count(F.col("piece")) > 800).alias("long"), (repeated != F.least(before, F.lit(50))).alias("short"), (F.expr("substring(t, piece_start, length(piece))") != F.col("piece")).alias("other"), gap.alias("gap"))
    return rows.groupBy("page_id").agg(F.sum("own").cast("bigint").alias("n_words"), F.count_if("long").alias("n_too_long"), F.count_if("short").alias("n_wrong_overlap"), F.count_if(F.col("other") | F.col("gap")).alias("n_wrong_text"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Pages of more than 800 words: those the splitter cuts."""
    return _pieces(spark, sf_dir).filter("piece_no = 2").select("page_id").distinct()


P7_SQL = r"""
SELECT DISTINCT page_id FROM pages
WHERE len(list_filter(string_split_regex(relevant_content, '[ \n]+'), lambda w: w <> '')) > 800
"""
P7_CHECKS_SQL = r"""
SELECT page_id, n AS n_words, 0 AS n_too_long, 0 AS n_wrong_overlap, 0 AS n_wrong_text
FROM (SELECT page_id, CAST(len(list_filter(string_split_regex(relevant_content, '[ \n]+'), lambda w: w <> '')) AS BIGINT) AS n FROM pages) WHERE n > 800
"""

"""Web sources: addresses from sitemaps, and text, structure, links and keywords from raw HTML.

One vectorised function reads the markup of a page into its parts; everything derived from the parts (title, content,
keywords) is expressions and joins.

Edge cases: null markup gives null parts and an empty list of keywords; unclosed tags are closed by their parents; pages
without any of the areas give their whole visible text; a paragraph ends where a block begins, a list entry at the next; repeated keys are the caller's to drop.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import fixed
from ..functions import text as T
from ..operators.questions import frequent_tokens

#: Characters of content kept of a page; more is cut and marked.
MOST_CONTENT = 75_000
PARTS = "title string, area string, headings array<struct<level: int, text: string>>, paragraphs array<string>, lists array<struct<type: string, items: array<string>>>, hrefs array<string>, images array<string>"
_AREA_CLASS = re.compile("|".join(fixed.CONTENT_CLASSES), re.I)


def _locs(text: Column) -> Column:
    """Trimmed ``loc`` values of an XML sitemap."""
    xml = F.xpath(F.regexp_replace(text, r"^\s+", ""), F.lit('//*[local-name()="loc"]/text()'))
    return F.transform(xml, lambda x: F.trim(x))


def sitemap_urls(files: DataFrame, text: str = "value") -> DataFrame:
    """Distinct page addresses of sitemap texts (XML with ``loc`` elements, or one address a line), sorted."""
    lines = F.transform(F.split(text, r"\s*\n\s*"), lambda x: F.trim(x))
    urls = F.when(F.col(text).contains("<loc"), _locs(F.col(text))).otherwise(lines)
    return files.select(F.explode(urls).alias("url")).filter(A.is_page(F.col("url"))).distinct().orderBy("url")


def sitemap_tree(files: DataFrame, top: list[str], address: str = "address", text: str = "value") -> DataFrame:
    """Distinct page addresses, sorted, of the sitemaps at the addresses ``top`` and, where one of them is an index, of the
    sitemaps it names (one level). ``files`` holds every sitemap that was fetched; an index gives no pages itself."""
    first = files.filter(F.col(address).isin(*top))
    is_index = F.col(text).rlike(r"<(?:\w+:)?sitemap[\s>]")
    named = first.filter(is_index).select(F.explode(_locs(F.col(text))).alias(address)).distinct()
    below = files.join(named, address, "left_semi")
    return sitemap_urls(first.filter(~is_index).unionByName(below).select(text), text)


def start_urls(base: str, sitemap: DataFrame, crawled: DataFrame, enough: int = 350, most: int = 400) -> DataFrame:
    """Addresses to start from: the sitemap, the crawl where that gives too few, and the base; sorted, without repeats."""
    spark = sitemap.sparkSession
    found = sitemap.select("url")
    n = found.distinct().count()
    if n < enough:
        found = found.union(crawled.select("url").distinct().orderBy("url").limit(most - n))
    return found.union(spark.createDataFrame([(base,)], "url string")).distinct().orderBy("url")


class _Reader(HTMLParser):
    """Reads a page into its parts; text within dropped tags is skipped, links within them are kept."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[list[str]]]] = []  # open tags with the texts that end with them
        self.title: list[str] = []
        self.areas: dict[int, list[str]] = {}
        self.visible: list[str] = []
        self.blocks: list[tuple[str, list[str]]] = []
        self.lists: list[tuple[str, list[list[str]]]] = []
        self.hrefs: list[str] = []
        self.images: list[str] = []
        self.dropped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag == "a" and named.get("href"):
            self.hrefs.append(named["href"])
        if tag == "img" and named.get("src"):
            self.images.append(named["src"])
        if tag in fixed.VOID_TAGS:
            return
        open_tags = [t for t, _ in self.open]
        if tag in fixed.CLOSE_PARAGRAPH and "p" in open_tags:
            self.handle_endtag("p")
        if tag == "li" and "li" in open_tags and not {"ul", "ol"} & set(open_tags[len(open_tags) - open_tags[::-1].index("li") :]):
            self.handle_endtag("li")
        texts: list[list[str]] = []
        self.dropped += tag in fixed.DROPPED_TAGS
        if not self.dropped:
            matches = (tag == "main", tag == "article", named.get("id") == "content", bool(_AREA_CLASS.search(named.get("class") or "")), tag == "body")
            for rank, hit in enumerate(matches):
                if hit and rank not in self.areas:
                    texts.append(self.areas.setdefault(rank, []))
            if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                self.blocks.append((tag, []))
                texts.append(self.blocks[-1][1])
            if tag in ("ul", "ol"):
                self.lists.append((tag, []))
            if tag == "li" and self.lists:
                self.lists[-1][1].append([])
                texts.append(self.lists[-1][1][-1])
        if tag == "title" and not self.title:
            texts.append(self.title)
        self.open.append((tag, texts))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                closed, _ = self.open.pop()
                self.dropped -= closed in fixed.DROPPED_TAGS
                if closed == tag:
                    break

    def handle_data(self, data: str) -> None:
        part = data.strip()
        in_title = bool(self.open) and self.open[-1][0] == "title"
        if not part or self.dropped and not in_title:
            return
        if not in_title:
            self.visible.append(part)
        for tag, texts in self.open:
            if not in_title or tag == "title":
                for t in texts:
                    t.append(part)


def _read(html: str | None) -> tuple:
    if html is None:
        return (None,) * 7
    r = _Reader()
    r.feed(html)
    r.close()
    area = r.areas[min(r.areas)] if r.areas else r.visible
    blocks = [(tag, " ".join(t)) for tag, t in r.blocks if t]
    headings = [{"level": int(tag[1]), "text": t} for tag, t in sorted(blocks, key=lambda b: b[0]) if tag[0] == "h"]
    lists = [{"type": kind, "items": [" ".join(i) for i in items if i]} for kind, items in r.lists]
    return " ".join(r.title), " ".join(area), headings, [t for tag, t in blocks if tag == "p"], lists, r.hrefs, r.images


def parts(html: Column) -> Column:
    """A struct of a page's parts, by a vectorised function over the standard library's parser."""

    @F.pandas_udf(PARTS)
    def run(h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(x) for x in h], columns=[c.split()[0] for c in ("title", "area", "headings", "paragraphs", "lists", "hrefs", "images")])

    return run(html)


def parsed(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, title, content, headings, paragraphs, lists, hrefs, images, keywords) of raw pages.

    The content is the first area there is of main, article, the element named content, a content class, the body, cut at
    ``MOST_CONTENT`` characters with a mark. Keywords are words of four letters or more of the first two levels of headings
    (five each) and of the title; where these are fewer than seven, frequent words of the content follow, up to 20 in all.
    """
    read = pages.select(key, F.col(url).alias("__url"), parts(F.col(html)).alias("p"))
    content = T.strip(T.collapse(F.col("p.area")))
    path = F.regexp_replace(F.coalesce("__url", F.lit("")), r"^[A-Za-z]+://[^/]*", "")
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))
    base = F.flatten(F.transform(F.filter("p.headings", lambda h: h["level"] < 3), lambda h: F.slice(words(h["text"]), 1, 5)))
    out = read.select(
        key, F.when(F.col("p.title").isNotNull(), F.coalesce(*[F.when(x != "", x) for x in (T.strip(F.col("p.title")), path)], F.lit("Untitled"))).alias("title"),
        F.when(F.length(content) > MOST_CONTENT, F.concat(F.substring(content, 1, MOST_CONTENT), F.lit("..."))).otherwise(content).alias("content"),
        "p.headings", F.slice(F.filter("p.paragraphs", lambda t: F.length(t) > 20), 1, 5).alias("paragraphs"),
        F.transform(F.slice(F.filter("p.lists", lambda x: F.size(x["items"]) > 0), 1, 3), lambda x: F.struct(x["type"].alias("type"), F.slice(x["items"], 1, 10).alias("items"))).alias("lists"),
        "p.hrefs", F.slice(F.filter("p.images", lambda i: (F.length(i) > 4) & ~i.startswith("data:image")), 1, 20).alias("images"), F.array_distinct(F.coalesce(F.concat(base, words(F.col("p.title"))), F.array().cast("array<string>"))).alias("__base"),
    )
    few = out.filter((F.size("__base") < 7) & F.col("content").isNotNull())
    often = frequent_tokens(few.select(key, "content"), key, "content", n=20, least=5, stopwords=[]).filter(F.col("token").rlike("^[a-z]+$") & ~F.col("token").isin(*fixed.PAGE_STOPWORDS))
    more = often.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("__more"))
    keywords = F.slice(F.array_union("__base", F.coalesce("__more", F.array().cast("array<string>"))), 1, 20)
    return out.join(more, key, "left").withColumn("keywords", keywords).drop("__base", "__more")


def needs_scripts(html: Column, least: int = 350) -> Column:
    """Whether a page shows fewer than ``least`` characters without scripts."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", ""), "<[^>]*>", " ")
    return F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))) < least

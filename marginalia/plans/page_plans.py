"""Queries over knowledge-base pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import fixed
from ..functions import text as T
from ..operators import categories as C
from ..operators import graph
from ..session import table
from .text_plans import _AR, _SAMPLE, arabic_sql, strip_sql, tokens_sql, words_sql

DICTIONARY_STOP = ["the", "and", "for", "of", "in", "to", "de", "la", "le", "der", "die", "das", "في", "من", "على"]


def searchable_pages(spark, d):
    """Pages with a title or search text."""
    return table(spark, d, "pages").filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("search_text", F.lit("")) != "")).select("page_id", "content_id")


def page_by_id(spark, d):
    """First crawl of every content id."""
    return C.first_by(table(spark, d, "pages").select("content_id", "page_id", "url", "title"), "content_id", [F.col("page_id")])


def pages_by_category(spark, d):
    return table(spark, d, "pages").filter(F.lower(F.coalesce("category", F.lit(""))) == "fees").select("page_id", "category")


def result_projection(spark, d):
    """Pages as search results with their defaults."""
    p = table(spark, d, "pages")
    return p.select(
        F.coalesce("content_id", F.concat(F.lit("page_"), F.col("page_id"))).alias("content_id"), "page_id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("category", F.lit("general")).alias("category"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("metrics.word_count", F.lit(0)).cast("bigint").alias("metric_words"), F.col("url").alias("source_url"), F.size(F.coalesce("keywords", F.array().cast("array<string>"))).cast("bigint").alias("n_keywords"),
    )


def category_counts(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(F.count("*").alias("n_pages"), F.sum(F.coalesce("word_count", F.lit(0))).alias("n_words"), F.count_if(T.is_arabic(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))).alias("n_arabic"))


def host_counts(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(A.bare_host(F.lower(F.coalesce("source_url", "url"))).alias("host")).agg(F.count("*").alias("n_pages"), F.count_distinct("content_id").alias("n_contents"), F.count_if(~A.is_page(F.col("url"))).alias("n_not_pages"), F.min("crawled_at").alias("first_crawl"), F.max("crawled_at").alias("last_crawl"))


def file_type_counts(spark, d):
    """Documents by the kind of their source (the file-type statistics of a document run)."""
    return table(spark, d, "documents").groupBy(F.regexp_replace(F.coalesce("source", F.lit("unknown")), "-?[0-9]+$", "").alias("kind")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def web_categories(spark, d):
    """Category of each page by weighted substring counts; ties to the first declared."""
    p = table(spark, d, "pages")
    joined = F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), "\n")
    best = C.scored_categories(p.withColumn("__k", joined), "page_id", [(F.col("title"), 3.0), (F.col("relevant_content"), 1.0), (F.col("__k"), 2.0)], fixed.PAGE_CATEGORIES)
    return best.select("page_id", F.col("category").alias("web_category"))


def document_categories(spark, d):
    """Category of every page by the lexicon of its script (Arabic or English), with the score."""
    p = table(spark, d, "pages")
    title, content = F.coalesce("title", F.lit("")), F.coalesce("relevant_content", F.lit(""))
    keywords = F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")
    return C.document_categories(p, "page_id", title, keywords, content, T.script_language(F.concat_ws(" ", title, content)), table(spark, d, "lexicon")).select("page_id", "category", F.round("score", 6).alias("score"))


def lexicon_categories(spark, d):
    """Lexicon hits of every document by category."""
    return C.lexicon_matches(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "lexicon"))


def best_lexicon_category(spark, d):
    """The best category of every document by lexicon hits; ties by category order."""
    hits = C.lexicon_matches(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "lexicon"))
    best = hits.groupBy("doc_id").agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("best"))
    return table(spark, d, "documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("best", F.lit("general")).alias("best"))


def category_dictionary(spark, d):
    return C.build_dictionary(table(spark, d, "pages"), least=2, excluded=("general",), stopwords=DICTIONARY_STOP)


def sorted_unions(spark, d):
    """All addresses known from pages and from searches, without repeats."""
    urls = table(spark, d, "pages").select(A.without_fragment(F.col("url")).alias("url")).union(table(spark, d, "search_results").select(A.without_fragment(F.col("source_url"))))
    return urls.filter("url is not null").distinct().orderBy("url")


def not_yet_found(spark, d):
    """Contents that no search has returned."""
    return table(spark, d, "pages").select("content_id").distinct().join(table(spark, d, "search_results").select("content_id").distinct(), "content_id", "left_anti")


def reachable(spark, d):
    """Contents within three steps of the first, where each search hit links to the next hit of its question."""
    return graph.within_steps(graph.hit_edges(table(spark, d, "search_results")), table(spark, d, "search_results").agg(F.min("content_id").alias("node")), 3)


QUERIES = {f.__name__: f for f in (searchable_pages, page_by_id, pages_by_category, result_projection, category_counts, host_counts, file_type_counts, web_categories, document_categories, lexicon_categories, best_lexicon_category, category_dictionary, sorted_unions, not_yet_found, reachable)}

_BARE = r"regexp_replace(regexp_extract(lower(coalesce(source_url, url)), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(.*?)www\.', '\1')"


def _count(x: str, term: str) -> str:
    return f"coalesce((length({x}) - length(replace({x}, '{term}', ''))) // {len(term)}, 0)"


def _hits(x: str) -> str:
    return f"((length({x}) - length(replace({x}, term, ''))) // length(term))"


def _best() -> str:
    scores = []
    for i, (name, terms) in enumerate(fixed.PAGE_CATEGORIES.items()):
        total = " + ".join(f"{_count('t', x)} * 3 + {_count('c', x)} + {_count('k', x)} * 2" for x in terms)
        scores.append(f"{{'score': {total}, 'ord': {-i}, 'name': '{name}'}}")
    return "list_max([" + ", ".join(scores) + "])"


_TOKENS = rf"""CASE WHEN {arabic_sql('x')} THEN list_transform(regexp_extract_all(x, '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{08A0}}-\x{{08FF}}]{{2,}}|[a-zA-Z]{{2,}}'), lambda w: CASE WHEN regexp_full_match(w, '[a-zA-Z]+') THEN lower(w) ELSE w END)
  ELSE list_filter({tokens_sql('x')}, lambda w: regexp_full_match(w, '[a-z\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{08A0}}-\x{{08FF}}]{{2,}}')) END"""
_LEX = """l AS (SELECT DISTINCT category, lower(term) AS term FROM lexicon WHERE length(term) > 0), h AS (SELECT doc_id, l.category, (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS k FROM documents, l WHERE contains(lower(text), term)),
  g AS (SELECT doc_id, category, count(*) AS n_terms, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY doc_id, category)"""
SQL = {
    "searchable_pages": "SELECT page_id, content_id FROM pages WHERE coalesce(title, '') <> '' OR coalesce(search_text, '') <> ''",
    "page_by_id": "SELECT content_id, page_id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY page_id) AS rn FROM pages) WHERE rn = 1",
    "pages_by_category": "SELECT page_id, category FROM pages WHERE lower(coalesce(category, '')) = 'fees'",
    "result_projection": "SELECT coalesce(content_id, 'page_' || page_id) AS content_id, page_id, coalesce(title, 'Untitled') AS title, coalesce(summary, '') AS summary, coalesce(category, 'general') AS category, coalesce(word_count, 0) AS word_count, CAST(coalesce(metrics.word_count, 0) AS BIGINT) AS metric_words, url AS source_url, CAST(len(coalesce(keywords, [])) AS BIGINT) AS n_keywords FROM pages",
    "category_counts": f"""SELECT coalesce(category, 'uncategorized') AS category, count(*) AS n_pages, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS n_words, count(*) FILTER ({arabic_sql("concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))")}) AS n_arabic FROM pages GROUP BY 1""",
    "host_counts": f"""SELECT {_BARE} AS host, count(*) AS n_pages, count(DISTINCT content_id) AS n_contents, count(*) FILTER (NOT coalesce(starts_with(url, 'http') AND regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '' AND NOT regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '\\.({'|'.join(fixed.EXCLUDED_ENDINGS)})$|{'|'.join(fixed.EXCLUDED_PARTS)}'), false)) AS n_not_pages,
      min(crawled_at) AS first_crawl, max(crawled_at) AS last_crawl FROM pages GROUP BY 1""",
    "file_type_counts": "SELECT regexp_replace(coalesce(source, 'unknown'), '-?[0-9]+$', '') AS kind, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "web_categories": f"WITH p AS (SELECT page_id, lower(title) AS t, lower(relevant_content) AS c, lower(array_to_string(coalesce(keywords, []), chr(10))) AS k FROM pages), s AS (SELECT page_id, {_best()} AS b FROM p) SELECT page_id, CASE WHEN b.score > 0 THEN b.name ELSE 'general' END AS web_category FROM s",
    "document_categories": rf"""WITH x AS (SELECT page_id, coalesce(title, '') AS t, array_to_string(coalesce(keywords, []), ' ') AS k, coalesce(relevant_content, '') AS c, concat_ws(' ', coalesce(title, ''), coalesce(relevant_content, '')) AS a FROM pages),
      y AS (SELECT page_id, lower(t) AS t, lower(k) AS k, lower(c) AS c, {_SAMPLE.format(x='a')} AS s FROM x),
      z AS (SELECT *, CASE WHEN coalesce(length(s) - length(regexp_replace(s, '{_AR}', '', 'g')) > (length(s) - length(regexp_replace(s, '[a-zA-Z]', '', 'g'))) * 1.5, false) THEN 'ar' ELSE 'en' END AS lang, list_concat({tokens_sql('t')}, {tokens_sql('k')}, {tokens_sql('c')}) AS own FROM y),
      l AS (SELECT category, lang, lower(term) AS term FROM lexicon WHERE length(term) > 0),
      h AS (SELECT page_id, category, 2.0::DOUBLE * {_hits('t')} + 1.5::DOUBLE * {_hits('k')} + {_hits('c')} + 2 * len(list_filter({tokens_sql('term')}, lambda w: length(w) > 2 AND list_contains(own, w))) AS score FROM z JOIN l USING (lang)),
      g AS (SELECT page_id, category, sum(score) AS score FROM h WHERE score > 0 GROUP BY page_id, category), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, category) AS rn FROM g)
      SELECT x.page_id, coalesce(r.category, 'general') AS category, round(coalesce(r.score, 0), 6)::DOUBLE AS score FROM x LEFT JOIN r ON x.page_id = r.page_id AND r.rn = 1""",
    "lexicon_categories": f"WITH {_LEX} SELECT * FROM g",
    "best_lexicon_category": f"WITH {_LEX}, r AS (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, category) AS rn FROM g) SELECT d.doc_id, coalesce(r.category, 'general') AS best FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.rn = 1",
    "category_dictionary": f"""WITH p AS (SELECT page_id, lower({strip_sql("coalesce(category, '')")}) AS category, unnest(list_concat(coalesce(keywords, []), [title], [summary])) AS x FROM pages), k AS (SELECT DISTINCT page_id, category, unnest({_TOKENS}) AS keyword FROM p WHERE category <> '' AND category <> 'general'),
      c AS (SELECT category, keyword, count(*) AS n FROM k WHERE keyword NOT IN ({', '.join(f"'{w}'" for w in DICTIONARY_STOP)}) GROUP BY category, keyword HAVING count(*) >= 2) SELECT category, list(keyword ORDER BY keyword) AS keywords, list(n ORDER BY keyword) AS n_pages FROM c GROUP BY category""",
    "sorted_unions": "SELECT DISTINCT regexp_replace(u, '#.*$', '') AS url FROM (SELECT url AS u FROM pages UNION ALL SELECT source_url FROM search_results) WHERE u IS NOT NULL",
    "not_yet_found": "SELECT DISTINCT content_id FROM pages WHERE content_id NOT IN (SELECT content_id FROM search_results WHERE content_id IS NOT NULL)",
    "reachable": """WITH RECURSIVE e AS (SELECT DISTINCT a.content_id AS src, b.content_id AS dst FROM search_results a JOIN search_results b ON a.question_id = b.question_id AND b.hit_rank = a.hit_rank + 1),
      w AS (SELECT min(content_id) AS node, 0 AS step FROM search_results UNION SELECT e.dst, w.step + 1 FROM w JOIN e ON e.src = w.node WHERE w.step < 3) SELECT node, CAST(min(step) AS INTEGER) AS step FROM w WHERE node IS NOT NULL GROUP BY node""",
}

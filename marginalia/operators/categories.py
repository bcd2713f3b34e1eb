"""Categories by weighted substring counts against lexicons, and dictionaries of keywords per category.

All terms of a lexicon are counted in one pass over each text by an Aho-Corasick automaton, so the work grows with the
text and not with the number of terms.

Edge cases: null texts count nothing; empty terms never match; a term of several categories counts for each; occurrences
of one term do not overlap; ties go to the category declared first (or first in order, for lexicon tables).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_WORD = re.compile(r"\w+")
#: Terms in one automaton; larger lexicons are counted in several passes.
LEXICON_ROWS = 100_000


def automaton(terms: dict[str, int]) -> ahocorasick.Automaton | None:
    """Automaton that yields the number of every matching term; None without terms."""
    a = ahocorasick.Automaton()
    for term, number in terms.items():
        if term:
            a.add_word(term, (number, len(term)))
    if not len(a):
        return None
    a.make_automaton()
    return a


def occurrences(a: ahocorasick.Automaton | None, text: str | None) -> dict[int, int]:
    """Occurrences of each term, not overlapping, from the left."""
    found: dict[int, int] = {}
    if a is None or not text:
        return found
    free: dict[int, int] = {}
    for end, (number, size) in a.iter(text):
        if end - size + 1 >= free.get(number, 0):
            found[number] = found.get(number, 0) + 1
            free[number] = end + 1
    return found


def scored_categories(df: DataFrame, key: str, weighted: list[tuple[Column, float]], lexicon: dict[str, list[str]], default: str = "general") -> DataFrame:
    """(key, category, score DOUBLE): the category of a constant lexicon with the highest weighted count.

    Texts are lower-cased first. ``default`` with score 0 where nothing matches. One narrow pass.
    """
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for ts in lexicon.values() for t in ts))}
    owners: list[list[int]] = [[] for _ in terms]
    for c, ts in enumerate(lexicon.values()):
        for t in ts:  # a term listed twice counts twice
            owners[terms[t]].append(c)
    names, weights = list(lexicon), [w for _, w in weighted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(terms)
        for batch in batches:
            best, scores = [], []
            for texts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                total = [0.0] * len(names)
                for text, weight in zip(texts, weights, strict=True):
                    for number, n in occurrences(a, text).items():
                        for c in owners[number]:
                            total[c] += n * weight
                top = max(total, default=0.0)
                best.append(names[total.index(top)] if top > 0 else default)
                scores.append(top)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[key, "category", "score"])

    texts = [F.lower(c).alias(f"__t{i}") for i, (c, _) in enumerate(weighted)]
    return df.select(F.col(key).cast("bigint").alias(key), *texts).mapInArrow(run, f"`{key}` bigint, category string, score double")


def lexicon_matches(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, category, n_terms BIGINT, n BIGINT): substring hits of a lexicon table by category.

    The lexicon's distinct lower-cased terms become automata of at most ``LEXICON_ROWS`` terms, which bounds what a task
    holds; each is one narrow pass. Lexicons within one automaton need no shuffle.
    """
    pairs = lexicon.filter(F.length("term") > 0).select("category", F.lower("term").alias("term")).distinct()
    n = pairs.count()
    parts = max(1, -(-n // LEXICON_ROWS))
    low = df.select(F.col(key).cast("bigint").alias(key), F.lower(text).alias("__t")).filter(F.col("__t").isNotNull())
    found = None
    for part in range(parts):
        rows = pairs.filter(F.pmod(F.xxhash64("category", "term"), F.lit(parts)) == part).collect()
        one = _count_pass(low, key, [(r["category"], r["term"]) for r in rows])
        found = one if found is None else found.unionByName(one)
    if parts == 1:
        return found
    return found.groupBy(key, "category").agg(F.sum("n_terms").alias("n_terms"), F.sum("n").alias("n"))


def _count_pass(low: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for _, t in pairs))}
    owners: list[list[str]] = [[] for _ in terms]
    for category, term in pairs:
        owners[terms[term]].append(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(terms)
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by: dict[str, list[int]] = {}
                for number, n in occurrences(a, text).items():
                    for category in owners[number]:
                        sums = by.setdefault(category, [0, 0])
                        sums[0] += 1
                        sums[1] += n
                rows += [(k, c, *s) for c, s in by.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[key, "category", "n_terms", "n"])

    return low.mapInArrow(run, f"`{key}` bigint, category string, n_terms bigint, n bigint")


def document_categories(df: DataFrame, key: str, title: Column, keywords: Column, content: Column, language: Column, lexicon: DataFrame) -> DataFrame:
    """(key, category, score): lexical score of documents by the lexicon of their language (English where it has none).

    Per term: 2 for each occurrence in the title, 1.5 in the keywords joined by spaces, 1 in the content, and 2 for each of
    its tokens (longer than two letters) that stands among the document's tokens. Ties go to the first category in order.
    """
    rows = lexicon.filter(F.length("term") > 0).select("category", "lang", F.lower("term").alias("term"), "ord").orderBy("category", "ord").limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"the lexicon has more than {LEXICON_ROWS} terms")
    by_lang: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["category"], r["term"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = {}
        for lang, pairs in by_lang.items():
            terms = {t: i for i, t in enumerate(dict.fromkeys(t for _, t in pairs))}
            built[lang] = (automaton(terms), terms, pairs, {t: [w for w in _tokens(t) if len(w) > 2] for t in terms})
        fallback = built.get("en")
        for batch in batches:
            ids, langs, *texts = (c.to_pylist() for c in batch.columns)
            best, scores = [], []
            for lang, t, k, c in zip(langs, *texts, strict=True):
                score: dict[str, float] = {}
                a, terms, pairs, parts = built.get(lang) or fallback or (None, {}, [], {})
                counts = [(occurrences(a, x), w) for x, w in ((t, 2.0), (k, 1.5), (c, 1.0))]
                own = {w for x in (t, k, c) for w in _tokens(x or "") if len(w) > 2}
                for category, term in pairs:
                    number = terms[term]
                    s = sum(f.get(number, 0) * w for f, w in counts) + 2.0 * sum(w in own for w in parts[term])
                    if s:
                        score[category] = score.get(category, 0.0) + s
                top = max(score.values(), default=0.0)
                best.append(min(n for n, s in score.items() if s == top) if top > 0 else "general")
                scores.append(top)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[key, "category", "score"])

    low = df.select(F.col(key).cast("bigint").alias(key), language.alias("__l"), F.lower(title).alias("__t"), F.lower(keywords).alias("__k"), F.lower(content).alias("__c"))
    return low.mapInArrow(run, f"`{key}` bigint, category string, score double")


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text)


def build_dictionary(pages: DataFrame, least: int = 1, excluded: tuple[str, ...] = (), stopwords: list[str] = ()) -> DataFrame:
    """(category, keywords ARRAY sorted, n_pages ARRAY): keywords on at least ``least`` pages of the category.

    Keywords are the cleaned tokens of a page's keywords, title and summary, once per page. Latin words sort by lower
    case, others as they are. Rows are counted per (category, keyword) with partial aggregates; only frequent keywords
    reach the final lists.
    """
    none = F.array().cast("array<string>")
    texts = F.concat(F.coalesce("keywords", none), F.array("title"), F.array("summary"))
    tokens = F.array_distinct(F.flatten(F.transform(texts, T.dictionary_tokens)))
    category = F.lower(T.strip(F.coalesce("category", F.lit(""))))
    stop = F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")
    rows = pages.select(category.alias("category"), F.explode(F.array_except(tokens, stop)).alias("keyword")).filter((F.col("category") != "") & ~F.col("category").isin(*excluded or ("",)))
    counts = rows.groupBy("category", "keyword").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("keyword", "n"))).alias("x")).select("category", F.col("x.keyword").alias("keywords"), F.col("x.n").alias("n_pages"))


def first_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (``row_number`` limits rows per partition before the shuffle)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")

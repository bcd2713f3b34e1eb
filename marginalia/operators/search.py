"""Ranking of pages for batches of questions: boosted term matching, fuzzy matching and TF-IDF cosine.

Terms are matched as substrings. A term without white space lies within one white-space separated word, so the nested
loop over questions, terms, pages and fields becomes joins: pages are reduced to postings of distinct words with counts,
the distinct vocabulary meets the distinct terms once (by letter trigrams, then an exact test), and scores are sums over
equi-joins. No pair of a question and a page is formed unless they share a term, and where only the best pages are wanted
no pair is written at all: blocks of questions meet blocks of pages, whose inverted lists are summed in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..session import broadcast_if_small, cut

#: Pages and questions of a block at most; fewer pages while there are not LEAST_BLOCKS pairs of blocks, down to SMALL_BLOCK.
PAGE_BLOCK, QUESTION_BLOCK, SMALL_BLOCK, LEAST_BLOCKS = 32_768, 131_072, 4096, 12
#: Questions of a block whose terms are looked up at once.
AT_ONCE = 8192
#: Terms or words of a block that are compared at once, and columns of their tables of letters at most.
WORD_BLOCK, LETTERS = 8192, 256
#: Rows of (term, word) up to which these are broadcast to the pages.
FEW_WORDS = 300_000


def page_fields(pages: DataFrame, key: str = "page_id", boosts: dict[str, float] = fixed.FIELD_BOOSTS, spread: bool = True) -> DataFrame:
    """(page, boost, text): the lower-cased searchable fields of pages with a title or a search text; with ``spread`` partitioned by page."""
    none = F.array().cast("array<string>")
    texts = {"title": F.col("title"), "summary": F.col("summary"), "keywords": F.array_join(F.coalesce("keywords", none), " "), "search_text": F.col("search_text"), "structured": F.array_join(F.coalesce("structured_content.headings", none), " ")}
    kept = pages.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("search_text", F.lit("")) != ""))
    fields = F.array(*[F.struct(F.lit(b).alias("boost"), F.lower(F.coalesce(texts[n], F.lit(""))).alias("text")) for n, b in boosts.items()])
    # texts are smaller than their words: grouping by page and anything else needs no further exchange
    rows = kept.select(F.col(key).alias("page"), fields.alias("fs"))
    rows = rows.repartition("page") if spread else rows
    return rows.select("page", F.explode("fs").alias("f")).select("page", "f.boost", "f.text").filter("text <> ''")


def postings(fields: DataFrame) -> DataFrame:
    """(page, word, weight): boost times occurrences of each white-space separated word, over all fields."""
    rows = fields.select("page", "boost", F.explode(T.words(F.col("text"))).alias("word"))
    return rows.groupBy("page", "word").agg(F.sum("boost").alias("weight"))


def _term_list(topics: str, keywords: str) -> Column:
    none = F.array().cast("array<string>")
    return F.filter(F.array_union(F.coalesce(topics, none), F.coalesce(keywords, none)), lambda t: t.isNotNull() & (t != ""))


def question_terms(questions: DataFrame, key: str, topics: str = "topics", keywords: str = "keywords") -> DataFrame:
    """(question, term, n_terms): distinct spellings of topics and keywords, with the number of terms of the question."""
    return questions.select(F.col(key).alias("question"), _term_list(topics, keywords).alias("terms")).select("question", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def _grams(word: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(n))))


def words_with_term(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, word, hits BIGINT): words of the vocabulary that contain a term, and how often.

    Terms of three letters or more are joined on their first trigram, shorter ones on themselves as one- or two-letter
    grams; ``contains`` then decides.
    """
    parts = []
    for n, own in ((3, F.length("low") >= 3), (2, F.length("low") == 2), (1, F.length("low") == 1)):
        t = terms.withColumn("low", F.lower("term")).filter(own).withColumn("gram", F.substring("low", 1, n))
        v = vocabulary.filter(F.length("word") >= n).select("word", F.explode(_grams(F.col("word"), n)).alias("gram"))
        parts.append(t.join(v, "gram").filter(F.col("word").contains(F.col("low"))).select("term", "word", T.count_of(F.col("word"), F.col("low")).alias("hits")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _vocabulary(pages: DataFrame, page_key: str) -> DataFrame:
    """(word): the distinct words of all fields, written out."""
    return cut(page_fields(pages, page_key, spread=False).select(F.explode(T.words(F.col("text"))).alias("word")).distinct())


def _asked_terms(questions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """((question, term, n_terms, name), (id, term)): terms by numbers, which are smaller than their names, and these."""
    asked = cut(question_terms(questions, key))
    ids = cut(asked.select("term").distinct()).withColumn("id", F.monotonically_increasing_id())
    return asked.join(ids, "term").select("question", F.col("id").alias("term"), "n_terms", F.col("term").alias("name")), ids


def page_terms(fields: DataFrame, found: DataFrame, share: Column) -> DataFrame:
    """(page, term, w): sums of ``share`` over the words of a page and the rows of ``found`` (term, word, ...).

    Postings are made anew from the texts, as they are several times their size. Few words are broadcast, so the rows
    stay where their page is.
    """
    return postings(fields).join(broadcast_if_small(found, FEW_WORDS), "word").groupBy("page", "term").agg(F.sum(share).alias("w"))


def exact_terms(questions: DataFrame, pages: DataFrame, question_key: str, page_key: str) -> tuple[DataFrame, DataFrame]:
    """((question, term, n_terms, name), (page, term, w)): the exact part of the term score, terms by numbers.

    For every term and field: occurrences times a tenth of the term's length times the field's boost.
    """
    asked, ids = _asked_terms(questions, question_key)
    found = words_with_term(_vocabulary(pages, page_key), ids.select("term")).join(ids, "term")
    return asked, page_terms(page_fields(pages, page_key), found.select(F.col("id").alias("term"), "word", "hits", F.length("term").alias("n")), F.col("weight") * F.col("hits") * F.col("n") / 10.0)


def exact_scores(questions: DataFrame, pages: DataFrame, question_key: str, page_key: str, top: int | None = None, least: float = 0.1, listed: bool = True) -> DataFrame:
    """(question, page, score DOUBLE, matched ARRAY sorted): the exact part of the term score; with ``top`` also the rank.

    The sum over terms is divided by the question's number of terms and raised by a fifth if more than one term matched.
    """
    return _ranked(*exact_terms(questions, pages, question_key, page_key), pages, top, least, listed)


def _ranked(asked: DataFrame, per_term: DataFrame, pages: DataFrame, top: int | None, least: float, listed: bool = True) -> DataFrame:
    """Scores of all pairs of a question and a page, or of the ``top`` pages of each question alone."""
    if top is not None:
        return best_by_blocks(pages.count(), top, least, (asked, per_term), listed=listed)
    per_term = cut(per_term)
    pairs = asked.join(per_term, "term").groupBy("question", "page").agg(F.sum("w").alias("s"), F.count("*").alias("n"), F.first("n_terms").alias("n_terms"))
    scores = pairs.select("question", "page", (F.col("s") / F.col("n_terms") * F.when(F.col("n") > 1, 1.2).otherwise(1.0)).alias("score"))
    return with_matched(scores, asked, per_term) if listed else scores


def with_matched(scores: DataFrame, asked: DataFrame, per_term: DataFrame) -> DataFrame:
    """``scores`` with the sorted terms of each pair that match."""
    matched = scores.select("question", "page").join(asked, "question").join(per_term, ["term", "page"]).groupBy("question", "page").agg(F.array_sort(F.collect_set("name")).alias("matched"))
    return scores.join(matched, ["question", "page"])


def best_pages(scores: DataFrame, n: int = 10, least: float = 0.1) -> DataFrame:
    """The ``n`` best pages of every question from ``least`` on, ties by page, with their rank.

    Each question's rows are cut to ``n`` within partitions first, as Spark does for a rank filter.
    """
    w = Window.partitionBy("question").orderBy(F.desc(F.round("score", 9)), "page")
    return scores.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _listed(rows: DataFrame, by: str, weight: str, prefix: str) -> DataFrame:
    """(by, <prefix>t ARRAY, <prefix>w ARRAY): the terms of each key and their weights."""
    lists = rows.groupBy(by).agg(F.collect_list(F.struct("term", F.col(weight).cast("double").alias("w"))).alias("x"))
    return lists.select(by, F.col("x.term").alias(f"{prefix}t"), F.col("x.w").alias(f"{prefix}w"))


def best_by_blocks(n_pages: int, top: int, least: float, terms: tuple[DataFrame, DataFrame] | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, listed: bool = False) -> DataFrame:
    """(question, page, score, rank), with ``listed`` also ``matched``: the ``top`` best pages of each question.

    ``terms`` is ((question, term, n_terms), (page, term, w)), where ``name`` is the spelling if terms are numbers;
    ``vectors`` is ((question, term, weight), (page, term, weight)), or (page, ct ARRAY, cw ARRAY) for the pages.
    The score is the term score, the cosine, or for pairs that share a term both ``combined``. Every block of questions
    meets every block of pages in one task, which scores all their pairs in memory and hands on the ``top`` best of each
    question; so what is shuffled grows with questions and pages, not with the pairs. The same ranking as
    ``best_pages``: a page among the best of all is among the best of its block.
    """
    asked, held = [], []
    if terms:
        name = "name" if "name" in terms[0].columns else "term"
        lists = terms[0].groupBy("question").agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "term"))).alias("x"), F.first("n_terms").cast("double").alias("n_terms"))
        asked.append(lists.select("question", F.col("x.term").alias("bt"), F.col("x.name").alias("bn"), "n_terms"))
        held.append(_listed(terms[1], "page", "w", "b"))
    if vectors:
        asked.append(_listed(vectors[0], "question", "weight", "c"))
        held.append(vectors[1] if "ct" in vectors[1].columns else _listed(vectors[1], "page", "weight", "c"))
    questions = cut(asked[0].join(asked[1], "question", "left") if len(asked) > 1 else asked[0])
    pages = held[0].join(held[1], "page", "left") if len(held) > 1 else held[0]
    # every block of questions is another copy of the pages' lists
    question_blocks = max(-(-questions.count() // QUESTION_BLOCK), 1)
    page_blocks = max(-(-n_pages // PAGE_BLOCK), min(-(-LEAST_BLOCKS // question_blocks), -(-n_pages // SMALL_BLOCK)), 1)
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = questions.drop("bn").withColumn("qb", block("question", question_blocks)).withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(page_blocks - 1))))
    right = pages.withColumn("pb", block("page", page_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(question_blocks - 1))))
    kinds = {f.name: f.dataType.simpleString() for f in (*questions.schema.fields, *pages.schema.fields)}
    run = _block_ranker(top, least, terms is not None, vectors is not None, listed)
    rows = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(run, f"question {kinds['question']}, page {kinds['page']}, score double, met string")
    best = best_pages(rows, top, least)
    if not listed:
        return best.drop("met")
    matched = F.filter("bn", lambda t, i: F.substring(F.col("met"), i + 1, F.lit(1)) == "1")
    return best.join(questions.select("question", "bn"), "question").select("question", "page", "score", "rank", matched.alias("matched"))


class _Lists:
    """Inverted lists of a block of pages: for each term the pages' places, ascending, and weights."""

    def __init__(self, terms: pa.ListArray, weights: pa.ListArray) -> None:
        flat = pc.list_flatten(terms).dictionary_encode()
        self.names, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
        places = np.repeat(np.arange(len(terms)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
        order = np.argsort(codes, kind="stable")
        self.start = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(self.names)))].tolist()
        self.places, self.weights = places[order], pc.list_flatten(weights).to_numpy(zero_copy_only=False)[order]
        self.n, self.sorted_codes = len(terms), codes[order]

    def asked(self, terms: pa.ListArray) -> tuple[list[int], list[int]]:
        """(offsets, numbers of the terms laid end to end, -1 for those that no page of the block has)."""
        lens = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        return np.r_[0, np.cumsum(lens)].tolist(), pc.fill_null(pc.index_in(pc.list_flatten(terms), value_set=self.names), -1).to_pylist()

    def span(self, term: int) -> slice:
        return slice(self.start[term], self.start[term + 1])

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether the page at a place has a term (-1: no page has), for each pair of both."""
        if not len(self.places):
            return np.zeros(len(terms), bool)
        keys, held = terms.astype(np.int64) * self.n + places, self.sorted_codes.astype(np.int64) * self.n + self.places
        return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def _block_ranker(top: int, least: float, by_terms: bool, by_vectors: bool, listed: bool):
    """Function of a block of questions and a block of pages: their best pairs."""

    def best_places(scores: np.ndarray) -> np.ndarray:
        # pages that match at all have scores above 0
        floor = max(least, np.nextafter(0.0, 1.0))
        if len(scores) > top:
            # the top-th best of the maxima of groups is no better than the top-th best of all
            heads = scores[: len(scores) // 64 * 64].reshape(64, -1).max(0) if len(scores) > 64 * max(top, 32) else scores
            floor = max(floor, np.partition(heads, -top)[-top] - 2e-9)
        some = np.flatnonzero(scores >= floor)
        return some[np.argsort(-np.floor(scores[some] * 1e9 + 0.5), kind="stable")[:top]]

    column = lambda t, name: t[name].combine_chunks() if t[name].num_chunks != 1 else t[name].chunk(0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        right = right.take(pc.sort_indices(right["page"]))
        main = "b" if by_terms else "c"
        lists = _Lists(column(right, f"{main}t"), column(right, f"{main}w"))
        vector_lists = (_Lists(column(right, "ct"), column(right, "cw")) if by_terms else lists) if by_vectors else None
        pages = right["page"]
        del right
        return pa.concat_tables([some(left.slice(i, AT_ONCE), pages, lists, vector_lists) for i in range(0, max(left.num_rows, 1), AT_ONCE)])

    def marks(who: np.ndarray, where: np.ndarray, at: np.ndarray, codes: np.ndarray, lists: _Lists) -> pa.Array:
        """For each pair a letter for every term of the question: 1 if the page has it, else 0."""
        sizes = (at[1:] - at[:-1])[who]
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        terms = codes[np.arange(ends[-1]) - np.repeat(ends[:-1] - at[who], sizes)]
        letters = lists.has(terms, np.repeat(where, sizes)).astype(np.uint8) + ord("0")
        return pa.StringArray.from_buffers(len(who), pa.py_buffer(ends), pa.py_buffer(letters))

    def some(left: pa.Table, pages: pa.ChunkedArray, lists: _Lists, vector_lists: _Lists | None) -> pa.Table:
        n = len(pages)
        at, codes = lists.asked(column(left, "bt" if by_terms else "ct"))
        if by_terms:
            n_terms = left["n_terms"].to_pylist()
        if by_vectors:
            c_at, c_codes = vector_lists.asked(column(left, "ct"))
            own = pc.list_flatten(column(left, "cw")).to_pylist()
        # room that is kept: large arrays are slow to allocate
        who, where, scores, room = [], [], [], np.empty(n)
        for q in range(left.num_rows):
            mine = codes[at[q] : at[q + 1]]
            spans = [lists.span(c) for c in mine if c >= 0]
            if not spans:
                continue
            places = np.concatenate([lists.places[s] for s in spans])
            factors = [own[i] for i in range(at[q], at[q + 1]) if codes[i] >= 0] if not by_terms else [1.0] * len(spans)
            weights = np.concatenate([lists.weights[s] if f == 1.0 else lists.weights[s] * f for s, f in zip(spans, factors, strict=True)])
            at_page = None
            if len(places) * 64 < n:
                at_page, places = np.unique(places, return_inverse=True)
            m = n if at_page is None else len(at_page)
            score = np.bincount(places, weights, m)
            if by_terms:
                score /= n_terms[q]
                if len(spans) > 1:
                    np.multiply(score, 1.2, out=score, where=np.bincount(places, minlength=m) > 1)
            if by_terms and by_vectors and c_at[q] < c_at[q + 1]:
                pairs = [(vector_lists.span(c_codes[i]), own[i]) for i in range(c_at[q], c_at[q + 1]) if c_codes[i] >= 0]
                if pairs:
                    cos = np.bincount(np.concatenate([vector_lists.places[s] for s, _ in pairs]), np.concatenate([vector_lists.weights[s] * f for s, f in pairs]), n)
                    cos = cos if at_page is None else cos[at_page]
                    both = (cos > 0) & (score > 0)
                    cos *= 0.4
                    cos += np.multiply(score, 0.6, out=room[:m])
                    np.copyto(score, cos, where=both)
            best = best_places(score)
            who.append(np.full(len(best), q))
            where.append(best if at_page is None else at_page[best])
            scores.append(score[best])
        who = np.concatenate([np.zeros(0, np.int64), *who])
        where, scores = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((where, np.int64), (scores, np.float64)))
        met = marks(who, where, np.array(at), np.array(codes, np.int64), lists) if listed else pa.nulls(len(who), pa.string())
        return pa.table({"question": left["question"].take(pa.array(who)), "page": pages.take(pa.array(where)), "score": pa.array(scores), "met": met})

    return run


def _letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, number of the letter) of every letter; the k-th occurrence in a word counts as a letter of its own."""
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    order = np.lexsort((letters, row))
    row, letters = row[order], letters[order]
    at = np.arange(len(row))
    first = np.r_[True, (row[1:] != row[:-1]) | (letters[1:] != letters[:-1])][: len(row)]
    return row, letters * 64 + np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)), 63)


def _letter_tables(left: list[str], right: list[str]) -> list[np.ndarray]:
    """Tables of letters for both lists of words: the product of two rows is the letters in common, or more where columns are shared."""
    (rows, letters), (more_rows, more_letters) = _letter_counts(left), _letter_counts(right)
    both = np.intersect1d(letters, more_letters)
    tables = []
    for words, r, x in ((left, rows, letters), (right, more_rows, more_letters)):
        kept, made = np.isin(x, both), np.zeros((len(words), max(min(len(both), LETTERS), 1)), np.float32)
        np.add.at(made, (r[kept], np.searchsorted(both, x[kept]) % made.shape[1]), 1)
        tables.append(made)
    return tables


def _alike(least: float):
    """Function of a block of terms and a block of words: the pairs more alike than ``least``."""
    from difflib import SequenceMatcher

    def likely(lows: list[str], words: list[str]):
        """Places of terms and words, both ascending in length, with enough letters in common."""
        a, b = np.array([len(w) for w in lows]), np.array([len(w) for w in words])
        mine, theirs = _letter_tables(lows, words)
        for n in np.unique(a):
            fits = np.flatnonzero(2 * np.minimum(n, b) > least * (n + b) - 1e-6)
            if len(fits):
                first, end = fits[0], fits[-1] + 1
                enough = (least * (n + b[first:end]) / 2 - 1e-6).astype(np.float32)
                start, stop = np.searchsorted(a, [n, n + 1])
                for i in range(start, stop, 512):
                    x, y = np.nonzero(mine[i : min(i + 512, stop)] @ theirs[first:end].T > enough)
                    yield x + i, y + first

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        terms, lows, words = left["term"].to_pylist(), left["low"].to_pylist(), sorted(right["word"].to_pylist(), key=len)
        order = sorted(range(len(lows)), key=lambda i: len(lows[i]))
        found, matcher = [], SequenceMatcher(None)
        if lows and words:
            x, y = (np.concatenate(z) for z in zip((np.zeros(0, int),) * 2, *likely([lows[i] for i in order], words), strict=True))
            last, by_word = -1, np.argsort(y, kind="stable")
            for i, j in zip(x[by_word].tolist(), y[by_word].tolist(), strict=True):
                if j != last:
                    matcher.set_seq2(words[j])
                    last = j
                matcher.set_seq1(lows[order[i]])
                ratio = matcher.ratio()
                if ratio > least:
                    found.append((terms[order[i]], words[j], ratio))
        return pa.table({name: pa.array([r[k] for r in found], kind) for k, (name, kind) in enumerate((("term", pa.string()), ("word", pa.string()), ("similarity", pa.float64())))})

    return run


def fuzzy_words(vocabulary: DataFrame, terms: DataFrame, least: float = 0.8) -> DataFrame:
    """(term, word, similarity): distinct pairs more alike than ``least``.

    The ratio is ``2m / (a + b)`` for m matching letters of words of a and b letters, and no more letters match than both
    have in common. Blocks of terms meet blocks of words in one task, where a product of tables of letters gives these for
    all pairs of fitting lengths; only pairs with enough of them are compared. No pair is lost.
    """
    t = terms.select("term", F.lower("term").alias("low")).distinct().filter("low <> ''")
    v = vocabulary.select("word").distinct().filter("word <> ''")
    # counted before equal ones are taken together, which would shuffle them once more
    term_blocks, word_blocks = (max(-(-df.count() // WORD_BLOCK), 1) for df in (terms, vocabulary))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = t.withColumn("tb", block("term", term_blocks)).withColumn("wb", F.explode(F.sequence(F.lit(0), F.lit(word_blocks - 1))))
    right = v.withColumn("wb", block("word", word_blocks)).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(term_blocks - 1))))
    return left.groupBy("tb", "wb").cogroup(right.groupBy("tb", "wb")).applyInArrow(_alike(least), "term string, word string, similarity double")


def full_term_scores(questions: DataFrame, pages: DataFrame, question_key: str, page_key: str) -> tuple[DataFrame, DataFrame]:
    """((question, term, n_terms, name), (page, term, w)): exact and fuzzy parts together; an exact word hit counts in both."""
    asked, ids = _asked_terms(questions, question_key)
    vocabulary, terms = _vocabulary(pages, page_key), ids.select("term")
    exact = words_with_term(vocabulary, terms).select("term", "word", (F.col("hits") * F.length("term") / 10.0).alias("s"))
    fuzzy = fuzzy_words(vocabulary, terms).select("term", "word", (F.col("similarity") * F.length("term") / 15.0 * 0.5).alias("s"))
    found = exact.unionByName(fuzzy).groupBy("term", "word").agg(F.sum("s").alias("s")).join(ids, "term")
    return asked, page_terms(page_fields(pages, page_key), found.select(F.col("id").alias("term"), "word", "s"), F.col("weight") * F.col("s"))


def full_scores(questions: DataFrame, pages: DataFrame, question_key: str, page_key: str, top: int | None = None, least: float = 0.1, listed: bool = True) -> DataFrame:
    """(question, page, score, matched): scores of exact and fuzzy matching together."""
    return _ranked(*full_term_scores(questions, pages, question_key, page_key), pages, top, least, listed)


def tfidf(docs: DataFrame, key: str, text: str, stopwords: list[str] = fixed.STOPWORDS_EN, features: int = 5000, bigrams: bool = True, listed: bool = False) -> tuple[DataFrame, DataFrame]:
    """((key, term, weight), (term, idf, id)): L2-normed weights over the most frequent terms.

    With ``listed`` one row of each document instead: (key, ct, cw), the numbers of its terms and their weights.

    Terms are tokens of two word characters or more without stop words, and pairs of neighbours among these.
    ``idf = ln((1 + n) / (1 + df)) + 1``. The vocabulary is the ``features`` terms with the highest corpus frequency,
    ties by term; it is at most that many rows and is broadcast.
    """
    stop = F.array(*[F.lit(w) for w in stopwords])
    # partitioned by document, so its terms are grouped without an exchange; they are made anew for the weights
    spread = docs.select(key, F.col(text).alias("text")).repartition(key)
    base = spread.select(key, F.filter(T.tokens(F.coalesce("text", F.lit(""))), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    rows = base.select(key, F.explode(F.concat("w", pairs) if bigrams else F.col("w")).alias("term"))
    n = docs.select(key).distinct().count()
    counts = rows.groupBy(key, "term").agg(F.count("*").alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).orderBy(F.desc("ctf"), "term").limit(features).select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    vocabulary = cut(vocabulary).withColumn("id", F.monotonically_increasing_id())
    name = "id" if listed else "term"
    raw = rows.join(F.broadcast(vocabulary), "term").groupBy(key, name, "idf").agg(F.count("*").alias("tf")).select(key, name, (F.col("tf") * F.col("idf")).alias("x"))
    lists = raw.groupBy(key).agg(F.collect_list(F.struct(name, "x")).alias("l"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    if listed:
        return lists.select(key, F.col("l.id").alias("ct"), F.transform("l", lambda t: t["x"] / F.col("norm")).alias("cw")), vocabulary
    return lists.select(key, "norm", F.explode("l").alias("t")).select(key, "t.term", (F.col("t.x") / F.col("norm")).alias("weight")), vocabulary


def query_vectors(questions: DataFrame, key: str, terms: str, vocabulary: DataFrame, stopwords: list[str] = fixed.STOPWORDS_EN, name: str = "term") -> DataFrame:
    """(key, term, weight) of query texts over a fitted vocabulary, where ``name`` is "id" terms by numbers."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    base = questions.select(key, F.filter(T.tokens(F.col(terms)), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    raw = base.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")).join(F.broadcast(vocabulary), "term").select(key, F.col(name).alias("term"), (F.col("tf") * F.col("idf")).alias("x"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("weight"))


def cosine(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """(a_key, b_key, cosine) of pairs with a common term, by one equi-join on the term."""
    return a.select(a_key, "term", F.col("weight").alias("wa")).join(b.select(b_key, "term", F.col("weight").alias("wb")), "term").groupBy(a_key, b_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def combined(basic: Column, cos: Column) -> Column:
    """``0.6 basic + 0.4 cosine`` where the cosine is positive, else basic."""
    return F.when(F.coalesce(cos, F.lit(0.0)) > 0, basic * 0.6 + cos * 0.4).otherwise(basic)


def snippet(content: Column, terms: Column, most: int = 500) -> Column:
    """The sentences of a text that match best, joined from the best down while they fit into ``most`` characters.

    Built-in array expressions; meant for the few rows left after ranking. A sentence's score is the number of its
    occurrences of each term times the term's length; ties go to the earlier one. Without terms the start of the text;
    without a match its start and ``...``; if less than half of ``most`` is filled, the best sentence with its neighbours
    where these fit. Null for null, the cleaned text itself where it is short enough.
    """
    none = F.coalesce(F.size(terms), F.lit(0)) <= 0
    made = _let(cleaned_sentences(content, most), lambda made: matching_sentences(made, terms, most))
    return F.when(content.isNull() | (content == ""), content).when(none, F.substring(content, 1, most)).otherwise(made)


def cleaned_sentences(content: Column, most: int = 500) -> Column:
    """What snippets of a text need, whatever the terms: (head: ``most`` characters and one of the cleaned text, parts: its sentences if it is longer)."""
    return _let(T.clean_for_search(content), lambda text: F.struct(F.substring(text, 1, most + 1).alias("head"), F.when(F.length(text) > most, T.sentence_parts(text)).alias("parts")))


def matching_sentences(made: Column, terms: Column, most: int = 500) -> Column:
    """The snippet from ``cleaned_sentences``."""
    low_terms = F.filter(F.transform(terms, F.lower), lambda t: t != "")

    def ranked_sentences(sentences: Column, low: Column) -> Column:
        """(score negated, place from 0, sentence) of the sentences that match, the best first."""

        def score(sentence: Column) -> Column:
            return F.aggregate(low, F.lit(0).cast("bigint"), lambda total, t: total + T.count_of(sentence, t) * F.length(t))

        def rated(sentence: Column, place: Column) -> Column:
            return F.struct((-_let(F.lower(sentence), score)).alias("score"), place.alias("place"), sentence.alias("sentence"))

        # the only white space of a cleaned text are blanks
        return F.array_sort(F.filter(F.transform(F.transform(sentences, lambda s: F.trim(s)), rated), lambda r: r["score"] < 0))

    def packed_sentences(ranked: Column) -> Column:
        """The ranked sentences that fit, joined; the first that does not ends the text."""
        start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

        def add(state: Column, r: Column) -> Column:
            longer = F.when(state["text"] == "", r["sentence"]).otherwise(F.concat_ws(" ", state["text"], r["sentence"]))
            fits = ~state["full"] & (F.length(longer) <= most)
            return F.struct(F.when(fits, longer).otherwise(state["text"]).alias("text"), (~fits).alias("full"))

        return F.aggregate(ranked, start, add)["text"]

    def finished(packed: Column, around: Column) -> Column:
        body = F.when((F.length(packed) < most // 2) & (F.length(around) <= most), around).otherwise(packed)
        return F.when(F.length(body) == most, F.concat(body, F.lit("..."))).otherwise(body)

    def chosen(text: Column, sentences: Column) -> Column:
        def with_ranked(ranked: Column) -> Column:
            best = F.get(ranked, F.lit(0))["place"]
            around = T.strip(F.array_join(F.slice(sentences, F.greatest(best, F.lit(1)), F.when(best > 0, 3).otherwise(2)), " "))
            found = _let(packed_sentences(ranked), lambda packed: finished(packed, around))
            return F.when(F.size(ranked) > 0, found).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))

        return _let(_let(low_terms, lambda low: ranked_sentences(sentences, low)), with_ranked)

    return F.when(F.length(made["head"]) <= most, made["head"]).when(made["parts"].isNotNull(), chosen(made["head"], made["parts"]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_snippets(best: DataFrame, pages: DataFrame, page_key: str) -> DataFrame:
    """``best`` (with ``matched``, not empty) with the snippet of each row; a page's text is cleaned and split once for all of its rows."""
    contents = pages.select(F.col(page_key).alias("page"), "relevant_content").repartition("page")
    made = contents.select("page", cleaned_sentences(F.col("relevant_content")).alias("made"))
    return best.join(made, "page").withColumn("snippet", matching_sentences(F.col("made"), F.col("matched"))).drop("made")


def searched(questions: DataFrame, pages: DataFrame, texts: DataFrame, question_key: str, page_key: str, top: int = 10, least: float = 0.1) -> DataFrame:
    """(question, page, rank, score, matched, snippet): the whole search of a batch of questions.

    Exact and fuzzy term scores, combined with the cosine of the TF-IDF vectors where that is positive, pages from
    ``least`` on, the ``top`` best of each question, and a snippet of each. ``texts`` holds (page_key, text) for the
    vectors; pages without title and search text, and questions without terms, find nothing.
    """
    asked, per_term = full_term_scores(questions, pages, question_key, page_key)
    weights, vocabulary = tfidf(texts, page_key, "text", listed=True)
    joined = questions.select(F.col(question_key).alias("question"), F.array_join(_term_list("topics", "keywords"), " ").alias("q"))
    vectors = query_vectors(joined, "question", "q", vocabulary, name="id"), weights.withColumnRenamed(page_key, "page")
    best = best_by_blocks(pages.count(), top, least, (asked, per_term), vectors, listed=True)
    return with_snippets(best, pages, page_key).select("question", "page", "rank", "score", "matched", "snippet")

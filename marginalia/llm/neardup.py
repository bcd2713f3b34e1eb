"""Near-duplicate records: a byte-position index with count filtering, then exact verification.

A record's set of word triples is reduced to ``POSITIONS`` minhash bytes. An inverted index over groups of ``GROUP``
positional bytes brings together records that agree on all bytes of a group, and the groups they share are tallied per
pair. For pairs that share ``SHARED`` groups all positional bytes are compared; those that reach the number of matches
guaranteed (but for one in a million) at the least similarity are kept, and these are verified on the triples themselves.
Records with equal sets of triples are one class: a representative takes part in the search and the class is expanded in
the result.

A pair meets fewer than ``SHARED`` groups with probability 7.5e-5 at 0.6 and 5e-6 at 0.65, and never in 400,000 trials at
0.7 (simulated with the groups used); all else is exact. The index is joined by shuffle with AQE's splitting of hot keys;
nothing is collected. In a group of m similar, unequal records every pair is a link, so work grows with the links.

Edge cases: null titles and texts count as empty; records with too few words take no part; repeated rows are one record.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .boilerplate import line_chances, line_model, slices
from .residue import LEAST, notice_models, page_score, suspicious, verdict

#: Minhash bytes of a record, bytes and number of groups, and groups that a pair must share.
POSITIONS, GROUP, GROUPS, SHARED = 128, 4, 144, 2
#: Words of main text that a page needs to take part.
LEAST_WORDS = 40
_WORD = re.compile(r"[^\W_]+")
_RND = np.random.default_rng(17)
_MUL = (_RND.integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _RND.integers(0, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32)
_PLACES = np.stack([_RND.permutation(POSITIONS)[:GROUP] for _ in range(GROUPS)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def guaranteed_matches(similarity: float, risk: float = 1e-6) -> int:
    """Most matches m such that a pair of this similarity has fewer than m with probability at most ``risk``."""
    p = similarity + (1 - similarity) / 256
    below = 0.0
    for m in range(POSITIONS + 1):
        below += math.comb(POSITIONS, m) * p**m * (1 - p) ** (POSITIONS - m)
        if below > risk:
            return m
    return POSITIONS


class Triples:
    """Hashes of word triples, with a memo of word hashes."""

    def __init__(self, memo: int = 500_000) -> None:
        self.words: dict[str, int] = {}
        self.memo = memo

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of distinct triples of each text, their 64-bit hashes end to end, ascending within a text)."""
        return self.of_words([_WORD.findall(t.lower()) for t in texts])

    def of_words(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts given as their words in lower case."""
        known = self.words
        if len(known) > self.memo:
            known.clear()
        flat: list[int] = []
        lens = np.zeros(len(texts), np.int64)
        for i, words in enumerate(texts):
            lens[i] = len(words)
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            flat += map(known.__getitem__, words)
        h = np.array(flat, np.uint64)
        owner = np.repeat(np.arange(len(texts)), lens)
        if len(h) < 3:
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            t = (h[:-2] * _MIX ^ (h[1:-1] >> np.uint64(7))) * _MIX + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h[2:] * np.uint64(0x165667B19E3779F9))
            t = (t ^ (t >> np.uint64(29))) * _MIX
        inside = owner[:-2] == owner[2:]
        t, owner = t[inside], owner[:-2][inside]
        order = np.lexsort((t, owner))
        t, owner = t[order], owner[order]
        first = np.r_[True, (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])] if len(t) else np.zeros(0, bool)
        t, owner = t[first], owner[first]
        return np.bincount(owner, minlength=len(texts)).astype(np.int64), t


def signatures(lens: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """(texts, POSITIONS) minhash bytes; rows of texts without triples are zero."""
    out = np.zeros((len(lens), POSITIONS), np.uint8)
    some = np.flatnonzero(lens)
    if not len(some):
        return out
    first = np.r_[0, np.cumsum(lens[some])[:-1]]
    low = (triples >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for k in range(POSITIONS):
            v = low * _MUL[k] + _ADD[k]
            v ^= v >> np.uint32(15)
            least = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), first)
            out[some, k] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, GROUPS) index keys: the number of the group followed by its positional bytes."""
    key = np.broadcast_to(np.arange(GROUPS, dtype=np.int64), (len(sig), GROUPS)).copy()
    for j in range(GROUP):
        key = key << 8 | sig[:, _PLACES[:, j]]
    return key


def _records(batch: pa.RecordBatch, models, memo: dict, judge: bool = True) -> tuple[list[int], list[list[str]]]:
    """(row numbers, words of title and main text) of the pages of a batch that take part; all pages, if they are known to."""
    lines_m, (notices, fillers), score = models
    titles, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    said: dict[str, list[str]] = {}
    lines_of, chances_of = line_chances(texts, lines_m, memo, suspicious(fillers) if judge else (), said)
    keep, out = [], []

    def words_of(title: str | None, main: list[str]) -> list[str]:
        words = _WORD.findall((title or "").lower())
        for l in main:
            known = said.get(l)
            words += _WORD.findall(l.lower()) if known is None else known
        return words

    for i, (title, lines, chances) in enumerate(zip(titles, lines_of, chances_of, strict=True)):
        main, sure = [], []
        for l, c in zip(lines, chances.tolist(), strict=True):
            if abs(c) > 0.5:
                main.append(l)
                sure.append(c)
        body = "\n".join(main)
        if not judge:
            keep.append(i)
            out.append(words_of(title, main))
            continue
        if len(body) < 2 * LEAST_WORDS - 1 or body.count(" ") < 2 * LEAST_WORDS and len(_WORD.findall(body)) < LEAST_WORDS:
            continue
        reason, odds, words = verdict(title, main, sure, notices, fillers, score, alone=True, said=said)
        if reason in ("placeholder", "filler") or reason == "notice" and score.chances([odds], [words], [(False,) * 4], [0.0])[0] >= LEAST:
            continue
        keep.append(i)
        out.append(words_of(title, main))
    return keep, out


def _models():
    return line_model(), notice_models(), page_score()


def _set_ids(lens: np.ndarray, triples: np.ndarray) -> list[int]:
    ends = np.cumsum(lens).tolist()
    return [xxhash.xxh64_intdigest(triples[e - n : e].tobytes()) - (1 << 63) for e, n in zip(ends, lens.tolist(), strict=True)]


def page_signatures(pages: DataFrame) -> DataFrame:
    """(page_id, n_triples INT, set_id BIGINT, sig BINARY) of pages that take part; of a repeated id the least set."""
    models = _models()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 20, 20)  # the memos hold no cycles, so looking for them often is wasted
        memo, triples = {}, Triples()
        for batch in slices(batches):
            rows, texts = _records(batch, models, memo)
            lens, t = triples.of_words(texts)
            sig = signatures(lens, t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lens, pa.int32()), pa.array(_set_ids(lens, t), pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["page_id", "n_triples", "set_id", "sig"])

    found = pages.select("page_id", "title", "relevant_content").mapInArrow(run, "page_id bigint, n_triples int, set_id bigint, sig binary")
    return found.groupBy("page_id").agg(F.min(F.struct("set_id", "n_triples", "sig")).alias("x")).select("page_id", "x.n_triples", "x.set_id", "x.sig")


def candidate_pairs(reps: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of representatives whose positional bytes match as often as the similarity guarantees."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, POSITIONS)
            keys = index_keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), GROUPS))], names=["key", "id"])

    least = guaranteed_matches(similarity)

    def filter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, POSITIONS) for k in (2, 3))
            ok = (x == y).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])

    index = reps.select("page_id", "sig").mapInArrow(post, "key bigint, id bigint")
    met = index.alias("x").join(index.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED).select("a", "b")
    sig = reps.select("page_id", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(filter_counts, "a bigint, b bigint")


def near_duplicates(pages: DataFrame, similarity: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """((a, b, similarity DOUBLE) of verified pairs of representatives, (page_id, rep) of all pages that take part)."""
    docs = cut(page_signatures(pages))
    classes = docs.groupBy("set_id", "n_triples").agg(F.min("page_id").alias("rep"))
    members = cut(docs.join(classes, ["set_id", "n_triples"]).select("page_id", "rep", "set_id", "sig"))
    reps = members.filter(F.col("page_id") == F.col("rep"))
    pairs = cut(candidate_pairs(reps, similarity))
    wanted = pairs.select(F.col("a").alias("page_id")).union(pairs.select("b")).distinct().join(reps.select("page_id", "set_id"), "page_id")
    models = _models()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, triples = {}, Triples()
        for batch in slices(batches):
            rows, texts = _records(batch, models, memo, judge=False)
            lens, t = triples.of_words(texts)
            ends = np.cumsum(lens).tolist()
            chosen = batch.column(3).to_pylist()
            same = [k for k, (r, i) in enumerate(zip(rows, _set_ids(lens, t), strict=True)) if chosen[r] == i]  # the version of a repeated id that was signed
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([rows[k] for k in same], pa.int64())), pa.array([t[ends[k] - lens[k] : ends[k]].tobytes() for k in same], pa.binary())], names=["page_id", "t"])

    texts = pages.select("page_id", "title", "relevant_content").join(wanted, "page_id").select("page_id", "title", "relevant_content", "set_id")
    triples = cut(texts.mapInArrow(sets, "page_id bigint, t binary").dropDuplicates(["page_id"]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            score = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(p, q, assume_unique=True))
                score.append(n / max(1, len(p) + len(q) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    both = pairs.join(triples.toDF("a", "ta"), "a").join(triples.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(verify, "a bigint, b bigint, similarity double").filter(F.col("similarity") >= similarity), members.select("page_id", "rep")


def p5_links(spark, sf_dir: str) -> DataFrame:
    """Every page that takes part with its class (pages of equal triples) and that class's number of links to others."""
    pairs, members = near_duplicates(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select("page_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of pages that share at least 60 % of the distinct word triples found in either."""
    pairs, members = near_duplicates(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    links = pairs.select("a", "b")
    across = links.join(members.toDF("p", "a"), "a").join(members.toDF("q", "b"), "b").select("p", "q")
    within = members.toDF("p", "rep").join(members.toDF("q", "rep"), "rep").filter("p < q").select("p", "q")
    both = across.unionByName(within)
    return both.select(F.least("p", "q").alias("page_a"), F.greatest("p", "q").alias("page_b")).distinct()

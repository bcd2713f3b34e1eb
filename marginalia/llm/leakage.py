"""Evaluation texts within training texts: CGK embedding, bit-sampling LSH, exact edit verification.

Texts become sequences of words (letter case, accents, vowel marks, punctuation, line breaks and HTML tags disregarded).
Each window of ``window`` words of an item is embedded by CGK random walks, which carry edit distance over to Hamming
distance; in each repetition some places of the embedding are sampled into a key. Windows of documents in which all but
``edits`` words occur in some item are embedded likewise; equal keys give candidates, and an exact edit distance decides.
Equal windows have equal embeddings, so verbatim passages are always found; the repetitions serve the edited ones.

Documents are read once, whatever the number of items. Two bit maps of ``FILTER_BITS`` bits each (words and keys of the
items, hashed) go to all tasks; they bound what is sent and only keep windows from the shuffle that cannot match. What
passes meets the items in a shuffled join on the key, so neither items nor documents are gathered anywhere.

Edge cases: null and empty texts have no windows; items shorter than a window cannot be found; repeated rows and equal
items give one row for each pair of ids.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .boilerplate import slices

#: Bits of each map (8 MB); with many more items than fit, more windows pass and are rejected by the join.
FILTER_BITS = 1 << 26
#: Repetitions and sampled places: windows one word edit apart share a key with probability 0.97 (measured).
REPEATS, SAMPLED = 10, 8
_BREAK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6])\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
#: Words with their combining marks (Latin accents, Arabic vowel signs and the like).
_RAW = re.compile(r"[\w\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e8]+")
_PLAIN = re.compile(r"[^\W_]+")
MEMO = 500_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def fold(word: str) -> list[str]:
    """Words of a raw word without accents, vowel marks and case."""
    if word.isascii() and "_" not in word:
        return [word.lower()]
    bare = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return _PLAIN.findall(bare.casefold())


def raw_words(text: str) -> list[str]:
    """Words of a text, tags removed, marks and case still on."""
    if "<" in text:
        text = _TAG.sub("", _BREAK_TAG.sub(" ", text))
    return _RAW.findall(text)


def words(text: str | None) -> list[str]:
    """Folded words of a text."""
    return [f for w in raw_words(text or "") for f in fold(w)]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _C2
        return x ^ (x >> np.uint64(29))


def cgk(windows: np.ndarray, walk: int) -> np.ndarray:
    """(rows, 3 * width) CGK embedding of rows of word ids; ``walk`` selects the random functions."""
    rows, width = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), windows.dtype)], 1).astype(np.uint64)
    at, out, every = np.zeros(rows, np.int64), np.empty((rows, 3 * width), np.uint64), np.arange(rows)
    with np.errstate(over="ignore"):
        for step in range(3 * width):
            symbol = padded[every, at]
            out[:, step] = symbol
            bit = _mix((symbol + np.uint64(1)) * _C1 + np.uint64(walk * 1009 + step + 1) * _C2) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), width)
    return out


def lsh_keys(windows: np.ndarray, repeats: int = REPEATS) -> np.ndarray:
    """(rows, ``repeats``) keys: sampled places of one embedding in each repetition."""
    rnd = np.random.default_rng(29)
    out = np.empty((len(windows), repeats), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(repeats):
            places = np.sort(rnd.permutation(3 * windows.shape[1])[:SAMPLED])
            key = np.full(len(windows), r + 1, np.uint64)
            for column in cgk(windows, r)[:, places].T:
                key = _mix((key ^ column) * _C1 + column)
            out[:, r] = key
    return out


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit distance (words) of each row of ``x`` to that of ``y``, all rows at once."""
    width = x.shape[1]
    last = np.tile(np.arange(width + 1), (len(x), 1))
    for i in range(width):
        row = np.empty_like(last)
        row[:, 0] = i + 1
        for j in range(width):
            row[:, j + 1] = np.minimum(np.minimum(row[:, j], last[:, j + 1]) + 1, last[:, j] + (x[:, i] != y[:, j]))
        last = row
    return last[:, -1]


def nearly_aligned(x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    """Rows that can be within ``edits``: all but so many words of ``x`` stand in ``y`` at most ``edits`` places away."""
    width = x.shape[1]
    hit = x == y
    for k in range(1, edits + 1):
        hit[:, k:] |= x[:, k:] == y[:, : width - k]
        hit[:, : width - k] |= x[:, : width - k] == y[:, k:]
    return hit.sum(1) >= width - edits


class Words:
    """64-bit hashes of the folded words of texts, with a memo that is emptied when full."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words end to end, end of each text)."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        flat: list[int] = []
        ends = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for w in raw_words(t) if t else ():
                k = self.memo.get(w)
                if k is None:
                    k = self.memo[w] = tuple(xxhash.xxh64_intdigest(f) for f in fold(w))
                flat += k
            ends[i] = len(flat)
        return np.array(flat, np.uint64), ends


def window_starts(ends: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of every window that lies within one text."""
    start = np.arange(max(0, size - window + 1))
    text = np.searchsorted(ends, start, side="right")
    inside = start + window <= ends[np.minimum(text, len(ends) - 1)] if len(ends) else np.zeros(0, bool)
    return start[inside], text[inside]


def _windows(items: DataFrame, item_key: str, item_texts: list[str], window: int) -> DataFrame:
    """(item, w BINARY): the distinct windows of each item, as hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Words()
        for batch in slices(batches, 4000):
            for c in range(1, batch.num_columns):
                ids, ends = read.of(batch.column(c).to_pylist())
                start, text = window_starts(ends, len(ids), window)
                rows = ids[start[:, None] + np.arange(window)] if len(start) else np.zeros((0, window), np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["item", "w"])

    return items.select(F.col(item_key).cast("bigint").alias("item"), *item_texts).mapInArrow(run, "item bigint, w binary").distinct()


def _matrix(column: pa.Array, window: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, window)


def _keyed(windows: DataFrame, window: int, repeats: int) -> DataFrame:
    """(key, item, w): every window of the items under each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            keys = lsh_keys(_matrix(batch.column(1), window), repeats)
            at = pa.array(np.repeat(np.arange(batch.num_rows), repeats))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "item", "w"])

    return windows.mapInArrow(run, "key bigint, item bigint, w binary")


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Which of ``FILTER_BITS`` places the hashes (one BIGINT column) take; at most that many bits reach the driver."""
    chunk = 1 << 15
    places = hashes.toDF("h").select(F.col("h").bitwiseAND(FILTER_BITS - 1).alias("p")).distinct()
    packed = places.groupBy(F.shiftright("p", 15).alias("chunk")).agg(F.collect_set(F.col("p").bitwiseAND(chunk - 1).cast("int")).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for bits in batch.column(1).to_pylist():
                flags = np.zeros(chunk, bool)
                flags[bits] = True
                maps.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["chunk", "map"])

    out = np.zeros(FILTER_BITS // 8, np.uint8).reshape(-1, chunk // 8)
    for row in packed.mapInArrow(pack, "chunk bigint, map binary").toLocalIterator():
        out[row["chunk"]] = np.frombuffer(row["map"], np.uint8)
    return out.ravel()


def taken(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes fall on a taken place."""
    p = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)


def leaked_items(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_texts: list[str], window: int = 12, edits: int = 1) -> DataFrame:
    """(key, item id, distance INT, windows INT, first_word INT) of each pair with a window within ``edits`` word edits.

    ``windows`` counts the places of the document that match, ``first_word`` (from 0) is the first. ``edits`` is 0 or 1:
    the recall of the repetitions is known for these.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    repeats = REPEATS if edits else 1  # equal windows share every key
    windows = cut(_windows(items, item_key, item_texts, window))
    index = cut(_keyed(windows, window, repeats))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_matrix(batch.column(1), window)).view(np.int64))], names=["h"])

    words_map = bit_map(windows.mapInArrow(words_of, "h bigint"))
    keys_map = bit_map(index.select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Words()
        for batch in slices(batches, 4000):
            ids, ends = read.of(batch.column(1).to_pylist())
            known = np.cumsum(np.r_[0, taken(words_map, ids)])
            start = np.flatnonzero(known[window:] - known[:-window] >= window - edits) if len(ids) >= window else np.zeros(0, np.int64)
            doc = np.searchsorted(ends, start, side="right")
            inside = start + window <= ends[np.minimum(doc, len(ends) - 1)]
            start, doc = start[inside], doc[inside]
            rows = ids[start[:, None] + np.arange(window)] if len(start) else np.zeros((0, window), np.uint64)
            keys = lsh_keys(rows, repeats).ravel()
            hit = np.flatnonzero(taken(keys_map, keys))
            at = hit // repeats
            first = np.r_[0, ends[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), batch.column(0).take(pa.array(doc[at])), pa.array((start - first[doc])[at].astype(np.int32)), pa.array([rows[i].tobytes() for i in at.tolist()], pa.binary())], names=["key", "doc", "place", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8000):
            x, y = _matrix(batch.column(3), window), _matrix(batch.column(4), window)
            close = np.flatnonzero(nearly_aligned(x, y, edits))
            distance = edit_distances(x[close], y[close])
            ok = distance <= edits
            at = pa.array(close[ok])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 1, 2)), pa.array(distance[ok].astype(np.int32))], names=["doc", "item", "place", "distance"])

    probes = documents.select(F.col(key).cast("bigint").alias("doc"), text).mapInArrow(run, "key bigint, doc bigint, place int, v binary")
    pairs = probes.join(index, "key").select("doc", "item", "place", "v", "w")
    found = pairs.mapInArrow(verify, "doc bigint, item bigint, place int, distance int").groupBy("doc", "item", "place").agg(F.min("distance").alias("distance"))
    best = found.groupBy("doc", "item").agg(F.min("distance").alias("distance"), F.count("*").cast("int").alias("windows"), F.min("place").alias("first_word"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), "distance", "windows", "first_word")


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an item's question or passage."""
    documents, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "eval_items"))
    found = leaked_items(documents, items, "doc_id", "text", "item_id", ["question", "passage"], edits=0)
    return found.select("doc_id", "item_id").distinct()


def p9_near(spark, sf_dir: str) -> DataFrame:
    """The same with up to one edited word in the window, with the least distance."""
    documents, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "eval_items"))
    return leaked_items(documents, items, "doc_id", "text", "item_id", ["question", "passage"])

"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities.

Sizes are tokens of a public tokenizer. Texts beyond the capacity are cut into full pieces and a rest; nothing else is
split. Items are dealt at random (by hash) to shards of about ``SHARD_ITEMS``, each packed on its own in logarithmic
time per item, so the loss against one global packing is at most a few open containers per shard.

Edge cases: null and empty texts have no tokens and no place; equal texts are separate items; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .boilerplate import slices

SHARD_ITEMS = 20_000
#: Vocabulary file and the pattern that belongs to it; both are parameters of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The tokenizer, loaded once in a process."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class OpenBins:
    """Open bins by remaining capacity; a segment tree finds the tightest that still fits."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, bin_no: int) -> None:
        self.bins[remaining].append(bin_no)
        self._count(remaining, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(remaining, bin) of the bin with the least remaining capacity of at least ``size``; it is taken out."""
        at, tree = size + self.leaves, self.tree
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        remaining = at - self.leaves
        self._count(remaining, -1)
        return remaining, self.bins[remaining].pop()

    def _count(self, remaining: int, by: int) -> None:
        at = remaining + self.leaves
        while at:
            self.tree[at] += by
            at >>= 1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of every item; items are placed from the largest down, ties in the given order."""
    bins, n, out = OpenBins(capacity), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = bins.take(sizes[i])
        if fit is None:
            remaining, b = capacity, n
            n += 1
        else:
            remaining, b = fit
        out[i] = b
        bins.add(remaining - sizes[i], b)
    return out


def token_items(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, part INT from 1, first_token INT from 0, n_tokens INT): each text, or its parts if beyond the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        for batch in slices(batches, 4000):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(enc.encode_ordinary(t)) if t else 0
                rows += [(i, p + 1, p * capacity, min(capacity, n - p * capacity)) for p in range(-(-n // capacity))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=[key, "part", "first_token", "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` bigint, part int, first_token int, n_tokens int")


def fill_containers(df: DataFrame, key: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(container BIGINT, key, part, first_token, n_tokens): the container of every text or part."""
    items = cut(token_items(df, key, text, capacity, vocabulary, pattern))
    shards = max(1, round(items.count() / SHARD_ITEMS))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "part"], kind="stable")
        shard = int(group["shard"].iloc[0])
        group["container"] = [b * shards + shard for b in best_fit_decreasing(group["n_tokens"].tolist(), capacity)]
        return group[["container", key, "part", "first_token", "n_tokens"]]

    dealt = items.withColumn("shard", F.pmod(F.xxhash64(key, "part"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(place, f"container bigint, `{key}` bigint, part int, first_token int, n_tokens int")


def p8_containers(spark, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens for all documents."""
    return fill_containers(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def p8_checks(spark, sf_dir: str) -> DataFrame:
    """One row: texts in containers, containers beyond the capacity, texts split without need, and whether room is short.

    Room is short if there are at most 1 % more containers than all tokens need.
    """
    filled = cut(p8_containers(spark, sf_dir))
    texts = filled.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n")).agg(F.count("*").alias("n_texts"), F.count_if(F.col("parts") != F.ceil(F.col("n") / 2048)).alias("n_needless_splits"))
    bins = filled.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("n_over_full"), (F.count("*") <= F.ceil(F.sum("n") / 2048) * 1.01 + 1).alias("is_tight"))
    return texts.crossJoin(F.broadcast(bins))  # one row each


P8_CHECKS_SQL = "SELECT count(DISTINCT doc_id) AS n_texts, 0 AS n_needless_splits, 0 AS n_over_full, true AS is_tight FROM documents WHERE length(text) > 0"

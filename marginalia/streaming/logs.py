"""Streaming forms of the log operators: windowed counts with late data, and TTL hits with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_requests(log: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Requests, successes and tokens per model and window; rows later than ``late`` are dropped.

    Repeated deliveries of a ``seq`` count once within the watermark.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])
    return timed.groupBy(F.window("ts", width), "model").agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "model", "n", "n_ok", "tokens")


def ttl_hits(accesses: DataFrame, default_ttl: int = 3600) -> DataFrame:
    """(cache_key, seq, hit): hit iff within the time to live of the key's last miss, in order within each micro-batch.

    State per key is the instant up to which its entry lives.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "seq"])
            hits = []
            for t, ttl in zip(pdf["ts"], pdf["ttl"], strict=True):
                now = t.timestamp()
                hit = until is not None and now <= until
                if not hit:
                    life = default_ttl if ttl is None or ttl != ttl else ttl
                    until = now + life if life > 0 else float("inf")
                hits.append(hit)
            yield pd.DataFrame({"cache_key": key[0], "seq": pdf["seq"], "hit": hits})
        if until is not None:
            state.update((until,))

    timed = accesses.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("cache_key").applyInPandasWithState(step, "cache_key string, seq long, hit boolean", "until double", "append", GroupStateTimeout.NoTimeout)

"""Running sums and maxima over long ordered logs, in blocks, so that no key's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, key: str, order: str, values: dict[str, tuple[str, Column]], block: int = 50_000) -> DataFrame:
    """``df`` with running values by ``key`` in the order of an integer column, the current row included.

    ``values`` maps a name to (``sum`` or ``max``, column). Rows are split by key and block of the order column; each
    block runs its own window, the blocks' totals (one row per key and block) are accumulated and added.
    """
    fn = {"sum": F.sum, "max": F.max}
    rows = df.withColumn("__block", F.floor(F.col(order) / block)).withColumns({f"__{n}": c for n, (_, c) in values.items()})
    totals = rows.groupBy(key, "__block").agg(*[fn[k](f"__{n}").alias(f"__t_{n}") for n, (k, _) in values.items()])
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(key, "__block", *[fn[k](f"__t_{n}").over(before).alias(f"__c_{n}") for n, (k, _) in values.items()])
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__w_{n}": fn[k](f"__{n}").over(inside) for n, (k, _) in values.items()}).join(carry, [key, "__block"])
    both = {n: F.coalesce(F.col(f"__c_{n}") + F.col(f"__w_{n}"), f"__w_{n}", f"__c_{n}") if k == "sum" else F.greatest(f"__c_{n}", f"__w_{n}") if dict(rows.dtypes)[f"__w_{n}"][:6] != "struct" else F.coalesce(F.array_max(F.array_compact(F.array(f"__c_{n}", f"__w_{n}")))) for n, (k, _) in values.items()}
    return rows.withColumns(both).drop("__block", *[f"__{p}{n}" for n in values for p in ("", "w_", "c_")])


def request_metrics(log: DataFrame, block: int = 50_000) -> DataFrame:
    """Per request in order of ``seq``: running mean of response times over successes (whole microseconds, exact), consecutive failures since the
    last success, last time of use and last error of its model."""
    ok = F.coalesce("success", F.lit(False))
    log = log.withColumn("__ok", ok.cast("int"))
    sums = running(log, "model", "seq", {
        "n_ok": ("sum", F.col("__ok")), "n_failed": ("sum", 1 - F.col("__ok")), "t_ok": ("sum", F.when(ok, F.round(F.coalesce("response_time", F.lit(0.0)) * 1_000_000).cast("bigint")).otherwise(F.lit(0).cast("bigint"))), "last_used": ("max", F.when(ok, F.col("ts"))),
        "last_failure": ("max", F.when(~ok, F.struct("seq", "error"))),
    }, block)
    # failures up to the last success; it only grows, so a running maximum carries it
    done = running(sums, "model", "seq", {"settled": ("max", F.when(F.col("__ok") == 1, F.col("n_failed")))}, block)
    return done.select(
        "seq", "model", F.when(F.col("n_ok") > 0, F.expr("t_ok div n_ok")).alias("mean_micros"), (F.col("n_failed") - F.coalesce("settled", F.lit(0))).alias("failures"), "last_used", F.col("last_failure.error").alias("last_error"), F.col("n_ok").alias("successes"),
    )

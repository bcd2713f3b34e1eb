"""Queries over cache accesses and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import caches, running
from ..operators.questions import fallback_answer
from ..session import table


def _accesses(spark, d):
    return table(spark, d, "cache_access").distinct()


def _requests(spark, d):
    return table(spark, d, "request_log").distinct()


def cache_expiry(spark, d):
    """Entries that have expired at the end of the trace."""
    a = _accesses(spark, d)
    now = a.agg(F.max("ts").alias("now")).first()["now"]
    return a.filter(caches.expired(F.col("ts"), F.col("ttl"), F.lit(now).cast("timestamp_ntz"))).select("seq", "cache_key", "category")


def cache_statistics(spark, d):
    a = _accesses(spark, d)
    return a.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("cache_key").alias("n_keys"), F.sum("size_bytes").alias("n_bytes"), F.round(F.sum("size_bytes") / 1048576.0, 2).alias("megabytes"), F.count_if(F.col("ttl").isNull()).alias("n_without_ttl"))


def ttl_hits(spark, d):
    return caches.ttl_replay(_accesses(spark, d)).select("seq", "hit")


def ttl_hit_rates(spark, d):
    hits = caches.ttl_replay(_accesses(spark, d)).select("seq", "hit").join(_accesses(spark, d).select("seq", "category"), "seq")
    return hits.groupBy("category").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hits"), F.round(F.count_if("hit") * 100.0 / F.count("*"), 2).alias("hit_rate"))


def lru_hits(spark, d):
    return caches.lru_replay(_accesses(spark, d).select("seq", "cache_key"), capacity=100, block=2000).select("seq", "hit")


def cache_replay(spark, d):
    """Outcome of every access to a cache of 100 entries with times to live."""
    return caches.cache_replay(_accesses(spark, d), capacity=100, block=2000).select("seq", "outcome")


def oldest_searches(spark, d):
    """The 20 oldest entries of the research cache (what trimming drops)."""
    first = _accesses(spark, d).filter("category = 'research'").groupBy("cache_key").agg(F.min("ts").alias("ts"))
    return first.orderBy("ts", "cache_key").limit(20)


def request_totals(spark, d):
    r = _requests(spark, d)
    return r.agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.round(F.count_if("success") / F.count("*"), 6).alias("success_rate"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.when(F.col("success"), F.col("response_time"))), 6).alias("mean_time"))


def requests_by_model(spark, d):
    r = _requests(spark, d)
    return r.groupBy("model").agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.round(F.count_if("success") / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"), F.round(F.avg(F.when(F.col("success"), F.col("response_time"))), 6).alias("mean_time"), F.max("ts").alias("last_seen"), F.count_distinct("provider").alias("n_providers"))


def requests_by_provider(spark, d):
    return _requests(spark, d).groupBy(F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def errors_by_kind(spark, d):
    """Errors by wording; the map of counts per model is built from one row per model and kind."""
    low = F.lower("error")
    kind = F.when(low.contains("rate limit"), "rate_limit").when(low.contains("timeout"), "timeout").when(low.contains("http"), "http").otherwise("other")
    counts = _requests(spark, d).filter("error is not null").groupBy("model", kind.alias("kind")).agg(F.count("*").alias("n"))
    return counts.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("m")).select("model", F.map_keys("m").alias("kinds"), F.map_values("m").alias("counts"))


def request_metrics(spark, d):
    m = running.request_metrics(_requests(spark, d), block=1000)
    return m.select("seq", "model", "mean_micros", "failures", "last_used", "last_error", "successes")


def retry_delays(spark, d):
    """Linear back-off of each request by the failures before it."""
    return running.request_metrics(_requests(spark, d)).filter("failures > 0").select("seq", F.least("failures", F.lit(3)).alias("attempt"), (F.least("failures", F.lit(3)) * 1.0).alias("delay"))


def fallback_answers(spark, d):
    """The answer that each failed request gives."""
    failed = _requests(spark, d).filter(~F.coalesce("success", F.lit(False)))
    return failed.select("seq", fallback_answer(F.col("error")).alias("answer"))


def log_times(spark, d):
    """Time of each request in ISO form, and the seconds since the first."""
    r = _requests(spark, d).filter("ts is not null")
    first = r.agg(F.min("ts").alias("first")).first()["first"]
    elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))
    return r.select("seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.round(elapsed / 1_000_000, 3).alias("elapsed"))


QUERIES = {f.__name__: f for f in (cache_expiry, cache_statistics, ttl_hits, ttl_hit_rates, lru_hits, cache_replay, oldest_searches, request_totals, requests_by_model, requests_by_provider, errors_by_kind, request_metrics, retry_delays, fallback_answers, log_times)}

_TTL = """WITH RECURSIVE a AS (SELECT DISTINCT seq, cache_key, ts, category, CASE WHEN coalesce(ttl, 3600) <= 0 THEN 1000000000 ELSE coalesce(ttl, 3600) END AS life FROM cache_access),
  r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts, seq) AS i FROM a),
  f AS (SELECT cache_key, seq, i, ts + to_seconds(life) AS until, false AS hit FROM r WHERE i = 1
    UNION ALL SELECT r.cache_key, r.seq, r.i, CASE WHEN r.ts <= f.until THEN f.until ELSE r.ts + to_seconds(r.life) END, r.ts <= f.until FROM f JOIN r ON r.cache_key = f.cache_key AND r.i = f.i + 1)"""
_METRICS = """WITH r AS (SELECT DISTINCT * FROM request_log), s AS (SELECT seq, model, success, ts, error, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER w AS ok, sum(CASE WHEN success THEN CAST(round(coalesce(response_time, 0) * 1000000) AS BIGINT) END) OVER w AS t, max(CASE WHEN success THEN ts END) OVER w AS last_used,
  arg_max(error, seq) FILTER (NOT coalesce(success, false)) OVER w AS last_error FROM r WINDOW w AS (PARTITION BY model ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, sum(CASE WHEN coalesce(success, false) THEN 0 ELSE 1 END) OVER (PARTITION BY model, ok ORDER BY seq ROWS UNBOUNDED PRECEDING) AS failures FROM s)"""
_FALLBACK = " ".join("WHEN contains(lower(coalesce(error, '')), '{}') THEN '{}'".format(part, answer.replace("'", "''")) for part, answer in fixed.FALLBACK_ANSWERS.items())
SQL = {
    "fallback_answers": "SELECT seq, CASE " + _FALLBACK + " ELSE '" + fixed.GENERAL_FALLBACK.replace("'", "''") + "' END AS answer FROM (SELECT DISTINCT * FROM request_log) WHERE NOT coalesce(success, false)",
    "log_times": "WITH r AS (SELECT DISTINCT * FROM request_log WHERE ts IS NOT NULL) SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM r)) / 1000000.0::DOUBLE, 3) AS elapsed FROM r",
    "cache_expiry": "WITH a AS (SELECT DISTINCT * FROM cache_access) SELECT seq, cache_key, category FROM a WHERE ttl > 0 AND (SELECT max(ts) FROM a) > ts + to_seconds(ttl)",
    "cache_statistics": "SELECT category, count(*) AS n, count(DISTINCT cache_key) AS n_keys, CAST(sum(size_bytes) AS BIGINT) AS n_bytes, round(sum(size_bytes) / 1048576.0, 2) AS megabytes, count(*) FILTER (ttl IS NULL) AS n_without_ttl FROM (SELECT DISTINCT * FROM cache_access) GROUP BY category",
    "ttl_hits": _TTL + " SELECT seq, hit FROM f",
    "ttl_hit_rates": _TTL + " SELECT r.category, count(*) AS n, count(*) FILTER (f.hit) AS n_hits, round(count(*) FILTER (f.hit) * 100.0 / count(*), 2) AS hit_rate FROM f JOIN r USING (cache_key, i) GROUP BY r.category",
    "lru_hits": """WITH a AS (SELECT DISTINCT seq, cache_key FROM cache_access), p AS (SELECT seq, cache_key, lag(seq) OVER (PARTITION BY cache_key ORDER BY seq) AS before FROM a)
      SELECT p.seq, p.before IS NOT NULL AND (SELECT count(DISTINCT q.cache_key) FROM a q WHERE q.seq > p.before AND q.seq < p.seq) < 100 AS hit FROM p""",
    "cache_replay": """WITH RECURSIVE a AS (SELECT DISTINCT seq, cache_key, ts, CASE WHEN coalesce(ttl, 3600) <= 0 THEN 1000000000 ELSE coalesce(ttl, 3600) END AS life FROM cache_access),
      o AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS pos FROM a), p AS (SELECT *, lag(pos) OVER (PARTITION BY cache_key ORDER BY pos) AS before FROM o),
      r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY pos) AS i, before IS NOT NULL AND (SELECT count(DISTINCT q.cache_key) FROM o q WHERE q.pos > p.before AND q.pos < p.pos) < 100 AS kept FROM p),
      f AS (SELECT cache_key, seq, i, ts + to_seconds(life) AS until, false AS hit, kept FROM r WHERE i = 1
        UNION ALL SELECT r.cache_key, r.seq, r.i, CASE WHEN r.kept AND r.ts <= f.until THEN f.until ELSE r.ts + to_seconds(r.life) END, r.kept AND r.ts <= f.until, r.kept FROM f JOIN r ON r.cache_key = f.cache_key AND r.i = f.i + 1)
      SELECT seq, CASE WHEN hit THEN 'hit' WHEN kept THEN 'expired' ELSE 'absent' END AS outcome FROM f""",
    "oldest_searches": "SELECT cache_key, min(ts) AS ts FROM cache_access WHERE category = 'research' GROUP BY cache_key ORDER BY ts, cache_key LIMIT 20",
    "request_totals": "SELECT count(*) AS n, count(*) FILTER (success) AS n_ok, round(count(*) FILTER (success) / count(*), 6) AS success_rate, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(CASE WHEN success THEN response_time END), 6) AS mean_time FROM (SELECT DISTINCT * FROM request_log)",
    "requests_by_model": "SELECT model, count(*) AS n, count(*) FILTER (success) AS n_ok, round(count(*) FILTER (success) / greatest(count(*), 1), 6) AS success_rate, round(avg(CASE WHEN success THEN response_time END), 6) AS mean_time, max(ts) AS last_seen, count(DISTINCT provider) AS n_providers FROM (SELECT DISTINCT * FROM request_log) GROUP BY model",
    "requests_by_provider": "SELECT coalesce(provider, 'unknown') AS provider, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT DISTINCT * FROM request_log) GROUP BY 1",
    "errors_by_kind": "WITH c AS (SELECT model, CASE WHEN contains(lower(error), 'rate limit') THEN 'rate_limit' WHEN contains(lower(error), 'timeout') THEN 'timeout' WHEN contains(lower(error), 'http') THEN 'http' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT DISTINCT * FROM request_log) WHERE error IS NOT NULL GROUP BY ALL) SELECT model, list(kind ORDER BY kind) AS kinds, list(n ORDER BY kind) AS counts FROM c GROUP BY model",
    "request_metrics": _METRICS + " SELECT seq, model, CAST(CASE WHEN ok > 0 THEN t // ok END AS BIGINT) AS mean_micros, CAST(failures AS BIGINT) AS failures, last_used, last_error, CAST(ok AS BIGINT) AS successes FROM g",
    "retry_delays": _METRICS + " SELECT seq, CAST(least(failures, 3) AS BIGINT) AS attempt, CAST(least(failures, 3) AS DOUBLE) AS delay FROM g WHERE failures > 0",
}

"""Reading and writing knowledge bases, dictionaries, stop words, caches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = (
    "content_id STRING, url STRING, title STRING, summary STRING, content STRING, search_text STRING, keywords ARRAY<STRING>, category STRING, images ARRAY<STRING>, internal_links ARRAY<STRING>, external_links ARRAY<STRING>, "
    "structured_content STRUCT<headings: ARRAY<STRUCT<level: INT, text: STRING>>, paragraphs: ARRAY<STRING>, lists: ARRAY<STRUCT<type: STRING, items: ARRAY<STRING>>>>, metrics STRUCT<word_count: BIGINT, char_count: BIGINT, title_word_count: BIGINT>, last_updated STRING"
)
RUN = "total_urls_found BIGINT, successful BIGINT, failed BIGINT, started STRING, finished STRING"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON files that hold either ``{"pages": [...], "metadata": ...}`` or a list of pages.

    The schema is declared, never inferred. A file that is no JSON, or has no pages, gives no rows.
    """
    whole = spark.read.schema(f"pages ARRAY<STRUCT<{_struct(PAGE)}>>, _corrupt STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    wrapped = whole.filter(F.col("pages").isNotNull()).select(F.inline("pages"))
    plain = spark.read.schema(PAGE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).filter("url IS NOT NULL OR title IS NOT NULL OR content_id IS NOT NULL")
    return wrapped.unionByName(plain)


def _struct(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.replace("STRUCT<", "STRUCT\x00").split(", "):
        part = part.replace("STRUCT\x00", "STRUCT<")
        out.append(part.replace(" ", ": ", 1) if not depth else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The run's metadata record of a knowledge-base file."""
    return spark.read.schema(f"metadata STRUCT<{_struct(RUN)}>").option("multiLine", True).json(path).filter("metadata IS NOT NULL").select("metadata.*")


def changed_since(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Names of files modified after a time stamp (the test for a reload)."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").filter(F.col("modificationTime") > F.to_timestamp(F.lit(since)))


def read_stopwords(spark: SparkSession, path: str, fallback: list[str]) -> DataFrame:
    """One word a line, trimmed, lower case, without blanks and repeats; ``fallback`` if there is no file."""
    try:
        words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()
        words.schema  # noqa: B018
        return words
    except Exception as e:  # Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([(w,) for w in dict.fromkeys(fallback)], "word string")


def write_pages(pages: DataFrame, path: str, by: str | None = None) -> None:
    """Pages as JSON lines; ``by`` gives each value of a column a folder of its own (one page per content id)."""
    writer = pages.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """A dictionary (category, keywords) as parquet, one sorted row per category."""
    dictionary.orderBy("category").write.mode("overwrite").parquet(path)


def write_dictionary_yaml(dictionary: DataFrame, path: str) -> None:
    """A dictionary (category, keywords) as YAML text, categories in order, keywords below them as they are listed.

    Every string is double-quoted, so no value is read as another type; files follow each other in the order of their
    names. A category without keywords gives an empty list.
    """
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\\\])', r"\\$1"), F.lit('"'))
    entries = F.transform("keywords", lambda k: F.concat(F.lit("- "), quoted(k)))
    lines = F.concat(quoted(F.col("category")), F.when(F.size("keywords") > 0, F.concat(F.lit(":\n"), F.array_join(entries, "\n"))).otherwise(F.lit(": []")))
    dictionary.orderBy("category").select(lines.alias("value")).write.mode("overwrite").text(path)


def write_cache_statistics(accesses: DataFrame, path: str) -> None:
    """Statistics of replayed accesses (cache_key, category, size_bytes, outcome) per category, as JSON lines: hits, misses,
    hit rate in per cent, keys and bytes; null sizes count nothing."""
    hits = F.count_if(F.col("outcome") == "hit")
    keys = accesses.groupBy("category", "cache_key").agg(hits.alias("hits"), F.count("*").alias("n"), F.max(F.coalesce("size_bytes", F.lit(0))).alias("size_bytes"))
    by = keys.groupBy("category").agg(F.sum("hits").alias("hits"), (F.sum("n") - F.sum("hits")).alias("misses"), F.round(F.sum("hits") * 100.0 / F.sum("n"), 2).alias("hit_rate"), F.count("*").alias("entries"), F.sum("size_bytes").alias("size_bytes"))
    by.write.mode("overwrite").json(path)


def write_cache(entries: DataFrame, path: str, persistent: list[str], now: str) -> None:
    """Entries of persistent categories that have not expired, as compressed JSON lines."""
    from ..operators.caches import expired

    kept = entries.filter(F.col("category").isin(*persistent) & ~expired(F.col("ts"), F.col("ttl"), F.to_timestamp_ntz(F.lit(now))))
    kept.write.mode("overwrite").option("compression", "gzip").json(path)


def read_cache(spark: SparkSession, path: str, schema: str, now: str) -> DataFrame:
    """Saved entries that are still alive."""
    from ..operators.caches import expired

    return spark.read.schema(schema).json(path).filter(~expired(F.col("ts"), F.col("ttl"), F.to_timestamp_ntz(F.lit(now))))


def write_report(pages: DataFrame, path: str) -> None:
    """A run's report: pages and words per category, as JSON lines."""
    pages.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("pages"), F.sum(F.size(F.split(F.coalesce("search_text", F.lit("")), r"\s+"))).alias("words")).write.mode("overwrite").json(path)

"""Analysis of questions: one narrow projection from text to type, topics, keywords, entities, scores and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def detected_language(text: Column, detector: Column | None = None) -> tuple[Column, Column]:
    """(language, confidence). Without a detector's column every text is English at 0.5.

    With one: texts under three words are English at 0.7, else 0.5 plus 0.05 a word up to 0.9, English gaining 0.05 for
    each common word up to 0.95; a null detection is English at 0.6.
    """
    if detector is None:
        return F.lit("en"), F.lit(0.5)
    n = T.word_count(text)
    base = F.least(F.lit(0.9), F.lit(0.5) + n * 0.05)
    hints = sum(F.when(F.lower(text).contains(w), 1).otherwise(0) for w in fixed.ENGLISH_HINTS)
    conf = F.when(detector == "en", F.least(F.lit(0.95), base + hints * 0.05)).otherwise(base)
    return F.when(n < 3, "en").otherwise(F.coalesce(detector, F.lit("en"))), F.when(n < 3, 0.7).when(detector.isNull(), 0.6).otherwise(conf)


def analyse(df: DataFrame, text: str, supported: tuple[str, ...] = ("en", "es", "fr", "de", "ar"), least_confidence: float = 0.6) -> DataFrame:
    """``df`` with columns of the analysis; invalid input keeps its message and has no further analysis."""
    raw = F.col(text)
    df = df.withColumn("input_error", T.input_error(raw)).withColumn("cleaned", F.when(F.col("input_error").isNull(), T.clean_question(raw)))
    c = F.col("cleaned")
    language, confidence = detected_language(c)
    none = c.isNull()
    df = df.withColumns({
        "language": F.when(~none, language), "language_confidence": F.when(~none, confidence), "keywords": F.when(~none, T.keywords(c)), "topics": F.when(~none, T.topics(c)), "entities": F.when(~none, T.entities(c)), "question_type": F.when(~none, T.question_type(c)),
        "word_count": F.when(~none, T.word_count(c)), "sentence_count": F.when(~none, T.dot_sentences(c)),
    })
    w, k, t = F.col("word_count"), F.size("keywords"), F.size("topics")
    df = df.withColumns({
        "complexity_score": F.when(~none, F.round(T.complexity(w, F.col("sentence_count"), k, t, F.col("question_type")), 6)), "confidence_score": F.when(~none, F.round(T.confidence(F.col("language_confidence"), w, k, t, F.col("question_type")), 6)),
    })
    valid = ~none & (F.col("confidence_score") >= least_confidence) & F.col("language").isin(*supported) & (k > 0)
    why = (
        F.when(~F.col("input_error").isNull(), F.col("input_error")).when(~F.col("language").isin(*supported), "Language is not supported")
        .when(k == 0, "No keywords found").when(F.col("confidence_score") < least_confidence, "Confidence too low")
    )
    return df.withColumn("is_valid", F.coalesce(valid, F.lit(False))).withColumn("error_message", why)


def message_error(text: Column) -> Column:
    """Rule of the message endpoint: not blank, at least 2 characters trimmed, at most 2000 untrimmed; null if fine."""
    t = T.strip(text)
    return F.when(text.isNull() | (t == ""), "Message is empty").when(F.length(t) < 2, "Message too short").when(F.length(text) > 2000, "Message too long")


def fallback_answer(error: Column, first: str | None = None) -> Column:
    """Answer when every model failed, by the error's wording; ``first`` replaces the general one. Null errors count as
    of no known wording."""
    low = F.lower(F.coalesce(error, F.lit("")))
    known = F
    for part, answer in fixed.FALLBACK_ANSWERS.items():
        known = known.when(low.contains(part), F.lit(answer))
    return known.otherwise(F.lit(first or fixed.GENERAL_FALLBACK))


def frequent_tokens(df: DataFrame, key: str, text: str, n: int = 20, least: int = 4, stopwords: list[str] = fixed.BASIC_STOPWORDS) -> DataFrame:
    """(key, rank INT, token, n BIGINT): the ``n`` most frequent letter tokens of each row, ties by first appearance.

    The arrays are exploded with positions, counted per row and token (partial aggregates first) and ranked per row.
    """
    from pyspark.sql import Window

    stop = F.array(*[F.lit(w) for w in stopwords])
    rows = df.select(key, F.posexplode(T.letter_tokens(F.col(text), least)).alias("pos", "token")).filter(~F.array_contains(stop, F.col("token")))
    counts = rows.groupBy(key, "token").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "pos"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).select(key, "rank", "token", "n")

"""Queries over messages and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import questions as Q
from ..session import table
from .text_plans import _STOP, arabic_sql, clean_sql, keywords_sql, strip_sql, tokens_sql, topics_sql, type_sql, words_sql


def input_validation(spark, d):
    m = table(spark, d, "user_messages")
    return m.select("message_id", Q.T.input_error(F.col("message")).alias("input_error"), Q.message_error(F.col("message")).alias("message_error"))


def question_analysis(spark, d):
    done = Q.analyse(table(spark, d, "user_messages").select("message_id", "message").distinct(), "message")
    return done.select("message_id", "cleaned", "language", "language_confidence", "topics", "keywords", "entities", "question_type", "word_count", "sentence_count", "complexity_score", "confidence_score", "is_valid", "error_message")


def question_type_counts(spark, d):
    done = Q.analyse(table(spark, d, "user_messages").select("message_id", "message").distinct(), "message")
    return done.groupBy("question_type", "is_valid").agg(F.count("*").alias("n"), F.round(F.avg("complexity_score"), 6).alias("mean_complexity"))


def question_languages(spark, d):
    """Language and confidence of every question by its frequent words (the tier with a detector)."""
    q = table(spark, d, "question_analysis").select("question_id", "original_question").distinct()
    language, confidence = Q.detected_language(F.col("original_question"), Q.T.guessed_language(F.col("original_question")))
    return q.select("question_id", language.alias("language"), F.round(confidence, 6).alias("confidence"))


def token_estimates(spark, d):
    """Words of question and cleaned question together (the estimate of tokens of a request)."""
    q = table(spark, d, "question_analysis").select("question_id", "original_question", "cleaned_question").distinct()
    return q.select("question_id", (Q.T.word_count(F.col("original_question")) + Q.T.word_count(F.col("cleaned_question"))).alias("tokens"))


def frequent_tokens(spark, d):
    return Q.frequent_tokens(table(spark, d, "documents"), "doc_id", "text")


def token_antijoin(spark, d):
    """Corpus counts of question tokens that are no stop words (anti-join form)."""
    stop = spark.createDataFrame([(w,) for w in fixed.STOPWORDS_EN], "token string")  # a fixed list, so the broadcast is bounded
    rows = table(spark, d, "question_analysis").select("question_id", F.explode(Q.T.tokens(F.col("original_question"))).alias("token")).filter(F.length("token") > 2)
    return rows.join(F.broadcast(stop), "token", "left_anti").groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("question_id").alias("n_questions"))


def recent_messages(spark, d):
    """The last 100 messages of every session, as a client keeps them."""
    from pyspark.sql import Window

    m = table(spark, d, "user_messages").filter("session_id is not null").select("session_id", "message_id", "received_at").distinct()
    w = Window.partitionBy("session_id").orderBy(F.desc("received_at"), F.desc("message_id"))
    return m.withColumn("rn", F.row_number().over(w)).filter("rn <= 100").groupBy("session_id").agg(F.count("*").alias("n_kept"), F.min("message_id").alias("oldest"), F.max("message_id").alias("newest"))


def language_lookup(spark, d):
    """Instruction language of each question's label, English where unknown (lookup with default)."""
    known = spark.createDataFrame([("en", "English"), ("es", "Spanish"), ("fr", "French"), ("de", "German"), ("ar", "Arabic")], "code string, instruction string")
    q = table(spark, d, "question_analysis").select("question_id", F.lower("language").alias("code")).distinct()
    return q.join(F.broadcast(known), "code", "left").select("question_id", F.coalesce("code", F.lit("en")).alias("code"), F.coalesce("instruction", F.lit("English")).alias("instruction")).distinct()


QUERIES = {f.__name__: f for f in (input_validation, question_analysis, question_type_counts, question_languages, token_estimates, frequent_tokens, token_antijoin, recent_messages, language_lookup)}

_T = strip_sql("message")
_MEANING = rf"""len(list_filter({words_sql(rf"regexp_replace(lower({_T}), '[^\p{{L}}\p{{N}}_\s]', '', 'g')")}, lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) > 0"""
_ERROR = rf"""CASE WHEN message IS NULL OR message = '' THEN 'Question must be a non-empty string' WHEN length({_T}) < 3 THEN 'Question too short (minimum 3 characters)' WHEN length({_T}) > 2000 THEN 'Question too long (maximum 2000 characters)'
  WHEN regexp_matches(lower({_T}), '{fixed.SUSPICIOUS}') THEN 'Question contains invalid content' WHEN NOT ({_MEANING}) THEN 'Question lacks meaningful content' END"""
_RUNS = r"regexp_extract_all(c, '[\p{L}\p{N}_]+')"
_ENTITIES = f"list_sort(list_distinct(list_concat(list_slice(list_filter({_RUNS}, lambda w: regexp_full_match(w, '[A-Z][a-z]+')), 1, 10), list_slice(list_filter({_RUNS}, lambda w: regexp_full_match(w, '[0-9]+')), 1, 5))))"
_ANALYSED = rf"""
  WITH m AS (SELECT message_id, message, {_ERROR} AS e FROM (SELECT DISTINCT message_id, message FROM user_messages)),
  c AS (SELECT message_id, e, CASE WHEN e IS NULL THEN {clean_sql('message')} END AS c FROM m),
  f AS (SELECT message_id, e, c, CASE WHEN c IS NOT NULL THEN {keywords_sql('c')} END AS keywords, CASE WHEN c IS NOT NULL THEN {topics_sql('c')} END AS topics, CASE WHEN c IS NOT NULL THEN {_ENTITIES} END AS entities, CASE WHEN c IS NOT NULL THEN {type_sql('c')} END AS question_type,
    CASE WHEN c IS NOT NULL THEN CAST(len({words_sql('c')}) AS BIGINT) END AS word_count, CASE WHEN c IS NOT NULL THEN CAST(len(list_filter(string_split(c, '.'), lambda p: {strip_sql('p')} <> '')) AS BIGINT) END AS sentence_count FROM c),
  s AS (SELECT *, round(least(1.0, least(1.0, word_count / 50) * 0.3::DOUBLE + least(1.0, sentence_count / 5) * 0.2::DOUBLE + least(1.0, len(keywords) / 10) * 0.2::DOUBLE + least(1.0, len(topics) / 3) * 0.15::DOUBLE + CASE WHEN question_type IN ('comparison', 'procedure', 'definition') THEN 0.15::DOUBLE ELSE 0 END), 6) AS complexity_score,
    round(greatest(0.0, least(1.0, 0.15::DOUBLE + CASE WHEN word_count >= 3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(keywords) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(topics) > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN question_type <> 'general' THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN word_count < 2 OR word_count > 100 THEN 0.1::DOUBLE ELSE 0 END)), 6) AS confidence_score FROM f)
"""
_WORDS_OF = {lang: ", ".join(f"'{w}'" for w in words) for lang, words in fixed.COMMON_WORDS.items()}
_GUESS = "list_max([" + ", ".join(f"{{'n': len(list_filter(ws, lambda w: w IN ({words}))), 'o': {-i}, 'lang': '{lang}'}}" for i, (lang, words) in enumerate(_WORDS_OF.items())) + "])"
_HINTS = " + ".join(f"CASE WHEN contains(lower(x), '{w}') THEN 1 ELSE 0 END" for w in fixed.ENGLISH_HINTS)
SQL = {
    "question_languages": f"""WITH q AS (SELECT DISTINCT question_id, original_question AS x FROM question_analysis), t AS (SELECT *, {tokens_sql('x')} AS ws, CAST(len({words_sql('x')}) AS BIGINT) AS n FROM q), g AS (SELECT *, {_GUESS} AS best FROM t),
      d AS (SELECT *, CASE WHEN x IS NULL THEN NULL WHEN {arabic_sql('x')} THEN 'ar' WHEN best.n > 0 THEN best.lang END AS found, least(0.9::DOUBLE, 0.5::DOUBLE + n * 0.05::DOUBLE) AS base, {_HINTS} AS hints FROM g)
      SELECT question_id, CASE WHEN n < 3 THEN 'en' ELSE coalesce(found, 'en') END AS language, round(CASE WHEN n < 3 THEN 0.7::DOUBLE WHEN found IS NULL THEN 0.6::DOUBLE WHEN found = 'en' THEN least(0.95::DOUBLE, base + hints * 0.05::DOUBLE) ELSE base END, 6) AS confidence FROM d""",
    "token_estimates": f"SELECT question_id, CAST(coalesce(len({words_sql('original_question')}), 0) + coalesce(len({words_sql('cleaned_question')}), 0) AS BIGINT) AS tokens FROM (SELECT DISTINCT question_id, original_question, cleaned_question FROM question_analysis)",
    "input_validation": f"SELECT message_id, {_ERROR} AS input_error, CASE WHEN message IS NULL OR {_T} = '' THEN 'Message is empty' WHEN length({_T}) < 2 THEN 'Message too short' WHEN length(message) > 2000 THEN 'Message too long' END AS message_error FROM user_messages",
    "question_analysis": _ANALYSED + """SELECT message_id, c AS cleaned, CASE WHEN c IS NOT NULL THEN 'en' END AS language, CASE WHEN c IS NOT NULL THEN 0.5::DOUBLE END AS language_confidence, topics, keywords, entities, question_type, word_count, sentence_count, CASE WHEN c IS NOT NULL THEN complexity_score END AS complexity_score, CASE WHEN c IS NOT NULL THEN confidence_score END AS confidence_score,
      c IS NOT NULL AND confidence_score >= 0.6 AND len(keywords) > 0 AS is_valid, CASE WHEN e IS NOT NULL THEN e WHEN len(keywords) = 0 THEN 'No keywords found' WHEN confidence_score < 0.6 THEN 'Confidence too low' END AS error_message FROM s""",
    "question_type_counts": _ANALYSED + "SELECT question_type, coalesce(c IS NOT NULL AND confidence_score >= 0.6 AND len(keywords) > 0, false) AS is_valid, count(*) AS n, round(avg(CASE WHEN c IS NOT NULL THEN complexity_score END), 6) AS mean_complexity FROM s GROUP BY ALL",
    "frequent_tokens": rf"""WITH t AS (SELECT doc_id, list_filter({tokens_sql('text')}, lambda w: regexp_full_match(w, '[a-z\x{{0600}}-\x{{06FF}}]{{4,15}}')) AS ts FROM documents), u AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM t),
      c AS (SELECT doc_id, token, count(*) AS n, min(pos) AS pos FROM u WHERE token NOT IN ({', '.join(f"'{w}'" for w in fixed.BASIC_STOPWORDS)}) GROUP BY doc_id, token), r AS (SELECT doc_id, token, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS INTEGER) AS rank FROM c) SELECT doc_id, rank, token, n FROM r WHERE rank <= 20""",
    "token_antijoin": f"WITH t AS (SELECT question_id, unnest({tokens_sql('original_question')}) AS token FROM question_analysis) SELECT token, count(*) AS n, count(DISTINCT question_id) AS n_questions FROM t WHERE length(token) > 2 AND token NOT IN ({_STOP}) GROUP BY token",
    "recent_messages": "WITH m AS (SELECT DISTINCT session_id, message_id, received_at FROM user_messages WHERE session_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY received_at DESC, message_id DESC) AS rn FROM m) SELECT session_id, count(*) AS n_kept, min(message_id) AS oldest, max(message_id) AS newest FROM r WHERE rn <= 100 GROUP BY session_id",
    "language_lookup": "SELECT DISTINCT question_id, coalesce(lower(language), 'en') AS code, CASE lower(language) WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'ar' THEN 'Arabic' ELSE 'English' END AS instruction FROM question_analysis",
}

"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import fixed
from ..functions import text as T
from ..session import table

_STOP = ", ".join(f"'{w}'" for w in fixed.STOPWORDS_EN)
_EDGE = r"[^\p{L}\p{N}_]"
AS_OF = "2025-01-01"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_sql(x: str) -> str:
    out = rf"regexp_replace(regexp_replace({strip_sql(x)}, '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s.,;:?!-]', '', 'g')"
    for short, full in fixed.ABBREVIATIONS:
        for _ in range(2):
            out = rf"regexp_replace({out}, '(^|{_EDGE}){short}($|{_EDGE})', '\1{full}\2', 'gi')"
    return out


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def words_sql(x: str) -> str:
    return rf"coalesce(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''), [])"


def any_word_sql(x: str, options: list[str]) -> str:
    return rf"regexp_matches(lower({x}), '(^|{_EDGE})({'|'.join(options)})($|{_EDGE})')"


def any_part_sql(x: str, options: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{o}')" for o in options) + ")"


def type_sql(x: str) -> str:
    cases = " ".join(f"WHEN {any_word_sql(x, o)} THEN '{k}'" for k, o in fixed.QUESTION_WORDS.items())
    return f"CASE {cases} WHEN suffix({strip_sql(x)}, '?') THEN 'interrogative' WHEN {any_part_sql(x, fixed.HELP_WORDS)} THEN 'help_request' WHEN {any_part_sql(x, fixed.EXPLAIN_WORDS)} THEN 'explanation' ELSE 'general' END"


def topics_sql(x: str) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN {any_part_sql(x, o)} THEN '{t}' END" for t, o in fixed.TOPIC_WORDS.items()) + "], lambda t: t IS NOT NULL)"
    other = " ".join(f"WHEN {any_part_sql(x, o)} THEN ['{n}']" for n, o in fixed.TOPIC_FALLBACKS)
    return f"CASE WHEN len({found}) > 0 THEN {found} {other} ELSE ['general'] END"


def distinct_sql(x: str) -> str:
    """Distinct entries in order of first appearance."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def keywords_sql(x: str, most: int = 20) -> str:
    t = f"list_filter({tokens_sql(x)}, lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"
    return f"list_slice({distinct_sql(t)}, 1, {most})"


def arabic_sql(x: str) -> str:
    cls = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
    letters = rf"length(regexp_replace({x}, '[^\p{{L}}_]', '', 'g'))"
    return rf"coalesce({letters} > 0 AND length({x}) - length(regexp_replace({x}, '[{cls}]', '', 'g')) > {letters} * 0.3, false)"


def messages(spark, d) -> DataFrame:
    return table(spark, d, "user_messages")


def question_cleaning(spark, d):
    return messages(spark, d).select("message_id", T.clean_question(F.col("message")).alias("cleaned"))


def text_tokens(spark, d):
    return messages(spark, d).select("message_id", T.tokens(F.col("message")).alias("tokens"), T.letter_tokens(F.col("message")).alias("letter_tokens"))


def text_counts(spark, d):
    m = F.col("message")
    return messages(spark, d).select(
        "message_id", T.word_count(m).alias("n_words"), F.length(m).cast("bigint").alias("n_chars"), T.count_of(F.lower(m), F.lit("the")).alias("n_the"), F.size(F.filter(T.sentence_parts(m), lambda p: T.strip(p) != "")).cast("bigint").alias("n_sentences"),
        T.dot_sentences(m).alias("n_dot_sentences"), F.size(F.split(m, "\n", -1)).cast("bigint").alias("n_lines"),
    ).filter("n_chars is not null")


def search_cleaning(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_for_search(F.col("text"))).alias("cleaned_md5"), F.md5(T.format_answer(F.col("text"))).alias("formatted_md5"), T.answer_error(F.col("text")).alias("answer_error"))


def script_detection(spark, d):
    t = F.col("relevant_content")
    return table(spark, d, "pages").select("page_id", T.script_language(t).alias("script_language"), T.is_arabic(F.col("title")).alias("title_is_arabic"), T.normalise_arabic(F.col("title")).alias("arabic_title"), F.filter(F.transform(F.regexp_extract_all("title", F.lit(r"[\x{0600}-\x{06FF}]+"), F.lit(0)), T.normalise_arabic), lambda w: F.length(w) > 2).alias("arabic_tokens"))


def hash_keys(spark, d):
    p = table(spark, d, "pages")
    return p.select(
        "page_id", F.md5("relevant_content").alias("text_md5"), A.hashed(F.col("relevant_content"), "sha256").alias("text_sha256"), A.content_id(F.col("url"), F.col("title"), AS_OF).alias("content_key"), A.question_key(F.col("title")).alias("title_key"),
        A.response_key(F.col("title"), F.col("summary")).alias("response_key"), A.generic_key(F.coalesce("category", F.lit("default")), F.col("url"), F.coalesce("title", F.lit(""))).alias("generic_key"), F.octet_length("relevant_content").cast("bigint").alias("n_bytes"),
    )


def search_keys(spark, d):
    return table(spark, d, "question_analysis").select("question_id", A.search_key(F.col("topics"), F.col("keywords")).alias("search_key"))


def url_parts(spark, d):
    s, u = F.col("source_url"), F.col("url")
    return table(spark, d, "pages").select(
        "page_id", A.is_page(s).alias("is_page"), A.bare_host(F.lower(s)).alias("bare_host"), (A.bare_host(F.lower(s)) == A.bare_host(F.lower(u))).alias("internal"), A.with_scheme(A.without_fragment(s)).alias("normal_url"), A.file_name_of(s).alias("file_name"),
        A.safe_file_name(F.concat(F.coalesce("title", F.lit("")), F.lit(".json"))).alias("title_file"), A.resolve(u, F.regexp_extract(u, r"^https?://[^/]*(/.*)$", 1)).alias("resolved"), A.keeps_link(s).alias("keeps_link"), A.keeps_image(s).alias("keeps_image"),
    )


def size_formats(spark, d):
    value, unit = T.byte_size(F.col("size_bytes"))
    return table(spark, d, "cache_access").select("seq", F.round(value, 6).alias("size_value"), F.when(F.col("size_bytes").isNotNull(), unit).alias("size_unit")).distinct()


def duration_formats(spark, d):
    x = T.duration(F.col("response_time"))
    return table(spark, d, "request_log").filter("response_time is not null").select("seq", x["form"].alias("form"), F.round(x["major"], 6).alias("major"), F.round(x["minor"], 6).alias("minor")).distinct()


def page_summaries(spark, d):
    return table(spark, d, "pages").select("page_id", T.summary(F.col("search_text")).alias("made_summary"))


def page_metrics(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.word_count(F.col("relevant_content")).alias("n_words"), F.coalesce(F.length("relevant_content"), F.lit(0)).cast("bigint").alias("n_chars"), T.word_count(F.col("title")).alias("n_title_words"), F.when(F.length("relevant_content") > 75000, F.concat(F.substring("relevant_content", 1, 75000), F.lit("..."))).otherwise(F.col("relevant_content")).alias("capped")).withColumn("capped", F.md5("capped"))


def arrays(spark, d):
    q = table(spark, d, "question_analysis")
    none = F.array().cast("array<string>")
    t, k, e = (F.coalesce(c, none) for c in ("topics", "keywords", "entities"))
    return q.select("question_id", F.array_union(t, k).alias("terms"), F.array_distinct(F.concat(e, k)).alias("distinct_terms"), F.slice(t, 1, 3).alias("first_topics"), F.array_sort(F.array_except(k, e)).alias("only_keywords"), F.array_sort(F.array_intersect(k, e)).alias("both"), F.exists(k, lambda x: x.contains("ing")).alias("has_ing"), F.aggregate(k, F.lit(0), lambda a, x: a + F.length(x)).cast("bigint").alias("keyword_chars"))


QUERIES = {f.__name__: f for f in (question_cleaning, text_tokens, text_counts, search_cleaning, script_detection, hash_keys, search_keys, url_parts, size_formats, duration_formats, page_summaries, page_metrics, arrays)}

_HOST = r"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = r"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_BARE = r"regexp_replace(" + _HOST + r", '^(.*?)www\.', '\1')"
_FILE = r"concat(coalesce(title, ''), '.json')"
_SAFE = rf"""regexp_replace(regexp_replace(regexp_replace({_FILE}, '[<>:"/\\|?*]', '_', 'g'), '[\x{{00}}-\x{{1f}}\x{{7f}}-\x{{9f}}]', '', 'g'), '^[ .]+|[ .]+$', '', 'g')"""
_SAMPLE = "CASE WHEN length({x}) > 2000 THEN concat(substring({x}, 1, 1000), substring({x}, length({x}) // 2 - 499, 1000)) ELSE substring({x}, 1, 1000) END"
_AR = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"
_NORM = r"regexp_replace(translate(regexp_replace({x}, '[\x{{064B}}-\x{{065F}}\x{{0670}}\x{{0640}}]', '', 'g'), 'إأآٱةيئڪھ', 'ااااهىىكه'), '[^\x{{0600}}-\x{{06FF}}]', '', 'g')"
_ANSWER_WORDS = words_sql(f"lower({strip_sql('text')})")
_FORMAT = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({strip_sql('text')}, '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '([.!?])\s*([A-Z])', '\1 \2', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g')"

SQL = {
    "question_cleaning": f"SELECT message_id, {clean_sql('message')} AS cleaned FROM user_messages",
    "text_tokens": rf"SELECT message_id, {tokens_sql('message')} AS tokens, list_filter({tokens_sql('message')}, lambda w: regexp_full_match(w, '[a-z\x{{0600}}-\x{{06FF}}]{{3,15}}')) AS letter_tokens FROM user_messages",
    "text_counts": rf"""SELECT message_id, CAST(len({words_sql('message')}) AS BIGINT) AS n_words, CAST(length(message) AS BIGINT) AS n_chars, CAST((length(message) - length(replace(lower(message), 'the', ''))) / 3 AS BIGINT) AS n_the,
      CAST(len(list_filter(string_split_regex(message, '[.!?]+'), lambda p: {strip_sql('p')} <> '')) AS BIGINT) AS n_sentences, CAST(len(list_filter(string_split(message, '.'), lambda p: {strip_sql('p')} <> '')) AS BIGINT) AS n_dot_sentences, CAST(len(string_split(message, chr(10))) AS BIGINT) AS n_lines
      FROM user_messages WHERE message IS NOT NULL""",
    "search_cleaning": rf"""SELECT doc_id, md5(regexp_replace(regexp_replace({strip_sql('text')}, '\s+', ' ', 'g'), '<[^>]+>', '', 'g')) AS cleaned_md5, md5({_FORMAT}) AS formatted_md5,
      CASE WHEN text IS NULL OR {strip_sql('text')} = '' THEN 'Empty response received' WHEN length({strip_sql('text')}) < 10 THEN 'Response too short (minimum 10 characters)' WHEN length({strip_sql('text')}) > 8000 THEN 'Response too long (maximum 8000 characters)'
        WHEN regexp_matches(lower({strip_sql('text')}), '{fixed.BAD_ANSWER}') THEN 'Response indicates an error or inability to help' WHEN len({_ANSWER_WORDS}) > 10 AND len(list_distinct({_ANSWER_WORDS})) < len({_ANSWER_WORDS}) * 0.3 THEN 'Response appears to be repetitive' END AS answer_error FROM documents""",
    "script_detection": rf"""SELECT page_id, CASE WHEN coalesce(length(s) - length(regexp_replace(s, '{_AR}', '', 'g')) > (length(s) - length(regexp_replace(s, '[a-zA-Z]', '', 'g'))) * 1.5, false) THEN 'ar' ELSE 'en' END AS script_language, {arabic_sql('title')} AS title_is_arabic, {_NORM.format(x='title')} AS arabic_title,
      list_filter(list_transform(regexp_extract_all(title, '[\x{{0600}}-\x{{06FF}}]+'), lambda w: {_NORM.format(x='w')}), lambda w: length(w) > 2) AS arabic_tokens FROM (SELECT *, {_SAMPLE.format(x='relevant_content')} AS s FROM pages)""",
    "hash_keys": f"""SELECT page_id, md5(relevant_content) AS text_md5, sha256(relevant_content) AS text_sha256, substring(md5(concat(coalesce(url, ''), '_', coalesce(title, ''), '_', '{AS_OF}')), 1, 12) AS content_key, 'question_analysis:' || sha256(lower({strip_sql('title')})) AS title_key,
      md5(concat_ws('|', title, summary)) AS response_key, sha256(concat_ws('|', 'cat:' || coalesce(category, 'default'), url, coalesce(title, ''))) AS generic_key, CAST(strlen(relevant_content) AS BIGINT) AS n_bytes FROM pages""",
    "search_keys": "SELECT question_id, md5(coalesce(array_to_string(list_sort(list_concat(coalesce(topics, []), coalesce(keywords, []))), ''), '')) AS search_key FROM question_analysis",
    "url_parts": rf"""SELECT page_id, coalesce(starts_with(source_url, 'http') AND {_HOST.format(x='source_url')} <> '' AND NOT regexp_matches(lower({_PATH.format(x='source_url')}), '\.({'|'.join(fixed.EXCLUDED_ENDINGS)})$') AND length(regexp_extract(source_url, '^[^?#]*\?([^#]*)', 1)) <= 200
      {''.join(f" AND NOT contains(lower({_PATH.format(x='source_url')}), '{p}')" for p in fixed.EXCLUDED_PARTS)}, false) AS is_page, {_BARE.format(x='lower(source_url)')} AS bare_host, {_BARE.format(x='lower(source_url)')} = {_BARE.format(x='lower(url)')} AS internal,
      CASE WHEN starts_with(source_url, 'http://') OR starts_with(source_url, 'https://') THEN '' ELSE 'https://' END || regexp_replace(regexp_replace(source_url, '#.*$', ''), '/+$', '') AS normal_url, substring(regexp_replace(replace(replace(source_url, 'https://', ''), 'http://', ''), '[^a-zA-Z0-9_-]', '_', 'g'), 1, 100) AS file_name,
      CASE WHEN {_SAFE} = '' THEN 'untitled' WHEN length({_SAFE}) > 255 THEN substring({_SAFE}, 1, 250) || '.json' ELSE {_SAFE} END AS title_file, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_extract(url, '^https?://[^/]*(/.*)$', 1) AS resolved,
      coalesce(source_url <> '' AND NOT regexp_matches(source_url, '^(#|mailto:|tel:|javascript:)'), false) AS keeps_link, coalesce(length(source_url) > 4 AND NOT starts_with(source_url, 'data:image'), false) AS keeps_image FROM pages""",
    "size_formats": "SELECT DISTINCT seq, round(CASE WHEN size_bytes < 1024 THEN size_bytes::DOUBLE WHEN size_bytes < 1048576 THEN size_bytes / 1024.0 WHEN size_bytes < 1073741824 THEN size_bytes / 1048576.0 WHEN size_bytes < 1099511627776 THEN size_bytes / 1073741824.0 WHEN size_bytes < 1125899906842624 THEN size_bytes / 1099511627776.0 ELSE size_bytes / 1125899906842624.0 END, 6) AS size_value, CASE WHEN size_bytes IS NULL THEN NULL WHEN size_bytes < 1024 THEN 'B' WHEN size_bytes < 1048576 THEN 'KB' WHEN size_bytes < 1073741824 THEN 'MB' WHEN size_bytes < 1099511627776 THEN 'GB' WHEN size_bytes < 1125899906842624 THEN 'TB' ELSE 'PB' END AS size_unit FROM cache_access",
    "duration_formats": "SELECT DISTINCT seq, CASE WHEN r < 1 THEN 'ms' WHEN r < 60 THEN 's' WHEN r < 3600 THEN 'm s' ELSE 'h m' END AS form, round(CASE WHEN r < 1 THEN r * 1000 WHEN r < 60 THEN r WHEN r < 3600 THEN floor(r / 60) ELSE floor(r / 3600) END, 6) AS major, round(CASE WHEN r < 60 THEN 0.0::DOUBLE WHEN r < 3600 THEN r - floor(r / 60) * 60 ELSE floor((r - floor(r / 3600) * 3600) / 60) END, 6) AS minor FROM (SELECT seq, response_time AS r FROM request_log WHERE response_time IS NOT NULL)",
    "page_summaries": rf"""
      WITH c AS (SELECT page_id, regexp_replace({strip_sql('search_text')}, '\s+', ' ', 'g') AS t FROM pages),
      s AS (SELECT page_id, t, list_filter(list_transform(string_split_regex(t, '[.!?]+'), lambda p: {strip_sql('p')}), lambda p: p <> '') AS parts FROM c),
      u AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM s WHERE length(t) > 200),
      r AS (SELECT *, sum(length(part) + 1) OVER (PARTITION BY page_id ORDER BY pos) - 1 AS total FROM u),
      k AS (SELECT page_id, string_agg(part, ' ' ORDER BY pos) AS packed FROM r WHERE total <= 200 GROUP BY page_id),
      h AS (SELECT page_id, t, substring(coalesce(parts[1], t), 1, 197) AS head FROM s)
      SELECT h.page_id, CASE WHEN t IS NULL THEN NULL WHEN length(t) <= 200 THEN t ELSE substring(coalesce(packed, concat(CASE WHEN len({words_sql('head')}) > 1 THEN array_to_string(list_slice({words_sql('head')}, 1, len({words_sql('head')}) - 1), ' ') ELSE head END, '...')), 1, 200) END AS made_summary
      FROM h LEFT JOIN k USING (page_id)""",
    "page_metrics": f"SELECT page_id, CAST(len({words_sql('relevant_content')}) AS BIGINT) AS n_words, CAST(coalesce(length(relevant_content), 0) AS BIGINT) AS n_chars, CAST(len({words_sql('title')}) AS BIGINT) AS n_title_words, md5(CASE WHEN length(relevant_content) > 75000 THEN substring(relevant_content, 1, 75000) || '...' ELSE relevant_content END) AS capped FROM pages",
    "arrays": f"""WITH q AS (SELECT question_id, coalesce(topics, []) AS t, coalesce(keywords, []) AS k, coalesce(entities, []) AS e, list_concat(coalesce(topics, []), coalesce(keywords, [])) AS tk, list_concat(coalesce(entities, []), coalesce(keywords, [])) AS ek FROM question_analysis)
      SELECT question_id, {distinct_sql('tk')} AS terms, {distinct_sql('ek')} AS distinct_terms, list_slice(t, 1, 3) AS first_topics, list_sort(list_distinct(list_filter(k, lambda x: NOT list_contains(e, x)))) AS only_keywords, list_sort(list_distinct(list_filter(k, lambda x: list_contains(e, x)))) AS both,
      len(list_filter(k, lambda x: contains(x, 'ing'))) > 0 AS has_ing, CAST(coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) AS BIGINT) AS keyword_chars FROM q""",
}

"""Text functions on columns. All are built-ins inside code generation; none is a UDF.

Word characters are ``[\\p{L}\\p{N}_]`` everywhere, so results agree with engines whose ``\\w`` is ASCII. Every function
gives null for null unless its docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

WORD = r"[\p{L}\p{N}_]+"
_EDGE = r"[^\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, r"\s+", " ")


def words(text: Column) -> Column:
    """White-space separated words; none for null or blank text."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.size(words(text)).cast("bigint")


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def letter_tokens(text: Column, least: int = 3, most: int = 15) -> Column:
    """Word runs made of Latin and Arabic letters only, of ``least`` to ``most`` letters."""
    return F.filter(tokens(text), lambda w: w.rlike(rf"^[a-z\x{{0600}}-\x{{06FF}}]{{{least},{most}}}$"))


def count_of(text: Column, part: Column) -> Column:
    """Occurrences of ``part``, not overlapping; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def sentence_parts(text: Column, marks: str = ".!?") -> Column:
    """Parts between runs of sentence marks, empty ones included."""
    return F.split(text, f"[{marks}]+", -1)


def dot_sentences(text: Column) -> Column:
    """Number of non-blank parts between full stops."""
    return F.size(F.filter(F.split(text, r"\.", -1), lambda p: F.length(strip(p)) > 0)).cast("bigint")


def clean_question(text: Column) -> Column:
    """White space collapsed, signs dropped but for ``. , ; : ? ! -``, short forms written out."""
    out = F.regexp_replace(collapse(strip(text)), r"[^\p{L}\p{N}_\s.,;:?!-]", "")
    for short, full in fixed.ABBREVIATIONS:
        for _ in range(2):  # neighbours share an edge, so one pass would skip every other
            out = F.regexp_replace(out, rf"(?i)(^|{_EDGE}){short}($|{_EDGE})", f"$1{full}$2")
    return out


def clean_for_search(text: Column) -> Column:
    """White space collapsed, then tags stripped (in this order, which can leave two spaces)."""
    return F.regexp_replace(collapse(strip(text)), "<[^>]+>", "")


def any_word(text: Column, options: list[str]) -> Column:
    """Whether one of the words stands in the lower-cased text as a whole word."""
    return F.lower(text).rlike(rf"(^|{_EDGE})({'|'.join(options)})($|{_EDGE})")


def any_part(text: Column, options: list[str]) -> Column:
    """Whether one of the substrings stands in the lower-cased text."""
    return F.lower(text).rlike("|".join(re.escape(o) for o in options))


def question_type(text: Column) -> Column:
    """First matching type in declared order, else by question mark and hint words."""
    out = F
    for name, options in fixed.QUESTION_WORDS.items():
        out = out.when(any_word(text, options), F.lit(name))
    return out.when(strip(text).endswith("?"), F.lit("interrogative")).when(any_part(text, fixed.HELP_WORDS), F.lit("help_request")).when(any_part(text, fixed.EXPLAIN_WORDS), F.lit("explanation")).otherwise(F.lit("general"))


def topics(text: Column) -> Column:
    """Topics with a matching substring in declared order, else the first fallback group, else ``general``."""
    found = F.filter(F.array(*[F.when(any_part(text, o), F.lit(t)) for t, o in fixed.TOPIC_WORDS.items()]), lambda t: t.isNotNull())
    other = F
    for name, options in fixed.TOPIC_FALLBACKS:
        other = other.when(any_part(text, options), F.array(F.lit(name)))
    return F.when(F.size(found) > 0, found).otherwise(other.otherwise(F.array(F.lit("general"))))


def keywords(text: Column, stopwords: list[str] = fixed.STOPWORDS_EN, most: int = 20) -> Column:
    """Distinct tokens in order of appearance, longer than two characters, no stop words, the first ``most``."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))), 1, most)


def entities(text: Column) -> Column:
    """Capitalised words (first 10) and numbers (first 5), distinct and sorted."""
    runs = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    names = F.slice(F.filter(runs, lambda w: w.rlike("^[A-Z][a-z]+$")), 1, 10)
    numbers = F.slice(F.filter(runs, lambda w: w.rlike("^[0-9]+$")), 1, 5)
    return F.array_sort(F.array_distinct(F.concat(names, numbers)))


def complexity(n_words: Column, n_sentences: Column, n_keywords: Column, n_topics: Column, kind: Column) -> Column:
    """Weighted saturation of length, sentences, keywords and topics, plus a bonus for involved types; at most 1."""
    one = F.lit(1.0)
    score = F.least(one, n_words / 50) * 0.3 + F.least(one, n_sentences / 5) * 0.2 + F.least(one, n_keywords / 10) * 0.2 + F.least(one, n_topics / 3) * 0.15
    return F.least(one, score + F.when(kind.isin("comparison", "procedure", "definition"), 0.15).otherwise(0.0))


def confidence(language_confidence: Column, n_words: Column, n_keywords: Column, n_topics: Column, kind: Column) -> Column:
    """Confidence of an analysis, between 0 and 1."""
    plus = lambda test, by: F.when(test, by).otherwise(0.0)
    score = language_confidence * 0.3 + plus(n_words >= 3, 0.2) + plus(n_keywords > 0, 0.2) + plus(n_topics > 0, 0.15) + plus(kind != "general", 0.1) - plus((n_words < 2) | (n_words > 100), 0.1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def input_error(text: Column, least: int = 3, most: int = 2000) -> Column:
    """Message of the first rule that a question breaks; null if it is fine."""
    t = strip(text)
    meaningful = F.exists(words(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", "")), lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*[F.lit(x) for x in fixed.STOPWORDS_EN]), w))
    return (
        F.when(text.isNull() | (text == ""), "Question must be a non-empty string")
        .when(F.length(t) < least, f"Question too short (minimum {least} characters)")
        .when(F.length(t) > most, f"Question too long (maximum {most} characters)")
        .when(F.lower(t).rlike(fixed.SUSPICIOUS), "Question contains invalid content")
        .when(~meaningful, "Question lacks meaningful content")
    )


def answer_error(text: Column, least: int = 10, most: int = 8000) -> Column:
    """Message of the first rule that an answer breaks; null if it is fine."""
    t = strip(text)
    w = words(F.lower(t))
    return (
        F.when(text.isNull() | (t == ""), "Empty response received")
        .when(F.length(t) < least, f"Response too short (minimum {least} characters)")
        .when(F.length(t) > most, f"Response too long (maximum {most} characters)")
        .when(F.lower(t).rlike(fixed.BAD_ANSWER), "Response indicates an error or inability to help")
        .when((F.size(w) > 10) & (F.size(F.array_distinct(w)) < F.size(w) * 0.3), "Response appears to be repetitive")
    )


def format_answer(text: Column, keep_markdown: bool = False) -> Column:
    """Blank lines squeezed, one space after sentence marks, bold and italic marks removed."""
    out = F.regexp_replace(strip(text), r"\n\s*\n\s*\n", "\n\n")
    out = F.regexp_replace(out, r"([.!?])\s*([A-Z])", "$1 $2")
    if not keep_markdown:
        out = F.regexp_replace(F.regexp_replace(out, r"\*\*(.*?)\*\*", "$1"), r"\*(.*?)\*", "$1")
    return out


def _sample(text: Column) -> Column:
    n = F.length(text)
    middle = F.substring(text, F.floor(n / 2).cast("int") - 500 + 1, F.lit(1000))
    return F.when(n > 2000, F.concat(F.substring(text, 1, 1000), middle)).otherwise(F.substring(text, 1, 1000))


def script_language(text: Column) -> Column:
    """``ar`` if a sample (start and middle) has over 1.5 times as many Arabic as Latin letters, else ``en``."""
    s = _sample(text)
    arabic = F.length(s) - F.length(F.regexp_replace(s, rf"[{fixed.ARABIC}]", ""))
    latin = F.length(s) - F.length(F.regexp_replace(s, "[a-zA-Z]", ""))
    return F.when(F.coalesce(arabic > latin * 1.5, F.lit(False)), F.lit("ar")).otherwise(F.lit("en"))


def guessed_language(text: Column) -> Column:
    """Language of a short text: ``ar`` by script, else the language whose frequent words it holds most often.

    Ties go to the language declared first; null without any such word.
    """
    def among(options: list[str]):
        return lambda w: w.isin(*options)

    counts = [F.struct(F.size(F.filter(tokens(text), among(ws))).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(fixed.COMMON_WORDS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(text.isNull(), None).when(is_arabic(text), "ar").when(best["n"] > 0, best["lang"])


def is_arabic(text: Column) -> Column:
    """Whether over 30 % of the letters are Arabic; false for null or no letters."""
    arabic = F.length(text) - F.length(F.regexp_replace(text, rf"[{fixed.ARABIC}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}_]", ""))
    return F.coalesce((letters > 0) & (arabic > letters * 0.3), F.lit(False))


def normalise_arabic(text: Column) -> Column:
    """Vowel marks and tatweel dropped, letter variants folded, everything not Arabic dropped."""
    out = F.regexp_replace(text, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")
    out = F.translate(out, "إأآٱةيئڪھ", "ااااهىىكه")
    return F.regexp_replace(out, r"[^\x{0600}-\x{06FF}]", "")


def dictionary_tokens(text: Column) -> Column:
    """Latin or Arabic words of two letters or more; lower case unless the text is Arabic (Latin words always)."""
    runs = F.when(is_arabic(text), F.regexp_extract_all(text, F.lit(rf"[{fixed.ARABIC}]{{2,}}|[a-zA-Z]{{2,}}"), F.lit(0))).otherwise(
        F.filter(tokens(text), lambda w: w.rlike(rf"^[a-z{fixed.ARABIC}]{{2,}}$"))
    )
    return F.transform(F.coalesce(runs, F.array().cast("array<string>")), lambda w: F.when(w.rlike("^[a-zA-Z]+$"), F.lower(w)).otherwise(w))


def summary(text: Column, most: int = 200, marks: str = ".!?") -> Column:
    """Whole sentences from the start while they fit; one too long sentence is cut at a word with ``...``.

    One fold over the sentences, without a shuffle. Null for null, blank for blank.
    """
    clean = collapse(strip(text))
    parts = F.filter(F.transform(sentence_parts(clean, marks), strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("done"))

    def step(acc, part):
        longer = F.when(acc["s"] == "", part).otherwise(F.concat(acc["s"], F.lit(" "), part))
        fits = ~acc["done"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(acc["s"]).alias("s"), (acc["done"] | ~fits).alias("done"))

    packed = F.aggregate(parts, start, step)["s"]
    head = F.substring(F.coalesce(F.get(parts, F.lit(0)), clean), 1, most - 3)
    w = words(head)
    cut = F.concat(F.when(F.size(w) > 1, F.array_join(F.slice(w, 1, F.size(w) - 1), " ")).otherwise(head), F.lit("..."))
    return F.when(F.length(clean) <= most, clean).otherwise(F.substring(F.when(packed != "", packed).otherwise(cut), 1, most))


def byte_size(n: Column) -> tuple[Column, Column]:
    """(scaled value, unit) of a number of bytes, in steps of 1024."""
    units = ["B", "KB", "MB", "GB", "TB"]
    value, unit = n / F.lit(1024.0**5), F.lit("PB")
    for k in range(len(units) - 1, -1, -1):
        small = n < 1024.0 ** (k + 1)
        value, unit = F.when(small, n / F.lit(1024.0**k)).otherwise(value), F.when(small, F.lit(units[k])).otherwise(unit)
    return value, unit


def duration(seconds: Column) -> Column:
    """Struct of the two leading parts of a duration: (ms), (s), (m, s) or (h, m) with their form."""
    whole = lambda x: F.floor(x).cast("double")
    row = lambda form, a, b: F.struct(F.lit(form).alias("form"), a.alias("major"), b.alias("minor"))
    zero = F.lit(0.0)
    return (
        F.when(seconds < 1, row("ms", seconds * 1000, zero))
        .when(seconds < 60, row("s", seconds, zero))
        .when(seconds < 3600, row("m s", whole(seconds / 60), seconds - whole(seconds / 60) * 60))
        .otherwise(row("h m", whole(seconds / 3600), whole((seconds - whole(seconds / 3600) * 3600) / 60)))
    )

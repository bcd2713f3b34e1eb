"""Operators against small independent references, and their edge cases."""

import random
from collections import OrderedDict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia.functions import addresses as A
from marginalia.functions import text as T
from marginalia.operators import caches, categories, context, graph, questions, running, search


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [("  what  about   r u ok?  ", "what about are you ok?"), ("u u u", "you you you"), ("mail @me #1 (x)", "mail me 1 x"), ("", ""), (None, None), ("thru the door, tho!", "through the door, though!")])
def test_clean_question(spark, raw, want):
    assert one(spark, T.clean_question(F.col("x")), raw) == want


@pytest.mark.parametrize("raw, want", [("What is it?", "what"), ("Tell me how", "how"), ("Steps needed", "procedure"), ("Open now?", "interrogative"), ("support me", "help_request"), ("describe it", "explanation"), ("hm", "general")])
def test_question_type(spark, raw, want):
    assert one(spark, T.question_type(F.col("x")), raw) == want


@pytest.mark.parametrize("raw, want", [(None, "Question must be a non-empty string"), ("", "Question must be a non-empty string"), ("  ", "Question too short (minimum 3 characters)"), ("x" * 2001, "Question too long (maximum 2000 characters)"), ("see <script>", "Question contains invalid content"), ("is the on at", "Question lacks meaningful content"), ("library hours", None)])
def test_input_error(spark, raw, want):
    assert one(spark, T.input_error(F.col("x")), raw) == want


def test_summary(spark):
    long = "First sentence here. " + "Second one follows now. " * 20
    got = one(spark, T.summary(F.col("x")), long)
    assert got.startswith("First sentence here Second one") and len(got) <= 200
    assert one(spark, T.summary(F.col("x")), "word " * 100).endswith("...")
    assert one(spark, T.summary(F.col("x")), None) is None and one(spark, T.summary(F.col("x")), " ") == ""


def test_byte_size_and_duration(spark):
    value, unit = T.byte_size(F.col("x"))
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 1024**3, 1024**5)], "x long").select(value.alias("v"), unit.alias("u")).collect()
    assert [tuple(r) for r in rows] == [(0, "B"), (1023, "B"), (1, "KB"), (1.5, "KB"), (1, "GB"), (1, "PB")]
    rows = spark.createDataFrame([(s,) for s in (0.5, 30.25, 90.0, 3725.0)], "x double").select(T.duration(F.col("x")).alias("d")).collect()
    assert [(r.d.form, r.d.major, r.d.minor) for r in rows] == [("ms", 500, 0), ("s", 30.25, 0), ("m s", 1, 30), ("h m", 1, 2)]


def test_arabic(spark):
    assert one(spark, T.normalise_arabic(F.col("x")), "إِدَارَةٌ abc") == "اداره"
    assert one(spark, T.is_arabic(F.col("x")), "مكتبة lib") is True and one(spark, T.is_arabic(F.col("x")), None) is False


@pytest.mark.parametrize("url, ok", [("https://a.test/x", True), ("https://a.test/x.PDF", False), ("https://a.test/admin/x", False), ("ftp://a.test", False), ("https:///x", False), (None, False), ("https://a.test/?q=" + "x" * 201, False)])
def test_is_page(spark, url, ok):
    assert one(spark, A.is_page(F.col("x")), url) is ok


def test_addresses(spark):
    assert one(spark, A.resolve(F.lit("https://a.test/b/c?d"), F.col("x")), "/e") == "https://a.test/e"
    assert one(spark, A.resolve(F.lit("https://a.test/b/c?d"), F.col("x")), "e") == "https://a.test/b/e"
    assert one(spark, A.safe_file_name(F.col("x")), 'a<b>:"c.txt') == "a_b___c.txt"
    assert one(spark, A.safe_file_name(F.col("x")), " . ") == "untitled"
    assert len(one(spark, A.safe_file_name(F.col("x")), "x" * 300 + ".json")) == 255
    with pytest.raises(ValueError, match="unknown"):
        A.hashed(F.col("x"), "crc")


def test_best_category_ties(spark):
    lexicon = {"b": ["x", "xx"], "a": ["y"]}
    df = spark.createDataFrame([(1, "X y"), (2, None), (3, ""), (4, "yy x"), (5, "xxx"), (6, "none")], "k long, t string").withColumn("extra", F.lit(1))
    got = {r.k: (r.category, r.score) for r in categories.scored_categories(df, "k", [(F.col("t"), 1.0)], lexicon).collect()}
    assert got == {1: ("b", 1.0), 2: ("general", 0.0), 3: ("general", 0.0), 4: ("a", 2.0), 5: ("b", 4.0), 6: ("general", 0.0)}
    assert categories.scored_categories(df.limit(0), "k", [(F.col("t"), 1.0)], lexicon).count() == 0


@pytest.mark.parametrize("limit", [100_000, 3])
def test_lexicon_matches(spark, monkeypatch, limit):
    """Against ``str.count``, with all terms in one automaton or in several passes."""
    monkeypatch.setattr(categories, "LEXICON_ROWS", limit)
    rnd = random.Random(3)
    terms = [(rnd.choice("pqr"), "".join(rnd.choice("abA") for _ in range(rnd.randint(0, 3)))) for _ in range(14)]
    texts = [(i, rnd.choice([None, "".join(rnd.choice("aBb ") for _ in range(30))])) for i in range(40)]
    got = {(r.k, r.category): (r.n_terms, r.n) for r in categories.lexicon_matches(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame(terms, "category string, term string")).collect()}
    want = {}
    for k, t in texts:
        for c, term in {(c, term.lower()) for c, term in terms if term}:
            if t and (n := t.lower().count(term)):
                a, b = want.get((k, c), (0, 0))
                want[k, c] = (a + 1, b + n)
    assert got == want and want


def test_document_categories(spark):
    lexicon = spark.createDataFrame([("fees", "en", "tuition fee", 1), ("sport", "en", "gym", 1), ("fees", "ar", "رسوم", 1)], "category string, lang string, term string, ord int")
    rows = [(1, "Tuition fee", "gym", "the fee for tuition", "en"), (2, "", "", "رسوم رسوم", "ar"), (3, None, None, None, None), (4, "", "", "gym tuition fee", "de")]
    df = spark.createDataFrame(rows, "k long, t string, w string, c string, l string")
    got = {r.k: (r.category, r.score) for r in categories.document_categories(df, "k", F.col("t"), F.col("w"), F.col("c"), F.col("l"), lexicon).collect()}
    assert got == {1: ("fees", 6.0), 2: ("fees", 4.0), 3: ("general", 0.0), 4: ("fees", 5.0)}


def naive_lru(keys, capacity):
    held, out = OrderedDict(), []
    for k in keys:
        out.append(k in held)
        held.pop(k, None)
        held[k] = None
        if len(held) > capacity:
            held.popitem(last=False)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cache_replays(spark, seed):
    rnd = random.Random(seed)
    trace = [(i, rnd.choice("aaaabcdefgh"), rnd.randint(0, 4000)) for i in range(400)]
    rows = [(i, k, t, rnd.choice([30, 30, 300, None, 0]) if seed else 60) for i, k, t in trace]
    df = spark.createDataFrame(rows, "seq long, cache_key string, t long, ttl int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.seq: r.hit for r in caches.lru_replay(df, capacity=4, block=37).collect()}
    assert [got[i] for i in range(400)] == naive_lru([k for _, k, _, _ in rows], 4)
    want, until = {}, {}
    for i, k, t, ttl in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = k in until and t <= until[k]
        if not want[i]:
            life = 3600 if ttl is None else ttl
            until[k] = t + life if life > 0 else float("inf")
    assert {r.seq: r.hit for r in caches.ttl_replay(df, partitions=7).collect()} == want


def naive_cache(rows, capacity):
    """A cache as the operators describe it: an ordered map that is evicted before each write."""
    held, out = OrderedDict(), {}
    for i, k, t, ttl in sorted(rows, key=lambda r: (r[2], r[0])):
        until = held.get(k)
        if until is not None and t <= until:
            held.move_to_end(k)
            out[i] = "hit"
            continue
        out[i] = "absent" if until is None else "expired"
        held.pop(k, None)
        while len(held) >= capacity:
            held.popitem(last=False)
        life = 3600 if ttl is None else ttl
        held[k] = t + life if life > 0 else float("inf")
    return out


@pytest.mark.parametrize("keys, capacity", [("aaaabcdefgh", 4), ("ab", 5), ("abcdefghijklmnop", 3), ("a", 1)])
def test_cache_replay(spark, keys, capacity):
    rnd = random.Random(len(keys))
    rows = [(i, rnd.choice(keys), rnd.randint(0, 3000), rnd.choice([20, 100, 400, None, 0])) for i in range(500)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(900, None, 5, 5, "x")], "seq long, cache_key string, t long, ttl int, k string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.seq: r.outcome for r in caches.cache_replay(df, capacity=capacity, block=23, partitions=9).collect()}
    assert got == naive_cache(rows, capacity)


def test_sparse_order(spark):
    """Order numbers far apart: only blocks that hold rows count."""
    rnd = random.Random(21)
    seqs = sorted(rnd.sample(range(10**15), 200))
    keys = [rnd.choice("abcdefgh") for _ in seqs]
    df = spark.createDataFrame(list(zip(seqs, keys, strict=True)), "seq long, cache_key string")
    got = {r.seq: r.hit for r in caches.lru_replay(df, capacity=3, block=10).collect()}
    assert [got[i] for i in seqs] == naive_lru(keys, 3)


def test_hot_key_over_many_blocks(spark):
    """Regular accesses whose chain of misses depends on where it began: every block waits for the one before."""
    rows = [(i, "hot", i, 7) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, cache_key string, t long, ttl int").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.seq: r.hit for r in caches.ttl_replay(df, partitions=11).collect()}
    assert got == {i: i % 8 != 0 for i in range(300)}


def test_cache_replays_empty(spark):
    df = spark.createDataFrame([], "seq long, cache_key string, ttl int, ts timestamp")
    assert caches.ttl_replay(df).count() == 0 and caches.lru_replay(df).count() == 0 and caches.cache_replay(df).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_metrics(spark, block):
    rnd = random.Random(block)
    rows = [(i, rnd.choice("ab"), rnd.random() < 0.6, round(rnd.random(), 4), None if rnd.random() < 0.5 else f"e{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, model string, success boolean, response_time double, error string").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r.seq: r for r in running.request_metrics(df, block).collect()}
    state = {}
    for i, m, ok, t, e in rows:
        n, total, failures, last = state.get(m, (0, 0, 0, None))
        n, total, failures, last = (n + 1, total + round(t * 1e6), 0, last) if ok else (n, total, failures + 1, e)
        state[m] = (n, total, failures, last)
        r = got[i]
        assert (r.successes, r.failures, r.mean_micros, r.last_error) == (n, failures, total // n if n else None, last)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = {r.node: r.step for r in graph.within_steps(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_crawl(spark):
    links = [("a", 0, "b"), ("a", 1, "c"), ("a", 2, "b"), ("c", 0, "e"), ("b", 0, "d"), ("b", 1, "a"), ("d", 0, "f"), ("f", 0, "g"), ("d", 1, None)]
    df = spark.createDataFrame(links, "src string, pos int, dst string")
    run = lambda **k: [(r.url, r.step) for r in graph.crawled(df, "a", **k).collect()]
    assert run(depth=2) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("f", 3)]
    assert run(most=3) == [("a", 0), ("b", 1), ("c", 1)] and run() == [*run(depth=2), ("g", 4)] and run(most=1) == [("a", 0)]
    assert [r.url for r in graph.crawled(df.limit(0), "z").collect()] == ["z"]


PAGES = "page_id long, title string, summary string, keywords array<string>, search_text string, structured_content struct<headings: array<string>, sections: int>"


def naive_score(page, terms):
    fields = [(page[1], 2.0), (page[2], 1.3), (" ".join(page[3] or []), 1.5), (page[4], 1.0), (" ".join((page[5] or ([],))[0] or []), 0.8)]
    total, matched = 0.0, set()
    for term in terms:
        low = term.lower()
        for text, boost in fields:
            text = (text or "").lower()
            if low in text:
                total += text.count(low) * len(term) / 10 * boost
                matched.add(term)
            for word in text.split():
                ratio = SequenceMatcher(None, low, word).ratio()
                if ratio > 0.8:
                    total += ratio * len(term) / 15 * boost * 0.5
                    matched.add(term)
    return total / len(terms) * (1.2 if len(matched) > 1 else 1), sorted(matched)


def test_fuzzy_words(spark):
    """Against all pairs, over words of all lengths and few letters."""
    rnd = random.Random(13)
    make = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 22)))
    def edit(w):
        for _ in range(rnd.randint(1, 3)):
            i = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:i] + rnd.choice("abx") + w[i:], w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :]]) or "a"
        return w
    terms = [make() for _ in range(150)] + ["a", "ab", "abc", "Abcd"]
    words = list({*(edit(w) for w in terms for _ in range(3)), *(make() for _ in range(150)), "a", "ab", "abcd", "acbd"})
    got = {(r.term, r.word) for r in search.fuzzy_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(t, w) for t in terms for w in words if SequenceMatcher(None, t.lower(), w).ratio() > 0.8} and len(got) > 60


def test_full_scores(spark):
    pages = [
        (1, "Library hours", "Opening times of the library", ["libraries", "hours"], "the library opens at eight, librarys close", (["Library"], 1)), (2, "Fees", None, None, "fee schedule and feess, scheduled scheduling", None),
        (3, None, "x", ["y"], None, None), (4, "", "library", None, "", None), (5, "aaaa", "abcd abce", ["abdc"], "a bb ccc", ([], 0)),
    ]
    asked = [(20, ["library", "Hours"], ["libary", "opens"]), (40, ["fee"], ["schedule", "shedule"]), (60, ["abcd"], ["aa", "b"]), (80, [], None)]
    got = {(r.question, r.page): (round(r.score, 9), list(r.matched)) for r in search.full_scores(spark.createDataFrame(asked, "q long, topics array<string>, keywords array<string>"), spark.createDataFrame(pages, PAGES), "q", "page_id").collect()}
    want = {}
    for q, t, k in asked:
        terms = list(dict.fromkeys([*t, *(k or [])]))
        for p in pages:
            if (p[1] or p[4]) and terms:
                score, matched = naive_score(p, terms)
                if matched:
                    want[q, p[0]] = (round(score, 9), matched)
    assert got == want


def test_snippet(spark):
    text = "Alpha beta gamma. " * 10 + "The library opens at eight. " + "Delta epsilon. " * 40
    long = "word " * 150
    df = spark.createDataFrame([(1, text, ["library"]), (2, text, []), (3, "short  <b>text</b>", ["x"]), (4, None, ["x"]), (5, "", ["x"]), (6, long, ["none"]), (7, text, None), (8, text, ["", "Library", "gamma"]), (9, long + ". gamma here", ["gamma"])], "k long, c string, t array<string>")
    got = {r.k: r.s for r in df.select("k", search.snippet(F.col("c"), F.col("t"), 120).alias("s")).collect()}
    assert got[1] == "The library opens at eight" or got[1].startswith("Alpha beta gamma  The library opens at eight  Delta")
    assert got[2] == text[:120] and got[3] == "short text" and got[4] is None and got[5] == "" and got[6] == long.strip()[:120] + "..." and got[7] == text[:120]
    assert got[8].startswith("The library opens at eight Alpha beta gamma Alpha") and len(got[8]) <= 120 and got[9] == "gamma here"


def naive_truncation(prompt, most, heading):
    """By hand: keep context lines from the first while they fit into what the rest leaves."""
    if len(prompt) <= most:
        return prompt
    lines = prompt.split("\n")
    opens = [i for i, l in enumerate(lines) if heading in l]
    if opens:
        closes = [i for i, l in enumerate(lines) if i > opens[0] and l.startswith("###") and "Context" not in l]
        first, end = opens[0] + 1, (closes or [len(lines)])[0]
        room = most - 100 - len("\n".join(lines[:first] + lines[end:]))
        if room > 0:
            fits = [j for j in range(first, end + 1) if sum(len(l) + 1 for l in lines[first:j]) <= room]
            note = ["...[Content truncated due to length limits]"] if first < fits[-1] < end else []
            prompt = "\n".join(lines[:first] + lines[first : fits[-1]] + note + lines[end:])
    return prompt if len(prompt) <= most else prompt[: most - 50] + "\n...[Truncated]"


def test_truncation(spark):
    rnd = random.Random(7)
    heading = "### Knowledge Context"
    prompts = [None, "", "short", "x" * 900, "intro\n" + heading + "\n" + "y" * 900, heading + "\n" + "a\n" * 400]
    for _ in range(60):
        body = ["line " + "z" * rnd.randint(0, 60) for _ in range(rnd.randint(0, 40))]
        prompts.append("\n".join(["intro " * rnd.randint(1, 80), *([heading] if rnd.random() < 0.9 else []), *body, *rnd.choice([[], ["### Question", "q " * rnd.randint(1, 60)], ["### More Context", "c" * 80, "### Question"]])]))
    df = spark.createDataFrame(list(enumerate(prompts)), "k long, p string")
    got = {r.k: r.p for r in context.truncate_prompts(df, "k", "p", 600).collect()}
    assert got == {k: None if p is None else naive_truncation(p, 600, heading) for k, p in enumerate(prompts)}


def test_two_decimals(spark):
    rnd = random.Random(8)
    values = [i / 1000 for i in range(3000)] + [rnd.random() * 5 for _ in range(500)] + [0.125, 0.375, 2.675, 1.005, 0.295, 4.0]
    got = [r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select(context.two_decimals(F.col("x")).alias("y")).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 1, "u1", 0.5, "a" * 300), (1, 2, None, 0.0, " "), (1, 3, "u3", 0.25, "b" * 4000), (1, 4, "u4", 0.1, "c")], "q long, r int, url string, s double, c string")
    row = context.pack_context(hits, "q", "r", "url", "s", "c", 1000).first()
    assert row.n_entries == 2 and "--- Source 1 ---\nURL: u1\nRelevance: 0.50\n" in row.context and "--- Source 3 ---" in row.context and "[truncated]" in row.context and "Source 4" not in row.context
    assert one(spark, context.template_errors(F.col("x")), "{context} {question") == ["missing {question}", "missing {language_instruction}", "unequal braces"]


@pytest.mark.parametrize("text, want", [("What is the fee for my course?", "en"), ("Comment est-ce que je peux payer les frais ?", "fr"), ("Wie kann ich das Buch zurückgeben?", "de"), ("¿Cómo puedo pagar la matrícula?", "es"), ("كيف أدفع الرسوم", "ar"), ("zzz yyy", None), (None, None)])
def test_guessed_language(spark, text, want):
    assert one(spark, T.guessed_language(F.col("x")), text) == want


def test_whole_search(spark):
    pages = spark.createDataFrame([(1, "Library hours", "Opening times", ["hours"], "the library opens at eight", None, "The library opens at eight. Bring a card."), (2, "Fees", None, None, "fee schedule", None, None), (3, None, None, None, None, None, "library")], PAGES + ", relevant_content string")
    asked = spark.createDataFrame([(20, ["library"], ["opens"]), (40, [], None), (60, ["nothing here"], [])], "q long, topics array<string>, keywords array<string>")
    texts = pages.select("page_id", F.concat_ws(" ", "title", "summary", "search_text").alias("text"))
    got = search.searched(asked, pages, texts, "q", "page_id").collect()
    assert [(r.question, r.page, r.rank, r.matched) for r in got] == [(20, 1, 1, ["library", "opens"])]
    basic = naive_score((1, "Library hours", "Opening times", ["hours"], "the library opens at eight", None), ["library", "opens"])[0]
    cos = {(r.q, r.page_id): r.cosine for r in search.cosine(search.query_vectors(spark.createDataFrame([(20, "library opens")], "q long, t string"), "q", "t", search.tfidf(texts, "page_id", "text")[1]), "q", search.tfidf(texts, "page_id", "text")[0], "page_id").collect()}[20, 1]
    assert got[0].score == pytest.approx(0.6 * basic + 0.4 * cos) and got[0].snippet == "The library opens at eight. Bring a card."


def test_fallbacks(spark):
    assert "high demand" in one(spark, questions.fallback_answer(F.col("x")), "Rate LIMIT hit") and "technical" in one(spark, questions.fallback_answer(F.col("x")), None)
    assert one(spark, questions.fallback_answer(F.col("x"), "custom"), "boom") == "custom"
    lang, conf = questions.detected_language(F.col("x"), F.lit("en"))
    assert one(spark, lang, "what is the plan") == "en" and one(spark, conf, "what is the plan") == pytest.approx(0.8)
    assert one(spark, conf, "two words") == 0.7


def test_dictionary(spark):
    pages = spark.createDataFrame([("News", ["Apple", "pear"], "Apple day", None), ("news ", ["apple"], None, "pear"), (None, ["x1"], "t", None), ("general", ["apple"], None, None)], "category string, keywords array<string>, title string, summary string")
    got = categories.build_dictionary(pages, least=2, excluded=("general",)).collect()
    assert [(r.category, r.keywords, r.n_pages) for r in got] == [("news", ["apple", "pear"], [2, 2])]


def test_best_by_blocks(spark, monkeypatch):
    """Blocks of few questions and pages against all pairs, ties by page included."""
    monkeypatch.setattr(search, "PAGE_BLOCK", 50)
    monkeypatch.setattr(search, "QUESTION_BLOCK", 4)
    rnd = random.Random(5)
    asked = {q: rnd.sample("abcdefgh", rnd.randint(1, 5)) for q in range(12)}
    held = {p: {t: rnd.choice([0.05, 0.5, 1.0]) for t in rnd.sample("abcdefxy", rnd.randint(0, 3))} for p in range(400)}
    own = {q: {t: rnd.choice([0.25, 0.5]) for t in rnd.sample("klmn", 2)} for q in range(10)}
    vector = {p: {t: rnd.choice([0.125, 0.5]) for t in rnd.sample("klmno", rnd.randint(0, 3))} for p in range(100, 500)}
    want, want_cos = {}, {}
    for q, terms in asked.items():
        rows, cosines = [], []
        for p in range(500):
            met = sorted(t for t in terms if t in held.get(p, {}))
            cos = sum(w * vector.get(p, {}).get(t, 0) for t, w in own.get(q, {}).items())
            basic = sum(held[p][t] for t in met) / len(terms) * (1.2 if len(met) > 1 else 1) if met else 0
            score = basic * 0.6 + cos * 0.4 if cos > 0 else basic
            rows += [(-round(score, 9), p, met)] * (len(met) > 0 and score >= 0.1)
            cosines += [(-round(cos, 9), p)] * (cos > 0)
        want |= {(q, r): (p, -s, met) for r, (s, p, met) in enumerate(sorted(rows)[:3], 1)}
        want_cos |= {(q, r): (p, -s) for r, (s, p) in enumerate(sorted(cosines)[:3], 1)}
    flat = lambda d, names: spark.createDataFrame([(k, t, float(w)) for k, ts in d.items() for t, w in ts.items()], names)
    terms = spark.createDataFrame([(q, t, len(ts)) for q, ts in asked.items() for t in ts], "question long, term string, n_terms int"), flat(held, "page long, term string, w double")
    vectors = flat(own, "question long, term string, weight double"), flat(vector, "page long, term string, weight double")
    got = {(r.question, r.rank): (r.page, round(r.score, 9), r.matched) for r in search.best_by_blocks(500, 3, 0.1, terms, vectors, listed=True).collect()}
    assert got == {k: (p, round(s, 9), m) for k, (p, s, m) in want.items()} and len(got) > 30
    got = {(r.question, r.rank): (r.page, round(r.score, 9)) for r in search.best_by_blocks(500, 3, 0.0, vectors=vectors).collect()}
    assert got == want_cos


@pytest.mark.parametrize("name", ["tfidf_top5", "search_full", "search_combined", "search_top10", "snippets", "search_fuzzy"])
def test_searches_write_little(spark, data_dir, tmp_path, monkeypatch, name):
    """Tables written on the way hold terms and words: repeating the pages leaves them as they are."""
    from marginalia.plans import registry

    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    many = spark.range(10).withColumnRenamed("id", "copy").crossJoin(pages).withColumn("page_id", F.col("page_id") + F.col("copy") * 100_000).drop("copy")
    many.coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet(f"{data_dir}/question_analysis.parquet").coalesce(1).write.parquet(f"{tmp_path}/question_analysis.parquet")
    written, cut = [], search.cut

    def counted(df):
        written.append((done := cut(df)).count())
        return done

    monkeypatch.setattr(search, "cut", counted)
    assert registry.queries()[name](spark, str(tmp_path)).count() > 0
    assert written and max(written) < 50 * pages.count() * 10 / 3


@pytest.mark.parametrize(("name", "most"), [("search_full", 1400), ("search_fuzzy", 250), ("search_combined", 1400), ("snippets", 200), ("search_top10", 200)])
def test_searches_shuffle_little(spark, data_dir, tmp_path, name, most):
    """Pages meet the questions as lists of numbered terms, their words are not shuffled: bytes a page that all stages write for shuffles."""
    from marginalia.plans import registry

    pages, q = spark.read.parquet(f"{data_dir}/pages.parquet"), spark.read.parquet(f"{data_dir}/question_analysis.parquet")
    many = spark.range(20).withColumnRenamed("id", "copy").crossJoin(pages).withColumn("page_id", F.col("page_id") + F.col("copy") * 100_000).drop("copy")
    many.coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    q.coalesce(1).write.parquet(f"{tmp_path}/question_analysis.parquet")
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    nothing = gateway.jvm.java.util.ArrayList()

    def shuffled():
        stages = store.stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
        return sum({(x := stages.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(stages.size())}.values())

    before = shuffled()
    assert registry.queries()[name](spark, str(tmp_path)).count() > 0
    assert (shuffled() - before) / (pages.count() * 20) < most


@pytest.mark.parametrize("name", ["search_full"])
def test_searches_take_every_question(spark, data_dir, tmp_path, name):
    """The ids of the questions do not matter: twenty times each id gives the same rows."""
    from marginalia.plans import registry

    q = spark.read.parquet(f"{data_dir}/question_analysis.parquet").filter("question_id % 20 <= 2")
    found = []
    for k in (1, 20):
        spark.read.parquet(f"{data_dir}/pages.parquet").coalesce(2).write.parquet(f"{tmp_path}/{k}/pages.parquet")
        q.withColumn("question_id", F.col("question_id") * k).coalesce(1).write.parquet(f"{tmp_path}/{k}/question_analysis.parquet")
        found.append(sorted(((r.question_id // k, *r[1:]) for r in registry.queries()[name](spark, f"{tmp_path}/{k}").collect()), key=str))
    assert found[0] == found[1] and any(r[0] % 20 for r in found[0])

"""Training-data operators: held-out accuracy, exact round trips, brute force, and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import boilerplate, language, leakage, learn, neardup, packing, phrases, pii, pii_training, repeated, residue, spam, splitting

PAGE = "page_id long, content_id string, url string, title string, relevant_content string, source_url string, language string, x string"


def pages(spark, rows):
    """Pages with an extra column; missing fields are null."""
    full = [tuple({"page_id": i, **r}.get(c.split()[0]) for c in PAGE.split(", ")) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, PAGE)


ODD = [{"relevant_content": None}, {"relevant_content": ""}, {"relevant_content": " \n\n "}, {"relevant_content": "7"}, {"relevant_content": "word " * 30_000}, {"title": None, "url": None, "relevant_content": "x\ny"}, {"page_id": 1, "relevant_content": None}]


@pytest.fixture(scope="module")
def odd(spark):
    return pages(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], PAGE)


def test_trees_and_isotonic():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    p = learn.BoostedTrees(rounds=60, depth=3).fit(x[:400], y[:400]).predict(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.9
    s, q = learn.isotonic(p, y[400:])
    assert (np.diff(q) >= 0).all() and (np.diff(s) > 0).all()


# 1 ------------------------------------------------------------------------------------------------------------------
def test_personal_data_held_out():
    rnd = random.Random(4321)
    texts = [pii_training.labelled_text(rnd) for _ in range(600)]
    counts = Counter(w for t, _ in texts for w in {*re.findall(r"[^\W\d_]{3,}", t.lower())})
    levels = {w: pii.level(n, len(texts)) for w, n in counts.items()}
    right = found = true = 0
    for (_, spans), got in zip(texts, pii.personal_data_model().spans([t for t, _ in texts], levels), strict=True):
        g = {(k, a) for k, a, _, _ in got}
        right, found, true = right + len(g & set(spans)), found + len(g), true + len(set(spans))
    assert right / true > 0.9 and right / found > 0.9


def test_names_of_ordinary_sentences():
    probes = {
        "Sincerely, Michael O'Brien": "Michael O'Brien", "The applicant Priya Raghunathan was late.": "Priya Raghunathan", "Thanks! - Kevin Zhang": "Kevin Zhang", "Ask Jennifer Lawson about it.": "Jennifer Lawson",
        "Our tenant, Wojciech Kowalski, left.": "Wojciech Kowalski", "The issue was raised by Omar Haddad today.": "Omar Haddad", "This bag belongs to Stefan Maier.": "Stefan Maier",
    }
    got = pii.personal_data_model().spans(list(probes), {})
    assert [[t[a:b] for k, a, b, _ in spans if k == "name"] for t, spans in zip(probes, got, strict=True)] == [[n] for n in probes.values()]
    assert ("address", 12, 26) in {c[:3] for c in pii.candidates("He lives at 42 Wallaby Way, next door.")}


def test_word_levels(spark):
    df = spark.createDataFrame([(f"common word{i % 7} rare{i}",) for i in range(4000)] + [(None,), ("",)], "t string")
    got = pii.word_levels(df)
    assert set(got) == {"common", "word", "rare"} and got["common"] == pytest.approx(pii.level(4000, 4001))
    assert pii.rarity("l'common", got) == got["common"] and pii.rarity("unseen", got) == pii.RAREST
    assert pii.level(1, 10**6) == pii.RAREST and pii.level(3, 3) > 7


def test_personal_data_edges(spark, odd, empty):
    assert pii.find_personal_data(empty, "page_id", "relevant_content").count() == 0
    assert pii.find_personal_data(odd, "page_id", "relevant_content").count() == 0
    text = "The booking was made by Anna Tolandric, passport number X0643805.\nForward all bills to a.b@mail.quenby.test today. Book ISBN 978-3-16-148410-0 is sold out."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "page_id long, relevant_content string")
    got = {(r.pii_type, text[r.start_pos - 1 : r.start_pos - 1 + r.length]) for r in pii.find_personal_data(df, "page_id", "relevant_content").collect()}
    assert got == {("name", "Anna Tolandric"), ("id_number", "X0643805"), ("email", "a.b@mail.quenby.test")}
    red = {r.page_id: r.redacted for r in pii.redact(df, "relevant_content").collect()}
    assert red[1] == "The booking was made by [NAME], passport number [ID_NUMBER].\nForward all bills to [EMAIL] today. Book ISBN 978-3-16-148410-0 is sold out." and red[2] is None and red[3] == ""


# 2 ------------------------------------------------------------------------------------------------------------------
def test_forward_backward_brute_force():
    rnd = np.random.default_rng(3)
    unary, trans, lens = rnd.normal(size=(5, 3)), rnd.normal(size=(3, 3)), np.array([3, 2])
    p = language.forward_backward(unary, lens, trans)
    for a, n in ((0, 3), (3, 2)):
        weights = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(unary[a + i, s] for i, s in enumerate(path)) + sum(trans[path[i], path[i + 1]] for i in range(n - 1)))
            for i, s in enumerate(path):
                weights[i, s] += w
        assert np.allclose(p[a : a + n], weights / weights.sum(1, keepdims=True))


def test_language_held_out():
    rnd = random.Random(77)
    units = [(lang, phrases.sentence(lang, rnd)) for lang in language.LANGS[:5] for _ in range(60)]
    lens, p = language.unit_marginals([u for _, u in units], language.language_model(), {}, [])
    mass = np.add.reduceat(p, np.r_[0, np.cumsum(lens)[:-1]], axis=0)[:, : language.NONE].argmax(1)
    assert np.mean([language.LANGS[m] == lang for m, (lang, _) in zip(mass, units, strict=True)]) > 0.99


def test_unlabelled(spark, odd, empty):
    en, fr = "The carpenter will repair the wooden stairs before the guests arrive.", "Le menuisier va réparer les marches de bois avant que les hôtes arrivent."
    df = pages(spark, [{"relevant_content": en, "language": "EN"}, {"relevant_content": en + "\n" + fr, "language": "en-GB"}, {"relevant_content": fr, "language": "und"}, {"relevant_content": f"{en} («{fr}»)", "language": "English"}, {"relevant_content": "lorem ipsum dolor sit amet elit sed donec vitae nunc.", "language": None}])
    got = {tuple(r) for r in language.unlabelled(df, "page_id", "relevant_content", "language", "paragraphs").collect()}
    assert got == {(2, "fr"), (3, "fr")}
    assert language.unlabelled(empty, "page_id", "relevant_content", "language", "sentences").count() == 0
    assert {r.rec_id for r in language.languages(odd, "page_id", "relevant_content", "sentences").collect()} <= {4, 5, 6}
    records = {r.rec_id: (r.lang, r.confidence) for r in language.record_languages(df, "page_id", "relevant_content", "paragraphs").collect()}
    assert records[1][0] == "en" and records[3][0] == "fr" and records[5] == (None, None) and records[1][1] > 0.9
    far = pages(spark, [{"relevant_content": "O rato roeu a roupa do rei enquanto a vizinha cantava na janela."}])
    assert language.record_languages(far, "page_id", "relevant_content", "paragraphs").first().lang == "other"
    parts = language.languages(df.filter("page_id = 2"), "page_id", "relevant_content", "paragraphs", segments=True).collect()
    assert {r.lang for r in parts} >= {"en", "fr"} and all(0 <= r.confidence <= 1 for r in parts)
    assert language.sentences("Hier B. Halidor. Am 9. Dezember kommt er. Gut?\nJa") == ["Hier B. Halidor.", "Am 9. Dezember kommt er.", "Gut?", "Ja"]


def test_segments_hold_every_word(spark):
    """Headings, list entries, quotations and addresses too."""
    text = "Opening hours\n\n• Le menuisier va réparer les marches\nThe carpenter reads «Le menuisier va réparer les marches de bois» every evening in the garden.\nWrite to anna.holm@example.org"
    df = pages(spark, [{"relevant_content": text}])
    parts = sorted((r.unit_no, r.first_word, r.n_words, r.lang) for r in language.languages(df, "page_id", "relevant_content", "paragraphs", segments=True).collect())
    lines = [l for l in text.split("\n") if l]
    assert [sum(n for u, _, n, _ in parts if u == k) for k in range(1, 5)] == [len(language._WORD.findall(l)) for l in lines]
    assert all(b == (0 if u != v else a + n) for (v, a, n, _), (u, b, _, _) in zip([(0, 0, 0, None), *parts], parts, strict=False))
    assert "fr" in {l for u, _, _, l in parts if u == 2} and {"en", "fr"} <= {l for u, _, _, l in parts if u == 3}


# 3 ------------------------------------------------------------------------------------------------------------------
REAL = "A guide tells visitors what code 404 on the meter means. Two sisters from Kormond used to sell the wooden bridge before the snow melts. My neighbour never forgot the windows of the chapel."


def test_residue(spark, odd, empty):
    df = pages(spark, [
        {"title": "Guide – {{ page_title }}", "relevant_content": REAL, "url": "https://a.test/x/guide-1"}, {"title": "T", "relevant_content": "Please enable JavaScript to view this page.", "url": "https://a.test/x/toland-2"}, {"title": "404 Not Found", "relevant_content": REAL, "url": "https://a.test/x/toland-3"},
        {"title": "T", "relevant_content": "Lorem ipsum dolor sit amet elit sed donec. " + REAL, "url": None}, {"title": None, "relevant_content": "Farmers pay 100% of the fee, about $ 40 (see note [4]) and {1, 2, 3} apples in total for the market."}, {"title": "T", "relevant_content": "Acceso denegado: no tiene permiso para ver este documento.\n  at a.b(view.py:12)"},
    ])
    assert {r.page_id for r in residue.template_residue(df).collect()} == {1, 2, 4, 6}
    assert residue.template_residue(empty).count() == 0
    assert {r.reason for r in residue.template_residue(odd).collect()} <= {"notice"}


def test_sums_equal_named_features():
    rnd = random.Random(14)
    lines = [f for lang in phrases.MENU for _ in range(40) for f in (phrases.sentence(lang, rnd), phrases.fill(rnd.choice(phrases.NOTICES[lang] + phrases.FURNITURE[lang]), lang, rnd))] + ["7", "a 7 7 b", "- - |", "text text text 5"]
    for model in residue.notice_models():
        for line in lines:
            shape, said_, scale = model._features(line)
            assert model._sum(line) == pytest.approx(sum(model.weights.get(f, 0.0) for f in shape) + scale * sum(model.weights.get(f, 0.0) for f in said_)), line
    model = boilerplate.line_model()
    for line in lines:
        shape, said_, scale = model.features(line)
        named = sum(model.weights.get(f, 0.0) for f in ("bias", *shape)) + scale * sum(model.weights.get(f, 0.0) for f in said_)
        assert model.evidence(line) == pytest.approx(named - model.prior), line


def test_address_and_host_decide(spark):
    """Two pages of equal, doubtful wording: one at its own address, one an answer that many addresses give."""
    text = "The server room is closed for repairs and the page keeps its code."
    own = [{"title": "Server room repairs", "url": "https://own.test/server-room-repairs", "relevant_content": text}]
    others = [{"title": phrases.fill("{N} in pictures", "en", random.Random(i)), "url": f"https://many.test/{phrases.fill('{N}', 'en', random.Random(i)).lower()}-{i}", "relevant_content": text} for i in range(60)]
    found = {r.page_id for r in residue.template_residue(pages(spark, own + others)).collect()}
    assert 1 not in found and len(found) >= 55


def said(title, line):
    return residue.verdict(title, [line], [0.99], *residue.notice_models(), residue.page_score())[0]


def test_placeholder_delimiters():
    for form in ("@@user.first_name@@", "@@title@@", "##dept_name##", "$$deadline$$", "%%body%%", "%page_title%", "@site_name@", "#course.name#", "**page_title**", "__site_name__", "${name}", "TODO: text", "<% title %>"):
        assert said("News – " + form, REAL) == said("News", REAL + form) == "placeholder", form
    for text in ("Write to a.b@mail.quenby.test or @help_desk, see #open_day and #term.", "The **deadline** is near!! Pay 5 $ or 10 %, $x$ and $$y$$ are numbers.", "/search?first_name&last_name&page", "== Rules == and | a | b |, 1 @@ 2"):
        assert said("News", REAL + text) != "placeholder", text


def test_filler_in_long_lines():
    rnd = random.Random(5)
    model = residue.notice_models()[1]
    for lang, texts in phrases.FILLERS.items():
        real = [" ".join(phrases.sentence(lang, rnd) for _ in range(n)) for n in (4, 3)]
        assert not residue.filler(real, model)
        found = [residue.filler([f"{real[0]} {text} {real[1]}"], model) for text in texts if text[-1] == "."]
        assert np.mean(found) > 0.8, lang
        assert residue.filler([f"{real[0]} donec vitae nunc porta morbi justo. {real[1]}"], model)


def test_duplication_alone_is_no_notice(spark):
    for copies in (4, 400):
        df = pages(spark, [{"title": None, "url": f"https://h{i % 24}.test/{i}", "relevant_content": REAL} for i in range(copies)])
        assert residue.template_residue(df).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------
def test_suffix_array_brute_force():
    rnd = random.Random(2)
    for _ in range(30):
        ids = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 25))])
        order, lcp = repeated.suffix_array(np.concatenate([ids, [99]]))
        s = [*ids.tolist(), 99]
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n


def test_maximal_blocks_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        texts = [[rnd.randint(1, 4) for _ in range(rnd.randint(0, 7))] for _ in range(rnd.randint(1, 8))]
        ids, docs = [], []
        for d, t in enumerate(texts):
            ids += [*t, 1000 + d]
            docs += [d] * (len(t) + 1)
        least = rnd.randint(2, 3)
        got = {tuple(b.tolist()): n for b, n in repeated.repeated_blocks(np.array(ids), np.array(docs), least)}
        where: dict = {}
        for d, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    where.setdefault(tuple(t[i:j]), []).append((d, i))
        want = {}
        for block, at in where.items():
            lefts = {texts[d][i - 1] if i else ("^", d) for d, i in at}
            rights = {texts[d][i + len(block)] if i + len(block) < len(texts[d]) else ("$", d) for d, i in at}
            n = len({d for d, _ in at})
            if n >= least and len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
                want[block] = n
        assert got == want
        # every line on enough documents stands in a maximal block
        lines = {x for t in texts for x in t if sum(x in u for u in texts) >= least}
        assert lines == {x for b in got for x in b}


def test_lines_come_from_blocks(spark, monkeypatch):
    df = pages(spark, [{"source_url": "http://a.test", "relevant_content": f"own {'x' * i}\nshare this\nall rights"} for i in range(12)])
    assert repeated.repeated_lines(df)[0].count() == 24
    blocks = repeated.multi_line_blocks(df).collect()
    assert [(len(b.block), b.rows) for b in blocks] == [(2, 12)]
    small = repeated.SHARD_ROWS
    monkeypatch.setattr(repeated, "SHARD_ROWS", 3)
    assert repeated.repeated_lines(df)[0].count() == 24 and [(len(b.block), b.rows) for b in repeated.multi_line_blocks(df).collect()] == [(2, 12)]
    monkeypatch.setattr(repeated, "SHARD_ROWS", small)
    none = spark.createDataFrame([], "source string, block array<bigint>")
    monkeypatch.setattr(repeated, "candidate_blocks", lambda *a: none)
    assert repeated.repeated_lines(df)[0].count() == 0


def test_repeated_lines(spark, empty):
    rnd = random.Random(5)
    rows = [{"source_url": f"http://{rnd.choice(['WWW.a.test', 'a.test', 'b.test', 'www.c.test'])}/p", "relevant_content": rnd.choice([None, "\n".join(rnd.choice([f"line {rnd.choice('abcdefgh')}!", f"LINE {rnd.choice('abcd')} 5", "7 - 8", "", f"own {i}x{rnd.random()}"]) for _ in range(rnd.randint(1, 9)))])} for i in range(300)]
    df = pages(spark, rows)
    got = {(r.page_id, r.line_no) for r in repeated.repeated_lines(df)[0].collect()}
    key = lambda s: re.sub(r"[^a-z]", "", s.lower())
    by, size = {}, {}
    for i, r in enumerate(rows, 1):
        s = re.sub("^www\\.", "", r["source_url"].lower().split("/")[2])
        size[s] = size.get(s, 0) + 1
        for k in {key(x) for x in (r["relevant_content"] or "").split("\n")} - {""}:
            by.setdefault((s, k), set()).add(i)
    want = {(i, n) for i, r in enumerate(rows, 1) for n, x in enumerate((r["relevant_content"] or "").split("\n"), 1) if key(x) and len(by[(s := re.sub("^www\\.", "", r["source_url"].lower().split("/")[2])), key(x)]) >= 8 and len(by[s, key(x)]) >= 0.05 * size[s]}
    assert got == want and want
    clean = {r.page_id: r.clean_content for r in repeated.without_repeated_lines(df).collect()}
    i = min(want)[0]
    assert clean[i] == "\n".join(x for n, x in enumerate(rows[i - 1]["relevant_content"].split("\n"), 1) if (i, n) not in want)
    assert repeated.repeated_lines(empty)[0].count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------
def test_near_duplicates_read_lines_together():
    rnd = random.Random(8)
    model, fillers = boilerplate.line_model(), residue.notice_models()[1]
    lines = [t for page in [boilerplate._training_page(lang, rnd) for lang in phrases.MENU for _ in range(20)] for t, _ in page if t.strip()]
    lines += ["7", "...", "Room b12a, 3x4, 10 10 ٣٤ a_b", "x² ½", "ΟΔΟΣ Σ", "lorem ipsum dolor", "lorem ipsum lorem ipsum", "word " * 500, *(phrases.fill(t, lang, rnd) for lang in phrases.FILLERS for t in phrases.FILLERS[lang])]
    odds, exceeded, words = model.read(lines, residue.suspicious(fillers))
    for line, got, over, said in zip(lines, odds, exceeded, words, strict=True):
        tokens = set(boilerplate._tokens(line))
        assert got == pytest.approx(model.evidence(line)), line
        assert over == (len(tokens & residue._FILLER) >= 3 or fillers.telling(tokens)), line
        assert said == neardup._WORD.findall(line.lower())
    assert 0 < exceeded.sum() < len(lines)
    alone, none, _ = model.read(["...", "—"], residue.suspicious(fillers))
    assert alone == pytest.approx([model.evidence("..."), model.evidence("—")]) and not none.any()
    assert [list(map(float, model.read([l])[0])) for l in lines[:50]] == [[pytest.approx(o)] for o in odds[:50]]
    # lines in the memo are read again for their words
    texts = ["\n".join(lines[i : i + 30]) for i in range(0, 300, 30)]
    models, memo = (model, residue.notice_models(), residue.page_score()), {}
    batch = neardup.pa.RecordBatch.from_arrays([neardup.pa.array(range(10)), neardup.pa.array(["A_b Title"] * 10), neardup.pa.array(texts)], names=["page_id", "title", "text"])
    first, again = (neardup._records(batch, models, memo) for _ in range(2))
    assert first == again and len(first[0]) > 5 and all(w[:3] == ["a", "b", "title"] and len(w) >= neardup.LEAST_WORDS for w in first[1])


def test_near_duplicates(spark, empty, odd):
    rnd = random.Random(8)
    base = [" ".join(phrases.sentence("en", rnd) for _ in range(10)) for _ in range(12)]
    rows = [{"title": f"T{i}", "relevant_content": b} for i, b in enumerate(base)]
    rows += [{"title": "T1", "relevant_content": base[1]}, {"title": "T1", "relevant_content": base[1].upper()}, {"title": None, "relevant_content": base[2] + " And then nobody went home."}, {"title": "T3", "relevant_content": base[3] + " {{ body }}"}, {"title": "x", "relevant_content": base[4][:120]}, {"title": None, "relevant_content": None}]
    df = pages(spark, rows)
    pairs, members = neardup.near_duplicates(df)
    links = {(r.a, r.b) for r in pairs.collect()}
    reps = {r.page_id: r.rep for r in members.collect()}
    assert reps[13] == reps[14] == 2 and 16 not in reps and 17 not in reps and 18 not in reps
    assert (3, 15) in links and all(a < b for a, b in links)
    assert neardup.near_duplicates(empty)[0].count() == 0 and neardup.near_duplicates(odd)[0].count() == 0
    lens, t = neardup.Triples().of(["a b c d", "a  B-c d!", "a b", ""])
    assert lens.tolist() == [2, 2, 0, 0] and t[0] == t[2] and t[1] == t[3]
    assert 40 < neardup.guaranteed_matches(0.6) < neardup.guaranteed_matches(0.8)


def test_index_recall():
    rnd = np.random.default_rng(12)
    x = rnd.integers(0, 256, (20_000, neardup.POSITIONS), np.uint8)
    y = np.where(rnd.random(x.shape) < 0.6, x, rnd.integers(0, 256, x.shape, np.uint8))
    lost = sum(int(((neardup.index_keys(x[i : i + 1000]) == neardup.index_keys(y[i : i + 1000])).sum(1) < neardup.SHARED).sum()) for i in range(0, len(x), 1000))
    assert lost <= 10


# 6 ------------------------------------------------------------------------------------------------------------------
def test_line_model_held_out():
    right = n = 0
    model = boilerplate.line_model()
    rnd = random.Random(991)
    for page in list(boilerplate._training_pages(rnd))[:300]:
        _, flags = boilerplate.split_main(["\n".join(t.replace("\n", " ") for t, _ in page)], model, {})
        right += sum(int(f) == l for f, (_, l) in zip(flags[0], page, strict=True))
        n += len(page)
    assert right / n > 0.96


def test_marginals_brute_force():
    m = boilerplate.line_model()
    ev, block, page = np.array([1.0, -2.0, 0.5]), np.array([0, 0, 1]), np.array([0, 0])
    got = m.marginals(ev, block, page)
    total, hit = 0.0, np.zeros(3)
    for root in (0, 1):
        for b in np.ndindex(2, 2):
            for l in np.ndindex(2, 2, 2):
                if not any(l):
                    continue  # a page has a main line
                w = np.exp(m.root[root] + sum(m.root_block[root, x] for x in b) + sum(m.block_line[b[block[i]], l[i]] + ev[i] * l[i] for i in range(3)))
                total += w
                hit += w * np.array(l)
    assert np.allclose(got, hit / total)


def test_furniture_edges(odd, empty):
    assert boilerplate.furniture_lines(empty).count() == 0
    rows = boilerplate.furniture_lines(odd).collect()
    assert all(r.line_no >= 1 for r in rows)
    texts = {r.page_id: r.main_text for r in boilerplate.main_text(odd.filter("page_id <> 1")).collect()}
    assert texts[3] == "" and texts[2] == ""


# 7 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(4))
def test_splitting_round_trip(seed):
    rnd = random.Random(seed)
    text = "\n".join(rnd.choice(["", "- entry " * rnd.randint(1, 4), "Heading", " ".join(f"w{rnd.random()}" + rnd.choice(["", "", "."]) for _ in range(rnd.randint(5, 90)))]) for _ in range(60))
    got = splitting.pieces(text, 50, 8)
    assert "".join(text[b:e] for _, b, e, _ in got) == text
    for k, (start, body, end, n) in enumerate(got):
        words = splitting._WORD.findall(text[start:end])
        assert len(words) == n <= 50
        if k:
            before = splitting._WORD.findall(text[got[k - 1][0] : got[k - 1][2]])[-8:]
            assert words[: len(before)] == before and len(splitting._WORD.findall(text[start:body])) <= 8


def words(n):
    return " ".join(f"w{i}" for i in range(n - 1)) + " end."


def test_sections_stay_whole():
    for first, second in ((700, 600), (240, 600)):
        text = f"Section One\n{words(500)}\n\nSection Two Heading\n{words(first)}\n{words(second)}\n\nSection Three\n{words(100)}"
        bodies = [text[b:e].strip() for _, b, e, _ in splitting.pieces(text, 800, 50)]
        assert bodies == [f"Section One\n{words(500)}", f"Section Two Heading\n{words(first)}", words(second), f"Section Three\n{words(100)}"]
    nested = f"# A\nfirst words here.\n## A1\n{words(400)}\n## A2\n{words(300)}\n# B\n{words(60)}"
    bodies = [nested[b:e].strip() for _, b, e, _ in splitting.pieces(nested, 760, 50)]
    assert len(bodies) == 2 and bodies[1] == f"# B\n{words(60)}"  # A with A1 and A2 is one piece, B begins another
    assert splitting.heading_level("2.3.1 Rules", 2) == 4 and splitting.heading_level("<h2>Rules</h2>", 1) == 2 and splitting.heading_level("- entry", 2) == 0


def test_no_piece_ends_in_a_heading():
    rnd = random.Random(9)
    for _ in range(20):
        parts = [rnd.choice([f"Heading {i}", f"## Part {i}", words(rnd.randint(20, 120)), "- " + words(rnd.randint(3, 30))]) for i in range(40)] + [words(30)]
        text = "\n".join(parts)
        heads = {p for p in parts if splitting.heading_level(p, len(p.split()))}
        for _, b, e, n in splitting.pieces(text, 150, 10):
            assert n <= 150 and text[b:e].strip().rpartition("\n")[2] not in heads


def test_splitting_edges(spark, odd, empty):
    assert splitting.pieces("", 5, 1) == [] and splitting.pieces("a b", 5, 1) == [(0, 0, 3, 2)]
    with pytest.raises(ValueError, match="overlap"):
        splitting.pieces("a", 5, 5)
    got = splitting.split_oversized(odd, "page_id", "relevant_content").groupBy("page_id").agg(F.max("n_words").alias("n")).collect()
    assert [(r.page_id, r.n) for r in got] == [(5, 800)]
    assert splitting.split_oversized(empty, "page_id", "relevant_content").count() == 0


# 8 ------------------------------------------------------------------------------------------------------------------
def test_best_fit_against_naive():
    rnd = random.Random(1)
    for _ in range(100):
        sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(0, 60))]
        free: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = [(r, k) for k, r in enumerate(free) if r >= s]
            if not fit:
                free.append(50)
            free[min(fit)[1] if fit else -1] -= s
        bins = packing.best_fit_decreasing(sizes, 50)
        load = np.bincount(bins, weights=sizes) if sizes else np.zeros(0)
        assert len(load) == len(free) and (load <= 50).all()


def test_containers(spark, odd):
    docs = spark.createDataFrame([(1, "word " * 5000), (2, None), (3, ""), (4, "short text"), (5, "short text")], "doc_id long, text string")
    got = packing.fill_containers(docs, "doc_id", "text", capacity=512).toPandas()
    enc = packing.encoding(packing.VOCABULARY, packing.PATTERN)
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: len(enc.encode_ordinary(t)) for i, t in ((1, "word " * 5000), (4, "short text"), (5, "short text"))}
    assert got.groupby("container").n_tokens.sum().max() <= 512 and sorted(got[got.doc_id == 1].part) == list(range(1, int((got.doc_id == 1).sum()) + 1))


# 9 ------------------------------------------------------------------------------------------------------------------
def test_leakage_brute_force(spark, empty):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randint(1, 60)}é"
    items = [(i, " ".join(word() for _ in range(30)), " ".join(word() for _ in range(15))) for i in range(20)]
    docs = [(0, None), (1, "")]
    for i in range(2, 200):
        body = [word() for _ in range(30)]
        if i % 2:
            q = rnd.choice(items)[1].split()
            a, n = rnd.randint(0, 15), rnd.randint(10, 15)
            part = [w.upper() for w in q[a : a + n]]
            body[10:10] = [*part[:3], "<b>" + part[3] + "</b>", *part[4:]]
        docs.append((i, ", ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, question string, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, it, "doc_id", "text", "item_id", ["question", "passage"]).filter("distance = 0").collect()}
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, q, p in items if grams(leakage.words(t)) & (grams(leakage.words(q)) | grams(leakage.words(p)))}
    assert got == want and want
    near = {(r.doc_id, r.item_id): r.distance for r in leakage.leaked_items(df, it, "doc_id", "text", "item_id", ["question", "passage"]).collect()}
    assert {k for k, d in near.items() if d == 0} == want and set(near.values()) <= {0, 1}
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, it, "doc_id", "text", "item_id", ["question", "passage"], edits=0).collect()} == want
    assert leakage.leaked_items(df, it.limit(0), "doc_id", "text", "item_id", ["question"]).count() == 0
    with pytest.raises(ValueError, match="edits"):
        leakage.leaked_items(df, it, "doc_id", "text", "item_id", ["question"], edits=2)
    assert leakage.leaked_items(spark.createDataFrame([], "doc_id long, text string"), it, "doc_id", "text", "item_id", ["question"]).count() == 0


def test_edit_distance_and_recall():
    rnd = random.Random(3)
    a = np.array([[rnd.randint(1, 300) for _ in range(12)] for _ in range(800)])
    b = a.copy()
    for k in range(len(b)):
        row, i = b[k].tolist(), rnd.randrange(12)
        b[k] = rnd.choice([[*row[:i], 999, *row[i + 1 :]], [*row[:i], 999, *row[i:]][:12], [*row[:i], *row[i + 1 :], 998]])
    assert (leakage.edit_distances(a, a) == 0).all() and (leakage.edit_distances(a, b) <= 2).all()
    assert (leakage.lsh_keys(a) == leakage.lsh_keys(b)).any(1).mean() > 0.93


# 10 -----------------------------------------------------------------------------------------------------------------
def test_spam_held_out(spark, odd):
    rnd = random.Random(555)
    texts = [spam._labelled_text(rnd) for _ in range(800)]
    shares = spam.line_markov().content_shares(["\n".join(t for t, _ in parts) for parts in texts])
    right = n = 0
    for parts, got in zip(texts, shares, strict=True):
        words = [(len(t.split()), l) for t, l in parts]
        bad = sum(k for k, l in words if l >= spam.CONTENT) / sum(k for k, _ in words)
        if bad < 0.3 or bad > 0.75:
            n += 1
            right += (got[0] < 1 - spam.LEAST) == (bad > 0.75)
    assert right / n > 0.97
    got = {r.page_id: r.content_share for r in spam.content_share(odd.filter("page_id <> 1"), "page_id", "relevant_content").collect()}
    assert got[2] is None and got[3] is None

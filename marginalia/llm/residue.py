"""Template residue and pages that hold an error or a notice instead of content.

Detectors read title and main lines for unfilled placeholders and filler passages. A page all of whose main lines could
be a notice is of low information: its address slug and title are compared with its body, and the addresses that answer
with the same message are counted on its host and over all hosts. One logistic score, fitted on generated pages, joins
wording, mismatch and duplication and decides every page of low information. Duplication is a share of the host's
addresses with a bound, so the score behaves alike at every size.

Edge cases: a null text has no main lines, so only its title can hit; blank pages and pages without main lines hit by
title alone; a null address has no slug terms and counts as no mismatch; repeated rows count once per address.
"""

from __future__ import annotations

import gc
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import phrases
from .boilerplate import STEM, _TOKEN, Watch, _shape, _tokens, line_chances, line_model, slices
from .learn import fit_logistic
from .spam import FUNCTION

#: Wording odds from which a sentence is filler.
SURE = 2.0
#: Probability from which a line is surely main text.
SURELY = 0.95
#: Probability above which a line that reads like a notice may be main text.
DOUBTFUL = 0.01
#: Wording odds from which a doubtful line reads like a notice.
LEANING = 0.5
#: Probability from which a page of low information is a notice.
LEAST = 0.5
#: Share of a host's addresses at which duplication counts 1, the addresses added to each host so that a few pages prove
#: little, and the most that duplication counts.
NOTABLE, PRIOR, BOUND = 0.003, 30, 6.0
#: Generated pages on which the score is fitted.
TRAINING_PAGES = 4000
# Forms of unfilled placeholders.
_PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|%[A-Z][A-Z_]{2,40}%|\[(?:YOUR|INSERT|ENTER|insert|your|enter|add)\b[^\[\]\n]{1,60}\]|\bTODO:|\{[a-z_]+(?:\.[a-z_]+)?\}"
    r"|<(?:(?:site|page|course|department|dept|first|last|body|user|your)[ _](?:name|title|text|here)|deadline|body|name|title)>|__[A-Z][A-Z_]{2,30}__|(?<![\w%])%[sd](?!\w)"
)
# One delimiter on both sides of an identifier, doubled or single. Signs that also serve as emphasis, and
# single ones, count only around compound names such as page_title.
_DOUBLED = re.compile(r"([@#$%^&])\1{1,2}[A-Za-z][A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*\1{2}|([*~|+=:_!])\2{1,2}[A-Za-z]{2,}(?:[._][A-Za-z]{2,})+\2{2}")
_SINGLE = re.compile(r"([@#$%^])(?<!\w.)[A-Za-z]{2,}(?:[._][A-Za-z]{2,})+\1(?!\w)")
_PAIRS = tuple(c * 2 for c in "@#$%^&*~|+=:_!")
_TECHNICAL = re.compile(r"\s*(?:at [\w.$]+\([^)]*:\d+\)|(?:id )?[\[(#]?(?:id )?[0-9a-f]{6,16}[\])]?)\s*$")
_WORD = re.compile(r"\w+")
_TERM = re.compile(r"[^\W\d_]{4,}")
_SENTENCE = re.compile(r"(?<=[.!?؟…])\s+")
#: Lines and sentences whose log odds a model keeps for reuse; the memo is emptied when full.
MEMO = 100_000
#: Weight from which a word (or its beginning) is telling of filler, the sum that a sentence needs, and the log odds of a
#: line without any known word.
TELLING, ENOUGH, NOTHING = 0.4, 1.0, -12.0
# The public filler passage, words that are no words of the five languages.
_FILLER = frozenset((
    "lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum sed nunc donec vitae porta morbi justo ligula congue arcu nibh urna "
    "pellentesque habitant tristique senectus netus malesuada fames turpis egestas vestibulum mauris cursus mattis feugiat vivamus tellus lacus semper auctor sapien faucibus ornare suspendisse interdum posuere "
    "sollicitudin dictum blandit maecenas pharetra convallis aenean euismod elementum integer feugiat scelerisque varius phasellus faucibus purus viverra accumsan cras fermentum odio volutpat praesent ultricies leo integer "
    "bibendum neque quam lectus pretium vulputate rhoncus diam risus hendrerit lobortis nec massa felis eget pulvinar metus vel ut ante orci ac augue eros ultrices at eu in et non tincidunt fringilla gravida"
).split())


class NoticeModel:
    """Log odds, by words, word beginnings and shape, that a line is a notice or filler rather than content or furniture."""

    def __init__(self, positive: dict[str, list[str]], seed: int = 23) -> None:
        rnd = random.Random(seed)
        words = {w for ts in positive.values() for t in ts for w in _tokens(re.sub(r"\{\w+\}", " ", t))}
        self.words = frozenset(w for w in words if w != "0")
        self.stems = frozenset(w[:STEM] for w in words if len(w) > STEM)
        lines, labels = [], []
        for lang in phrases.MENU:
            for _ in range(500):
                some = rnd.choice(positive[lang])
                lines.append(phrases.fill(some, lang, rnd))
                labels.append(1)
                r = rnd.random()
                lines.append(phrases.fill(rnd.choice(phrases.TALK[lang]), lang, rnd) if r < 0.2 else phrases.sentence(lang, rnd) if r < 0.4 else phrases.sentence(lang, rnd)[:-1] + ", " + phrases.sentence(lang, rnd) if r < 0.6 else phrases.fill(rnd.choice(rnd.choice([phrases.HEADINGS, phrases.ENTRIES, phrases.SINGLES, phrases.FURNITURE, phrases.TITLES])[lang]), lang, rnd))
                labels.append(0)
        index: dict[str, int] = {"bias": 0}
        # half of the lines lose some of their words, so that beginnings and shape carry lines of other wording
        rows, values = [], []
        for i, t in enumerate(lines):
            shape, said, scale = self._features(t, rnd if i % 4 < 2 else None)
            rows.append([index.setdefault(f, len(index)) for f in (*shape, *said)])
            values.append([1.0] * len(shape) + [scale] * len(said))
        w = fit_logistic(rows, np.array(labels), len(index), epochs=200, l2=3e-4, values=values)
        self.weights = {f: float(w[i]) for f, i in index.items()}
        self.telling_words = {f: w for f in self.words if (w := self.weights.get(f, 0.0)) > TELLING and f not in FUNCTION}
        self.telling_stems = {f: w for f in self.stems if (w := self.weights.get("p:" + f, 0.0)) > TELLING}
        self.said: dict[str, float] = {}

    def present(self, words: set[str]) -> list[tuple[str, float]]:
        """Telling words among these and telling beginnings of theirs, with their weights."""
        begins = {w[:STEM] for w in words if len(w) > STEM} & self.telling_stems.keys()
        return [(w, self.telling_words[w]) for w in words & self.telling_words.keys()] + [(b, self.telling_stems[b]) for b in begins]

    def telling(self, words: set[str]) -> bool:
        """Whether the telling words among these, and their beginnings, weigh ``ENOUGH``; other sentences never count."""
        begins = {w[:STEM] for w in words if len(w) > STEM}
        total = sum(map(self.telling_words.__getitem__, words & self.telling_words.keys()))
        return total + sum(map(self.telling_stems.__getitem__, begins & self.telling_stems.keys())) > ENOUGH

    def __getstate__(self) -> dict:
        return {**self.__dict__, "said": {}}

    def _features(self, line: str, drop: random.Random | None = None) -> tuple[list[str], list[str], float]:
        """(shape features, word features, their scale). Words count less the more of them a line has."""
        tokens = _tokens(line)
        known = [t if t == "0" or t in self.words and not (drop and drop.random() < 0.5) else "_" for t in tokens]
        shape = ["bias", *(f for f in _shape(line) if f[0] != "b")] if tokens else ["bias"]
        shape.append("u%d" % min(4, int(5 * known.count("_") / max(1, len(known)))))
        plain = [t for t in tokens if t != "0"]
        shape.append("again%d" % min(3, (len(plain) - len(set(plain))) * 4 // max(1, len(plain))))
        said = {t for t in known if t not in "_0"}
        said.update("p:" + t[:STEM] for t in tokens if len(t) > STEM and t[:STEM] in self.stems)
        said.update(f"{a} {b}" for a, b in zip(known, known[1:], strict=False) if "_" not in (a, b))
        return shape, list(said), 1.0 / max(1.0, len(tokens) / 8) ** 0.5

    def _sum(self, line: str, tokens: list[str] | None = None) -> float:
        """The sum of the weights that ``_features`` names, without naming them all."""
        get = self.weights.get
        tokens = _tokens(line) if tokens is None else tokens
        if not tokens:
            return get("bias", 0.0) + get("u0", 0.0) + get("again0", 0.0)
        words, last, pairs, missing = self.words, "_", set(), 0
        for t in tokens:
            if t in words or t == "0":
                if last != "_":
                    pairs.add(last + " " + t)
                last = t
            else:
                last, missing = "_", missing + 1
        seen = set(tokens)
        total = sum([get(p, 0.0) for p in pairs])
        total += sum([get(t, 0.0) for t in seen & words]) + sum([get("p:" + t, 0.0) for t in {t[:STEM] for t in seen if len(t) > STEM} & self.stems])
        plain = len(tokens) - tokens.count("0")
        again = plain - len(seen) + ("0" in seen)
        shape = get("bias", 0.0) + sum([get(f, 0.0) for f in _shape(line) if f[0] != "b"])
        shape += get("u%d" % min(4, int(5 * missing / len(tokens))), 0.0) + get("again%d" % min(3, again * 4 // max(1, plain)), 0.0)
        return shape + total / max(1.0, len(tokens) / 8) ** 0.5

    def odds(self, line: str, tokens: list[str] | None = None) -> float:
        """Log odds; a line without any known word or beginning is none, whatever its shape. ``tokens``: the line's, if at hand."""
        known = self.said.get(line)
        if known is None:
            if len(self.said) >= MEMO:
                self.said.clear()
            tokens = _tokens(line) if tokens is None else tokens
            if self.words.isdisjoint(tokens) and self.stems.isdisjoint([t[:STEM] for t in tokens]):
                known = NOTHING
            else:
                known = self._sum(line, tokens)
            self.said[line] = known
        return known


def mismatch(url: str | None, title: str | None, body: list[str]) -> tuple[bool, bool, bool, bool]:
    """(slug has terms, slug terms in body, title terms in body, title terms in slug)."""
    slug = set(_TERM.findall((url or "").rpartition("/")[2].lower()))
    head = set(_TERM.findall((title or "").lower()))
    words = {w for l in body for w in _TERM.findall(l.lower())}
    return bool(slug), bool(slug & words), bool(head & words), bool(head & slug)


class PageScore:
    """Probability that a page of low information is a notice, from wording, length, mismatch and duplication."""

    def __init__(self) -> None:
        rnd = random.Random(41)
        # each half of the notices is judged by a model that never saw it, as on the web
        parts = [{k: v[i::2] for k, v in phrases.NOTICES.items()} for i in (0, 1)]
        judges = [NoticeModel(parts[1]), NoticeModel(parts[0])]
        x, y = [], []
        for _ in range(TRAINING_PAGES):
            lang = rnd.choice(list(phrases.MENU))
            label, half = rnd.random() < 0.5, rnd.randint(0, 1)
            name = phrases.fill("{N}", lang, rnd)
            title = phrases.fill(rnd.choice(phrases.TITLES[lang]).replace("{N}", name), lang, rnd)
            slug = "" if rnd.random() < 0.1 else f"https://h/{name.lower()}-{rnd.randint(1, 999)}"
            if label:
                lines = [phrases.fill(rnd.choice(parts[half][lang]), lang, rnd) for _ in range(rnd.choice([1, 1, 1, 2]))]
                title = rnd.choice(phrases.FAILED[lang] + [lines[0][:30]]) if rnd.random() < 0.5 else title
                share = rnd.uniform(0.0, 0.05) if rnd.random() < 0.8 else 0.0
            else:
                lines = [phrases.main_line(lang, rnd) if rnd.random() < 0.7 else phrases.fill(rnd.choice(phrases.HEADINGS[lang] + phrases.ENTRIES[lang]), lang, rnd) for _ in range(rnd.choice([1, 1, 2, 3, 5, 8]))]
                if rnd.random() < 0.6:
                    lines[0] = phrases.fill(rnd.choice(phrases.HEADINGS[lang]).replace("{N}", name), lang, rnd)
                if rnd.random() < 0.3:  # addresses and titles that say nothing of the text are common
                    slug, title = f"https://h/{phrases.fill('{N}', lang, rnd).lower()}-1", rnd.choice([title, "", phrases.fill(rnd.choice(phrases.TITLES[lang]), lang, rnd)])
                share = 0.0 if rnd.random() < 0.85 else rnd.uniform(0.0, 0.35)  # now and then a hot group of copies
            odds = [judges[half].odds(l) for l in lines]
            x.append(self.features(sum(odds) / len(odds), sum(l.count(" ") + 1 for l in lines), mismatch(slug, title, lines), share))
            y.append(label)
        x, y = np.array(x), np.array(y, float)
        w = np.zeros(x.shape[1])
        for _ in range(60):  # Newton's method with a small ridge
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - q) - 0.5 * w)
        self.weights = w
        self.base, self.slope = float(w[0]), float(w[3])
        #: The most that slug, title and duplication can give.
        self.most = max(float(self.features(0.0, 0, m, s)[4:] @ w[4:]) for m in np.ndindex(2, 2, 2, 2) for s in (0.0, 1.0))

    def hopeless(self, words: int, alone: bool = False) -> bool:
        """Whether a body of so many words needs a notice's wording, as no other evidence (or none at all) can make it one."""
        return self.base + self.slope * math.log2(1 + words) + (0.0 if alone else self.most) < 0

    @staticmethod
    def features(odds: float, words: int, terms: tuple[bool, bool, bool, bool], share: float) -> np.ndarray:
        """Bias, wording for and against, length, slug and title against body, duplication."""
        slug, in_body, titled, alike = (float(t) for t in terms)
        return np.array([1.0, min(max(odds, 0.0), 8.0), max(min(odds, 0.0), NOTHING), np.log2(1 + words), slug * in_body, slug * (1 - in_body), alike * titled, slug * (1 - alike), min(np.log2(1 + share / NOTABLE), BOUND)])

    def chances(self, odds: list[float], words: list[int], terms: list[tuple[bool, bool, bool, bool]], shares: list[float]) -> np.ndarray:
        """Probability of each page."""
        x = np.array([self.features(*row) for row in zip(odds, words, terms, shares, strict=True)])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


@lru_cache(maxsize=1)
def notice_models() -> tuple[NoticeModel, NoticeModel]:
    """(notices, filler), fitted once in a process."""
    return NoticeModel(phrases.NOTICES), NoticeModel(phrases.FILLERS)


@lru_cache(maxsize=1)
def page_score() -> PageScore:
    """The joined score, fitted once in a process."""
    return PageScore()


def suspicious(model: NoticeModel) -> list[Watch]:
    """What lines exceed that can hold filler: three words of the filler's vocabulary, or telling words."""
    return [Watch(dict.fromkeys(_FILLER, 1.0), {}, 2.5), Watch(model.telling_words, model.telling_stems, ENOUGH)]


def filler(lines: list[str], model: NoticeModel, said: dict[str, list[str]] | None = None) -> bool:
    """Whether the lines hold a passage of scrambled Latin or of layout filler. ``said``: the words of some lines."""
    for line in lines:
        words = said.get(line) if said and "_" not in line else None
        words = _WORD.findall(line.lower()) if words is None else words
        seen = set(words)
        if len(seen & _FILLER) >= 3:
            run = 0
            for w in words:
                run = run + 1 if w in _FILLER else 0
                if run >= 5:
                    return True
        present = model.present(seen)
        if sum(w for _, w in present) <= ENOUGH:
            continue
        parts, odds = [], []
        for p in _SENTENCE.split(line):
            low = p.lower()
            # telling words that stand in the sentence as letters bound those that stand in it as words
            may = sum([w for t, w in present if t in low]) > ENOUGH
            if may or _TOKEN.search(low):
                parts.append(p)
                odds.append(model.odds(p, tokens) if may and model.telling(set(tokens := _tokens(p))) else NOTHING)
        if any(o > SURE and len(p) > 8 for p, o in zip(parts, odds, strict=True)):
            return True
        # neighbours are scored together where one of them leans towards filler
        if any(max(odds[i : i + 2]) > -1 and model.odds(f"{parts[i]} {parts[i + 1]}") > SURE for i in range(len(parts) - 1)):
            return True
    return False


def has_placeholder(text: str) -> bool:
    """Whether a text holds an unfilled placeholder; the patterns run only where a sign they need is present."""
    if any(c in text for c in "{%<[_") and _PLACEHOLDER.search(text) or "TODO:" in text and _PLACEHOLDER.search(text):
        return True
    return any(c in text for c in "@#$%^") and bool(_SINGLE.search(text)) or any(c in text for c in _PAIRS) and bool(_DOUBLED.search(text))


def main_or_notice(lines: list[str], chances: np.ndarray, notices: NoticeModel) -> tuple[list[str], list[float]]:
    """Main lines and how surely they are: those above a half, and doubtful ones whose wording is a notice's.

    The sign of ``chances`` (negative: the line can hold filler) is kept.
    """
    main, sure = [], []
    for l, c in zip(lines, chances.tolist(), strict=True):
        p = abs(c)
        if p <= 0.5 and p > DOUBTFUL and (odds := notices.odds(l)) > LEANING:
            p = 1 - (1 - p) / (1 + np.exp(odds))
        if p > 0.5:
            main.append(l)
            sure.append(p if c >= 0 else -p)
    return main, sure


def verdict(title: str | None, main: list[str], chances: list[float], notices: NoticeModel, fillers: NoticeModel, score: PageScore, alone: bool = False, said: dict[str, list[str]] | None = None) -> tuple[str | None, float, int]:
    """(reason, wording odds, words) by title and main lines: placeholder, filler, notice (open until scored) or None.

    Lines of negative ``chances`` are searched for filler. The wording odds are the mean over lines, each weighted by how
    surely it is main text. A page that needs a notice's wording and has a sure main line without it is none; with ``alone`` no evidence but wording and length will follow.
    ``said``: the words of some lines.
    """
    whole = "\n".join([title or "", *main])
    if has_placeholder(whole):
        return "placeholder", 9.0, 0
    body = [(l, c) for l, c in zip(main, chances, strict=True) if not _TECHNICAL.match(l)]
    if filler([title or "", *(l for l, c in body if c < 0)], fillers, said):
        return "filler", 9.0, 0
    words = sum(l.count(" ") + 1 for l, _ in body)
    hopeless = score.hopeless(words, alone)
    total = weight = 0.0
    for l, c in ((l, abs(c)) for l, c in body):
        odds = notices.odds(l)
        if hopeless and c > SURELY and odds < 0:
            return None, odds, words
        total, weight = total + (c - 0.4) * odds, weight + (c - 0.4)
    return ("notice", total / weight, words) if body else (None, 0.0, 0)


def template_residue(pages: DataFrame) -> DataFrame:
    """(page_id, reason STRING, score DOUBLE) of pages that are template residue, filler or a notice.

    One narrow pass keeps pages that hit a detector and pages of little information; only the undecided among the latter
    meet the counts of their message over addresses and hosts.
    """
    lines_m = line_model()
    notices, fillers = notice_models()
    score = page_score()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 20, 20)  # the memos hold no cycles, so looking for them often is wasted
        memo: dict = {}
        for batch in slices(batches):
            ids, urls, titles, texts = (c.to_pylist() for c in batch.columns)
            lines_of, chances_of = line_chances(texts, lines_m, memo, suspicious(fillers))
            rows = []
            for i, url, title, lines, chances in zip(ids, urls, titles, lines_of, chances_of, strict=True):
                main, sure = main_or_notice(lines, chances, notices)
                reason, odds, words = verdict(title, main, sure, notices, fillers, score)
                if reason in ("placeholder", "filler"):
                    rows.append((i, reason, 1.0, None, None, None, None, None))
                elif reason:
                    body = [l for l in main if not _TECHNICAL.match(l)]
                    message = "\n".join(re.sub(r"\d+", "0", l.strip().lower()) for l in body)
                    rows.append((i, "notice", odds, words, [*mismatch(url, title, body)], xxhash.xxh64_intdigest(message) - (1 << 63), url, host_of(url)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.bool_()), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "reason", "odds", "words", "terms", "message", "url", "host"])

    seen = cut(pages.select("page_id", "url", "title", "relevant_content").mapInArrow(run, "page_id bigint, reason string, odds double, words int, terms array<boolean>, message bigint, url string, host string"))
    decided = seen.filter(F.col("reason") != "notice").select("page_id", "reason", F.col("odds").alias("score"))
    low = seen.filter(F.col("reason") == "notice")
    # addresses that give a message, as a share of the host's addresses and of all addresses
    here = low.groupBy("message", "host").agg(F.count_distinct("url").alias("n"))
    everywhere = here.groupBy("message").agg(F.sum("n").alias("everywhere"))
    sizes = pages.groupBy(host_column(F.col("url")).alias("host")).agg(F.approx_count_distinct("url", 0.02).alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    share = lambda n, of: F.greatest(n - 1, F.lit(0)) / (of + PRIOR)
    counts = here.join(everywhere, "message").join(sizes, "host", "left").crossJoin(F.broadcast(total))  # total is one row
    counts = counts.select("message", "host", F.greatest(share(F.col("n"), F.coalesce("size", F.lit(0))), share(F.col("everywhere"), F.col("total"))).alias("share"))
    both = low.join(counts, ["message", "host"], "left").select("page_id", "odds", "words", "terms", F.coalesce("share", F.lit(0.0)).alias("share"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *evidence = batch.columns
            chance = score.chances(*(c.to_pylist() for c in evidence)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([ids, pa.array(["notice"] * batch.num_rows), pa.array(chance, pa.float64())], names=["page_id", "reason", "score"])

    return decided.unionByName(both.mapInArrow(judge, "page_id bigint, reason string, score double").filter(F.col("score") >= LEAST))


def host_of(url: str | None) -> str:
    """Lower-case host of an address, empty for null."""
    return (url or "").partition("//")[2].partition("/")[0].lower()


def host_column(url):
    """``host_of`` as a column."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^.*?//([^/]*)", 1))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Pages that are unfilled templates, filler text, errors or notices."""
    return template_residue(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id").distinct()

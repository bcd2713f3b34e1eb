"""Languages of records and segments by a linear-chain conditional random field over words.

Word features (the word itself, affixes, letter trigrams, script) with weights for five languages, "other" and "none" (names,
filler, codes) plus learned transitions; forward-backward gives each word's marginals. A unit (a line of a page, a
sentence of a question) gets the language with the largest mass and that mass as confidence. Every non-blank line or
sentence, quotations and addresses included, is also cut into segments where the labelling changes.

Edge cases: null or blank texts and texts without a letter have no units; a null, blank or unknown label names nothing;
units of any length are labelled whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import phrases, pii_training
from .boilerplate import LineModel, line_model, slices

#: The languages told apart, and a class for all further ones.
LANGS = ("en", "ar", "fr", "de", "es", "other")
NONE = len(LANGS)
#: Labelled training units.
TRAINING_UNITS = 3200
#: Distinct words whose evidence a worker keeps; the memo is emptied when full.
MEMO = 400_000
#: A unit is whole in a language if this share of its word marginals is.
WHOLE = 0.7
# Words of filler text, which are in no language.
FILLER = "lorem ipsum dolor sit amet elit sed donec vitae nunc porta morbi justo ligula congue arcu quis nibh velit urna consectetur adipiscing eiusmod tempor incididunt labore magna aliqua pellentesque habitant tristique senectus netus malesuada fames turpis egestas".split()
# English names of languages in labels.
NAMES = {"english": "en", "arabic": "ar", "french": "fr", "german": "de", "spanish": "es"}
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"(\{[^{}]*\})")
_BREAK = re.compile(r"\n+|(?<=[.?!؟])\s+(?!(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b)(?=[¿¡«\"(]*(?:[^\W\d_a-z]|[a-zà-ÿ]{2}))")
_ABBREVIATION = re.compile(r"(?:^|\s)(?:[^\W\d_]|Dr|Mr|Ms|Mrs|Mme|Sr|Sra|Dra|Prof|Professor|tel|tél|no|str|avda|ave)\.$", re.I)
_QUOTED = re.compile(r"[(]?«[^»]*»[)]?")
_ADDRESS = re.compile(r"\S*(?:@|[\[]at[\]])\S*", re.I)
_BULLET = re.compile(r"\s*(?:[•*›»–-]|\d{1,2}\.)\s")


def word_features(word: str) -> list[str]:
    """Features of one lower-case word."""
    padded = f"^{word}$"
    script = "A" if "؀" <= word[0] <= "ۿ" else "L" if word[0] < "\u0370" else "X"
    return ["s" + script, "w" + word, "p" + padded[:3], "p" + padded[:4], "e" + padded[-3:], "e" + padded[-4:], "e" + padded[-5:], *{"t" + padded[i : i + 3] for i in range(len(padded) - 2)}, *(["d" + c for c in set(word) if c > "\x7f" and script == "L"])]


def _training_unit(rnd: random.Random) -> list[tuple[str, int]]:
    """Words with labels: one unit, sometimes with a part in another language or a quoted title."""

    def words(lang: str, template: str) -> list[tuple[str, int]]:
        out = []
        if lang == "other":
            return [(w, LANGS.index(lang)) for w in _WORD.findall(template.lower())]
        for piece in _PART.split(template):
            slot = piece.startswith("{")
            if slot and piece[1:-1] in ("P", "p", "A", "t", "G", "h", "E", "B", "O"):
                piece, label = rnd.choice([*pii_training.GIVEN[lang], "{N}"]) + " {N}", NONE
                piece = phrases.fill(piece, lang, rnd)
            elif slot and piece == "{F}":
                piece, label = phrases.fill(piece, lang, rnd), LANGS.index(lang)
            elif slot:
                piece, label = phrases.fill("{N}" if piece == "{N}" else "{C}", lang, rnd), NONE
            else:
                label = LANGS.index(lang)
            out += [(w, label) for w in _WORD.findall(piece.lower())]
        return out

    def unit(lang: str) -> list[tuple[str, int]]:
        r = rnd.random()
        if lang == "other":
            return words(lang, rnd.choice(rnd.choice(list(phrases.OTHER.values()))))
        if r < 0.25:
            return words(lang, " ".join(rnd.choice(p) for p in phrases.MODAL[lang]))
        if r < 0.55:
            return words(lang, " ".join(rnd.choice(p) for p in phrases.PROSE[lang]))
        if r < 0.75:
            return words(lang, rnd.choice(pii_training.SENTENCES[lang]))
        return words(lang, rnd.choice(phrases.FURNITURE[lang] + phrases.HEADINGS[lang] + phrases.ENTRIES[lang] + phrases.SINGLES[lang] + phrases.TALK[lang] + phrases.NOTICES[lang] + phrases.MENU[lang] + phrases.TITLES[lang] + phrases.QUESTIONS[lang]))

    if rnd.random() < 0.06:
        return [(rnd.choice(FILLER), NONE) for _ in range(rnd.randint(6, 16))]
    lang = rnd.choice(LANGS)
    out = unit(lang)
    if rnd.random() < 0.3:
        out += unit(lang)
    if rnd.random() < 0.3:
        other = rnd.choice(LANGS[:-1])
        out = out + unit(other) if rnd.random() < 0.6 else out + words(other, rnd.choice(phrases.TITLES[other]))
    return out


class LanguageModel:
    """Weights of word features and transitions, fitted by gradient ascent on the likelihood of labelled units."""

    def __init__(self) -> None:
        rnd = random.Random(5)
        units = [u for _ in range(TRAINING_UNITS) if (u := _training_unit(rnd))]
        vocab = sorted({w for u in units for w, _ in u})
        index: dict[str, int] = {}
        feats = [[index.setdefault(f, len(index)) for f in word_features(w)] for w in vocab]
        place = {w: i for i, w in enumerate(vocab)}
        flat = np.array([f for fs in feats for f in fs])
        first = np.r_[0, np.cumsum([len(f) for f in feats])[:-1]]
        which = np.repeat(np.arange(len(vocab)), [len(f) for f in feats])
        tokens = np.array([place[w] for u in units for w, _ in u])
        gold = np.array([l for u in units for _, l in u])
        lens = np.array([len(u) for u in units])
        k = NONE + 1
        w, trans = np.zeros((len(index), k)), np.zeros((k, k))
        gw, gt = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
        observed_t = np.zeros((k, k))
        inner = np.ones(len(tokens), bool)
        inner[np.r_[0, np.cumsum(lens)[:-1]]] = False
        np.add.at(observed_t, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
        onehot = np.eye(k)[gold]
        for _ in range(110):
            unary = np.add.reduceat(w[flat], first, axis=0)[tokens]
            p, pair = forward_backward(unary, lens, trans, pairs=True)
            diff = np.zeros((len(vocab), k))
            np.add.at(diff, tokens, onehot - p)
            g = np.zeros_like(w)
            np.add.at(g, flat, diff[which])
            g = g / len(units) - 5e-5 * w
            t = (observed_t - pair) / len(units) - 2e-4 * trans
            gw += g * g
            gt += t * t
            w += 0.3 * g / np.sqrt(gw)
            trans += 0.3 * t / np.sqrt(gt)
        self.transitions = trans
        self.weights = {f: w[i] for f, i in index.items() if np.abs(w[i]).max() > 1e-3}

    def evidence(self, word: str) -> np.ndarray:
        """Scores of one lower-case word for the languages and "none"."""
        zero = np.zeros(NONE + 1)
        return sum((self.weights[f] for f in word_features(word) if f in self.weights), zero)


def forward_backward(unary: np.ndarray, lens: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of all words of all units at once (units laid end to end, none empty); optionally expected transitions."""
    n, k = unary.shape
    order = np.argsort(-lens, kind="stable")
    start = np.r_[0, np.cumsum(lens)[:-1]][order]
    size = lens[order]
    alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if len(size) else []
    e = np.exp(unary - unary.max(1, keepdims=True))
    t = np.exp(trans - trans.max())
    alpha, beta = np.empty((n, k)), np.ones((n, k))
    for step, m in enumerate(alive):
        at = start[:m] + step
        a = e[at] if not step else (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((k, k))
    for step in range(len(alive) - 1, 0, -1):
        at = start[: alive[step]] + step
        onward = e[at] * beta[at]
        if pairs:
            joint = alpha[at - 1][:, :, None] * t[None] * onward[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = onward @ t.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    return (p, expected) if pairs else p


@lru_cache(maxsize=1)
def language_model() -> LanguageModel:
    """The model, fitted once in a process."""
    return LanguageModel()


def sentences(text: str) -> list[str]:
    """Sentences of a text: at line breaks and after ``.?!``, but not after initials and forms of address."""
    out: list[str] = []
    for part in _BREAK.split(text):
        if out and _ABBREVIATION.search(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return [s for s in out if s.strip()]


def paragraph_lines(text: str) -> list[str]:
    """Lines of running text: no list entries, and long enough or closed by punctuation."""
    out = []
    for line in text.split("\n"):
        if "«" in line:
            line = _QUOTED.sub(" ", line).strip()
        n = line.count(" ")
        if n >= 3 and (n >= 8 or line.rstrip(" »)\"'”").endswith((".", "?", "!", "؟", ";", "…"))) and not _BULLET.match(line):
            out.append(line)
    return out


def unit_marginals(units: list[str], model: LanguageModel, memo: dict[str, int], table: list[np.ndarray], every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each unit, marginals of all words); quotations and addresses count only with ``every``."""
    ids: list[int] = []
    lens = np.zeros(len(units), np.int64)
    for i, u in enumerate(units):
        if "«" in u and not every:
            u = _QUOTED.sub(" ", u)
        if ("@" in u or "[" in u) and not every:
            u = _ADDRESS.sub(" ", u)
        words = _WORD.findall(u.lower())
        lens[i] = len(words)
        for w in words:
            at = memo.get(w)
            if at is None:
                at = memo[w] = len(table)
                table.append(model.evidence(w))
            ids.append(at)
    k = NONE + 1
    if not ids:
        return lens, np.zeros((0, k))
    unary = np.array(table)[ids]
    return lens, forward_backward(unary, lens[lens > 0], model.transitions)


def languages(df: DataFrame, key: str, text: str, kind: str, segments: bool = False) -> DataFrame:
    """Languages of each record's units.

    ``kind`` is ``paragraphs`` or ``sentences``. One row per unit: (rec_id, unit_no INT from 1, lang, confidence DOUBLE,
    unit): the language of the whole unit, null where none reaches ``WHOLE`` of the word mass. With ``segments`` instead
    one row per run of words in one language: (rec_id, unit_no, first_word INT, n_words INT, lang, confidence). Units are
    then all non-blank lines instead of paragraphs, and quotations and addresses stay in them, so every word of a record
    is in one segment.
    """
    model = language_model()
    cut = sentences if kind != "paragraphs" else all_lines if segments else paragraph_lines
    schema = "rec_id bigint, unit_no int, first_word int, n_words int, lang string, confidence double" if segments else "rec_id bigint, unit_no int, lang string, confidence double, unit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        table: list[np.ndarray] = []
        for batch in slices(batches, 2000):
            if len(memo) > MEMO:
                memo.clear()
                table.clear()
            ids, units, numbers = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                us = cut(t) if t else []
                units += us
                ids += [i] * len(us)
                numbers += range(1, len(us) + 1)
            lens, p = unit_marginals(units, model, memo, table, segments)
            some = np.flatnonzero(lens)
            first = np.r_[0, np.cumsum(lens[some])[:-1]] if len(some) else np.zeros(0, np.int64)
            rows = []
            if segments:
                for j, a in zip(some.tolist(), first.tolist(), strict=True):
                    q = p[a : a + lens[j]]
                    best = q.argmax(1)
                    edges = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
                    rows += [(ids[j], numbers[j], s, e - s, LANGS[best[s]] if best[s] < NONE else None, float(q[s:e, best[s]].mean())) for s, e in zip(edges, edges[1:], strict=False)]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            else:
                mass = np.add.reduceat(p, first, axis=0) if len(some) else np.zeros((0, NONE + 1))
                # names and codes within a sentence belong to no language and leave its language unchanged
                counted = np.maximum(mass[:, :NONE].sum(1), 1e-9)
                best = mass[:, :NONE].argmax(1)
                share = mass[np.arange(len(some)), best] / counted
                real = mass[:, :NONE].sum(1) >= np.maximum(1.5, 0.35 * lens[some])
                for j, b, s, ok in zip(some.tolist(), best.tolist(), share.tolist(), real.tolist(), strict=True):
                    rows.append((ids[j], numbers[j], LANGS[b] if ok and s >= WHOLE else None, s, units[j]))
                types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return df.select(F.col(key).cast("long").alias("rec_id"), F.col(text).alias("t")).mapInArrow(run, schema)


def record_languages(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(rec_id, lang, confidence DOUBLE): one row per record, its language by the mass of its words in all units.

    ``lang`` is null for records without words in a language (null, blank, filler, numbers only).
    """
    model = language_model()
    cut = all_lines if kind == "paragraphs" else sentences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        table: list[np.ndarray] = []
        for batch in slices(batches, 2000):
            if len(memo) > MEMO:
                memo.clear()
                table.clear()
            units, owner = [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                us = cut(t) if t else []
                units += us
                owner += [r] * len(us)
            lens, p = unit_marginals(units, model, memo, table)
            mass = np.zeros((batch.num_rows, NONE + 1))
            np.add.at(mass, np.repeat(np.array(owner, np.int64), lens), p)
            total = mass[:, :NONE].sum(1)
            best = mass[:, :NONE].argmax(1)
            some = total >= 1.0
            share = mass[np.arange(len(mass)), best] / np.maximum(total, 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([LANGS[b] if ok else None for b, ok in zip(best.tolist(), some.tolist(), strict=True)], pa.string()), pa.array([s if ok else None for s, ok in zip(share.tolist(), some.tolist(), strict=True)], pa.float64())], names=["rec_id", "lang", "confidence"])

    return df.select(F.col(key).cast("long").alias("rec_id"), F.col(text).alias("t")).mapInArrow(run, "rec_id bigint, lang string, confidence double")


def all_lines(text: str) -> list[str]:
    """Non-blank lines of a text."""
    return [l for l in text.split("\n") if l and not l.isspace()]


def named(label):
    """The two-letter code a label column names, or null."""
    low = F.lower(F.trim(label))
    word = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    code = F.regexp_extract(low, r"^([a-z]{2})(?:[-_][a-z0-9]+)*$", 1)
    return F.coalesce(word[low], F.when(code != "", code))


def unlabelled(df: DataFrame, key: str, text: str, label: str, kind: str) -> DataFrame:
    """(rec_id, lang): languages in which a record has a whole unit and which its label does not name.

    The work is one narrow pass; lines of pages must also be main text by the line model, which is asked only for lines
    whose language the label does not name.
    """
    model, lines = language_model(), line_model() if kind == "paragraphs" else None
    cut = paragraph_lines if kind == "paragraphs" else sentences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        table: list[np.ndarray] = []
        for batch in slices(batches, 2000):
            if len(memo) > MEMO:
                memo.clear()
                table.clear()
            keys, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            owner, units = [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                us = cut(t) if t else []
                units += us
                owner += [r] * len(us)
            found = _whole_units(units, owner, labels, model, lines, memo, table)
            yield pa.RecordBatch.from_arrays([pa.array([keys[r] for r, _ in found], pa.int64()), pa.array([l for _, l in found], pa.string())], names=["rec_id", "lang"])

    return df.select(F.col(key).cast("long").alias("rec_id"), F.col(text).alias("t"), named(F.col(label)).alias("named")).mapInArrow(run, "rec_id bigint, lang string")


def _whole_units(units, owner, labels, model: LanguageModel, lines: LineModel | None, memo, table) -> list[tuple[int, str]]:
    lens, p = unit_marginals(units, model, memo, table)
    some = np.flatnonzero(lens)
    if not len(some):
        return []
    mass = np.add.reduceat(p, np.r_[0, np.cumsum(lens[some])[:-1]], axis=0)
    total = mass[:, :NONE].sum(1)
    best = mass[:, :NONE].argmax(1)
    ok = (mass[np.arange(len(some)), best] >= WHOLE * np.maximum(total, 1e-9)) & (total >= np.maximum(1.5, 0.35 * lens[some]))
    out = set()
    for j, b in zip(some[ok].tolist(), best[ok].tolist(), strict=True):
        r, lang = owner[j], LANGS[b]
        if lang not in (labels[r], "other") and (r, lang) not in out and (lines is None or lines.evidence(units[j]) + lines.prior > 0):
            out.add((r, lang))
    return sorted(out)


_PARTS = (("pages", "page_id", "relevant_content", "paragraphs"), ("question_analysis", "question_id", "original_question", "sentences"))


def _union(spark, sf_dir: str, one) -> DataFrame:
    first, second = (one(spark.read.parquet(f"{sf_dir}/{t}.parquet"), k, c, kind).withColumn("src", F.lit(t)) for t, k, c, kind in _PARTS)
    return first.unionByName(second)


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Languages of whole paragraph lines and sentences that the record's label does not name."""
    return _union(spark, sf_dir, lambda df, k, c, kind: unlabelled(df, k, c, "language", kind)).select("src", "rec_id", "lang").distinct()


def p2_records(spark, sf_dir: str) -> DataFrame:
    """The language of every record with a confidence."""
    return _union(spark, sf_dir, lambda df, k, c, kind: record_languages(df, k, c, kind).distinct()).select("src", "rec_id", "lang", "confidence")


def p2_segments(spark, sf_dir: str) -> DataFrame:
    """The segments of every record: runs of words in one language, with a confidence."""
    return _union(spark, sf_dir, lambda df, k, c, kind: languages(df, k, c, kind, segments=True).distinct()).select("src", "rec_id", "unit_no", "first_word", "n_words", "lang", "confidence")

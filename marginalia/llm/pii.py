"""Personal data in free text: candidate gradient boosting.

High-recall generators propose overlapping spans of five types (e-mail address, phone number, identity number, street
address, name of a person). For each type, boosted trees judge a span by its format and its context, isotonic
calibration turns scores into probabilities, and a threshold chosen on held-out calibration texts selects; where
selected spans overlap, the more probable one stays. ``find_personal_data`` lists the spans, ``redact`` replaces each by
``[TYPE]`` and leaves all other characters as they are.

Edge cases: null and blank texts have no spans (``redact`` keeps null null and blank blank); texts of any length are
read whole; repeated rows give repeated spans before ``distinct``.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_training as T
from .boilerplate import line_model, slices
from .learn import BoostedTrees, isotonic
from .spam import FUNCTION

TYPES = ("email", "phone", "id_number", "address", "name")
#: Lines whose spans a worker keeps for reuse (emptied when full), and the longest of them.
MEMO, MEMO_LENGTH = 200_000, 200
#: Words rarer than one in ``2 ** RAREST`` records count alike; records added to any table when shares are computed.
RAREST, PRIOR = 12, 500
#: Words that stand in more than one of ``2 ** USUAL`` records do not make a name together.
USUAL = 8
#: Generators that give a type of another name.
_TYPE = {"pair": "name"}
#: Labelled training texts (the last third of them calibrates).
TRAINING_TEXTS = 9000

#: Share of the training names (addresses) that the gate on pairs of words (on house numbers) lets through.
GATE = 0.995
# Small words within names and within addresses.
PARTICLES = frozenset(["de", "da", "do", "dos", "del", "della", "di", "du", "des", "la", "le", "van", "von", "vom", "zu", "der", "den", "ter", "bin", "bint", "ibn", "al", "el", "y", "e", "af", "ben"])
STREET_PARTICLES = PARTICLES | frozenset(["les", "of", "the", "las", "los", *(k.lower() for k in T.STREETS["fr"])])
# Determiners and pointing words that never begin a name.
NO_NAME = frozenset(["here", "there", "these", "those", "dear", "hello", "hi", "ici", "voici", "notre", "votre", "nos", "vos", "mon", "ma", "mes", "hier", "dort", "unser", "unsere", "mein", "meine", "ihr", "ihrem", "ihren", "ihrer", "sein", "seine", "kein", "keine", "jede", "jeder", "jedes", "aquí", "allí", "nuestro", "nuestra", "este", "esta", "estos", "cada", "chaque"])
_TITLE_WORDS = frozenset(t.strip().rstrip(".").lower() for ts in T.TITLES.values() for t in ts)
_UPPER = "".join(chr(c) for c in range(0x41, 0x590) if chr(c).isupper())
_PART = rf"[{_UPPER}](?:\.|[\w'’]+(?:-[^\W\d_][\w'’]*)*)"
_CAPITALISED = re.compile(rf"(?<![\w'’-]){_PART}(?: (?:(?:{'|'.join(sorted(PARTICLES))}) ){{0,3}}{_PART})+")
_NAME_PART = re.compile(r"[^\W\d_](?:\.|[\w'’]*(?:-[^\W\d_][\w'’]*)*)")
_ARABIC_LETTER = re.compile("[\u0621-\u06ff]")
_ARABIC_RUN = re.compile("[\u0621-\u06ff]+(?: [\u0621-\u06ff]+)+")
_LATIN_RUN = re.compile(r"[^\W\d_؀-ۿ]{2,}(?: [^\W\d_؀-ۿ]{2,})+")
_NUMBER = re.compile(r"\d(?:[\d ().\-/]{3,}\d)")
_ATS = [
    re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"),
    re.compile(r"[\w.+%-]+\s?[\[(]at[\])]\s?[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[\w-]+)+", re.I),
    re.compile(r"[\w.+%-]+\sat\s[\w-]+(?:\.[\w-]+)*(?:\sdot\s[\w-]+)+", re.I),
]
_SENTENCE_END = re.compile(r"[.!?؟]\s|\n")
_HOUSE = re.compile(r"(?<![\d.,:/+(\-–])\d{1,4}[a-z]?(?![\w:/–]|[.,-]\d)")
_AFTER_HOUSE = re.compile(r"(?:[ ,]+(?:bis|ter)\b)?,? ")
_NUMBER_SIGNS = frozenset(["n.º", "nº", "n.", "º", "núm.", "no.", "nr.", "رقم", "مبنى"])
_ADDRESS_WORD = re.compile(r"[^\W\d_][\w'’/-]*\.?/?")
_DATE = re.compile(r"\d{1,2}([./-])\d{1,2}\1\d{2,4}|\d{4}([./-])\d{1,2}\2\d{1,2}")
_DIGITS = re.compile(r"\d+")
_CAPITALS = re.compile(r"[^a-zß-öø-ÿ\n]*(?:\n|$)")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_WORDS = re.compile(r"\w+|[^\w\s]")


def _arabic(word: str) -> bool:
    return "\u0621" <= word[0] <= "\u06ff"


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed (generator, start, end) spans; spans may overlap. Generators: email, number, address, name, pair.

    Names are proposed by form alone: every run of two or three capitalised words or initials (small words within),
    and, where letter case says nothing (Arabic, sentences without a capital), every pair of neighbouring words that are
    no function words ("pair"; a learned gate thins these out). Addresses: every small number with the words beside it.
    """
    found: set[tuple[str, int, int]] = set()
    low = text.lower()
    if "@" in low or "(at)" in low or "[at]" in low or " at " in low and " dot " in low:
        for rule in _ATS:
            for m in rule.finditer(text):
                found.add(("email", m.start(), m.end()))
    for m in _NUMBER.finditer(text):
        _numbers(text, *m.span(), found)
    for m in _HOUSE.finditer(text):
        _addresses(text, m.start(), m.end(), found)
    _names(text, found)
    return sorted(found)


def _numbers(text: str, a: int, b: int, found: set) -> None:
    """A run of digits with what may belong to it: a leading sign, letters before or after."""
    if sum(c.isdigit() for c in text[a:b]) < 6:
        return
    while a and text[a - 1] in "+(":
        a -= 1
    if b < len(text) and text[b].isupper() and (b + 1 == len(text) or not text[b + 1].isalnum()):
        b += 1
    elif text[b : b + 1] == " " and text[b + 1 : b + 2].isupper() and not text[b + 2 : b + 3].isalnum():
        b += 2
    found.add(("number", a, b))
    p = a
    if p and text[p - 1] in " -/" and p > 1 and text[p - 2].isupper():
        p -= 1
    while p and "A" <= text[p - 1] <= "Z" and a - p < 5:
        p -= 1
    if p < a and (not p or not text[p - 1].isalnum()) and text[p].isupper():
        found.add(("number", p, b))


def _addresses(text: str, a: int, b: int, found: set) -> None:
    """A house number with the words after it, or with one to five words before it."""
    end, named, n, m = b, False, 0, _AFTER_HOUSE.match(text, b)
    at = m.end() if m else -1
    while at >= 0 and (m := _ADDRESS_WORD.match(text, at)):
        word = m.group()
        proper = word[0].isupper() or _arabic(word)
        if not proper and word.lower() not in STREET_PARTICLES or n == 5 or n == 3 and _arabic(word):
            break
        named |= proper
        end, n = m.end(), n + 1
        at = end + 1 if text[end : end + 1] == " " else -1
    if named:
        found.add(("address", a, end))
    words = text[text.rfind("\n", 0, a) + 1 : a].rsplit(" ", 8)
    if words[-1]:
        return
    start, n = a, 0
    for word in words[-2:0:-1] if len(words) > 8 else words[-2::-1]:
        start -= len(word) + 1
        bare = word.rstrip(",،")
        if not bare or not bare[0].isalpha() or n == 5:
            if bare.lower() in _NUMBER_SIGNS and not n:
                continue
            break
        if bare.lower() in _NUMBER_SIGNS and not n:
            continue
        n += 1
        if bare[0].isupper() or _arabic(bare) or "/" in bare:
            found.add(("address", start, b))


def _names(text: str, found: set) -> None:
    for m in _CAPITALISED.finditer(text):
        _capitalised(text, m.start(), m.end(), found)
    if _ARABIC_LETTER.search(text):
        for m in _ARABIC_RUN.finditer(text):
            _pairs(m.group(), m.start(), found)
    at = 0
    for m in _SENTENCE_END.finditer(text + "\n"):
        part = text[at : m.start()]
        if part and part == part.lower() and _LATIN_RUN.search(part):
            for r in _LATIN_RUN.finditer(part):
                _pairs(r.group(), at + r.start(), found)
        at = m.end()


def _capitalised(text: str, a: int, b: int, found: set) -> None:
    """Spans of two or three capitalised words or initials within a run, small words between them included."""
    parts = [(m.group(), m.start(), m.end()) for m in _NAME_PART.finditer(text, a, b)]
    for i, (word, start, _) in enumerate(parts):
        low = word.lower()
        if not word[0].isupper() or low in FUNCTION or low in NO_NAME or low.rstrip(".") in _TITLE_WORDS:
            continue
        count = 1
        for other, _, end in parts[i + 1 :]:
            if other[0].isupper():
                count += 1
                if other[-1] != ".":
                    found.add(("name", start, end))
                if count == 3:
                    break


def _pairs(run: str, at: int, found: set) -> None:
    """Pairs of neighbouring words that are no function words."""
    words = run.split(" ")
    for first, second in zip(words, words[1:], strict=False):
        if len(second) > 2 and len(first) > 1 and first != second and first not in FUNCTION and second not in FUNCTION:
            found.add(("pair", at, at + len(first) + 1 + len(second)))
        at += len(first) + 1


def _mask(s: str) -> str:
    return "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s)


def level(count: float, rows: int) -> float:
    """How rare a word is that stands in ``count`` of ``rows`` records: the negated binary logarithm of its share.

    One record proves nothing, and ``PRIOR`` records are added, so that in a small table every word is rare.
    """
    return float(min(RAREST, -np.log2(max(count - 1, 1e-9) / (rows + PRIOR))))


def rarity(word: str, levels: dict[str, float]) -> float:
    """Level of the most frequent run of letters of a word."""
    known = levels.get(word)
    return known if known is not None else min((levels.get(w, RAREST) for w in _LETTERS.findall(word)), default=RAREST)


def word_levels(texts: DataFrame) -> dict[str, float]:
    """Levels below ``RAREST`` of the words of all texts (one string column).

    Counted over all rows with partial aggregates. A word qualifies by its share of the rows, so the result holds at
    most ``2 ** RAREST`` times the mean number of distinct words of a record, whatever the number of rows.
    """
    only = texts.toDF("t").filter(F.col("t").isNotNull())
    rows = only.count()
    words = only.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") - 1 >= F.lit((rows + PRIOR) * 2.0**-RAREST))
    return {r["w"]: level(r["n"], rows) for r in often.collect()}


class PersonalDataModel:
    """One calibrated tree ensemble and threshold for each type, and the gate on pairs without capitals."""

    def __init__(self) -> None:
        rnd = random.Random(11)
        self.common = line_model().words
        self.named = self.common | {w.lower() for table in (T.BODIES, T.BUILDINGS) for ws in table.values() for w in ws}
        cut = TRAINING_TEXTS * 2 // 3
        data = []
        for i in range(TRAINING_TEXTS):
            text, spans = T.labelled_text(rnd, i % 2)
            truth = set(spans)
            data += [(i >= cut, i % 2, text, c, truth) for c in candidates(text)]
        counts = Counter(w for text in {t for _, _, t, _, _ in data} for w in set(_LETTERS.findall(text.lower())))
        levels = {w: level(n, TRAINING_TEXTS) for w, n in counts.items()}
        # evidence counted on one half of the sentences describes the other half, so the trees learn what unseen
        # sentences look like; the final evidence is counted on both
        names = [(h, t, c, ("name", c[1]) in truth) for held, h, t, c, truth in data if c[0] in ("name", "pair") and not held]
        gates = [self._gate_odds([r[1:] for r in names if r[0] != h], levels) for h in (0, 1)]
        self.gate = self._gate_odds([r[1:] for r in names], levels)
        self.least = {}
        for kind in ("name", "pair"):
            scores = [sum(gates[h].get(k, 0.0) for k in self._gate_keys(t, c, levels)) for h, t, c, label in names if label and c[0] == kind]
            self.least[kind] = float(np.quantile(scores, 1 - GATE))
        places = [(h, t, c, ("address", c[1]) in truth) for held, h, t, c, truth in data if c[0] == "address" and not held]
        for gate, rows in zip((*gates, self.gate), ([r for r in places if r[0] != h] for h in (0, 1, 2)), strict=True):
            gate |= self._street_odds([r[1:] for r in rows])
        best = [max((gates[h].get(k, -9.0) for k in self._inner(t[c[1] : c[2]], False)), default=-9.0) for h, t, c, label in places if label]
        self.least_street = float(np.quantile(best, 1 - GATE))
        self.models = {}
        for kind in (*TYPES, "pair"):
            rows = [(held, h, t, c, (_TYPE.get(kind, kind), c[1]) in truth) for held, h, t, c, truth in data if self._generated(kind, c) and self._passes(t, c, gates[h], levels)]
            y = np.array([r[4] for r in rows], float)
            held = np.array([r[0] for r in rows])
            halves = [self._context_odds([r[2:] for r in rows if not r[0] and r[1] != h]) for h in (0, 1)]
            x = np.array([self._features(t, c, halves[h], levels) for _, h, t, c, _ in rows], float)
            trees = BoostedTrees(rounds=60, depth=3, rate=0.15, min_child=10.0).fit(x[~held], y[~held])
            raw = trees.predict(x[held])
            scale = isotonic(raw, y[held])
            p = np.interp(raw, *scale)
            grid = np.linspace(0.1, 0.9, 33)
            f1 = [2 * (y[held] * (p >= g)).sum() / max(1.0, (p >= g).sum() + y[held].sum()) for g in grid]
            best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
            self.models[kind] = (self._context_odds([r[2:] for r in rows if not r[0]]), trees, scale, float(grid[best[len(best) // 2]]))

    @staticmethod
    def _generated(kind: str, candidate: tuple[str, int, int]) -> bool:
        return candidate[0] in {"phone": ("number",), "id_number": ("number",), }.get(kind, (kind,))

    def _gate_odds(self, rows: list[tuple[str, tuple, bool]], levels: dict[str, float]) -> dict:
        """Log odds of beginnings and endings of a name's words and of the words beside it."""
        counts: dict = defaultdict(lambda: [0.0, 0.0])
        total = [1.0, 1.0]
        for text, c, label in rows:
            total[label] += 1
            for key in self._gate_keys(text, c, levels):
                counts[key][label] += 1
        return {k: float(np.log((v[1] + 0.5) / (total[1] + 1)) - np.log((v[0] + 0.5) / (total[0] + 1))) for k, v in counts.items() if sum(v) >= 3}

    def _street_odds(self, rows: list[tuple[str, tuple, bool]]) -> dict:
        """Log odds of words and endings within an address."""
        counts: dict = defaultdict(lambda: [0.0, 0.0])
        total = [1.0, 1.0]
        for text, (_, a, b), label in rows:
            total[label] += 1
            for key in set(self._inner(text[a:b], False)):
                counts[key][label] += 1
        return {k: float(np.log((v[1] + 0.5) / (total[1] + 1)) - np.log((v[0] + 0.5) / (total[0] + 1))) for k, v in counts.items() if sum(v) >= 3}

    def _gate_keys(self, text: str, candidate: tuple[str, int, int], levels: dict[str, float]) -> list[tuple[str, str]]:
        _, a, b = candidate
        first, _, last = text[a:b].lower().rpartition(" ")
        before, after = text[max(0, a - 24) : a].rpartition("\n")[2].split(), text[b : b + 16].split(" ", 2)
        left = before[-1].lower() if before else "^"
        # no beginnings or endings of invented names: they would be learned and never recur
        shape = f"{last[:2] == 'ال'}{last[-1:] in 'يةا'}{first[:2] == 'ال'}{first[:1] in 'ويتبن'}" if candidate[0] == "pair" else "cased"
        return [("l", left), ("r", (after[0] or (after[1] if len(after) > 1 else "$")).lower()), ("k", f"{rarity(first, levels) // 2} {rarity(last, levels) // 2}"), ("h", shape)]

    def _passes(self, text: str, candidate: tuple[str, int, int], gate: dict, levels: dict[str, float]) -> bool:
        if candidate[0] == "address":
            get = gate.get
            return any(get(k, -9.0) >= self.least_street for k in self._inner(text[candidate[1] : candidate[2]], False))
        least = self.least.get(candidate[0])
        if least is not None:
            first, _, last = text[candidate[1] : candidate[2]].lower().rpartition(" ")
            if rarity(first, levels) < USUAL and rarity(last, levels) < USUAL:
                return False
        return least is None or sum(gate.get(k, 0.0) for k in self._gate_keys(text, candidate, levels)) >= least

    @staticmethod
    def _context(text: str, a: int, b: int) -> tuple[list[str], list[str], str]:
        left = [w.lower() for w in _WORDS.findall(text[max(0, a - 42) : a].rpartition("\n")[2])][-4:]
        right = [w.lower() for w in _WORDS.findall(text[b : b + 28].partition("\n")[0])][:3]
        fold = lambda w: "0" if w[0].isdigit() else w
        span = text[a:b]
        return [fold(w) for w in left], [fold(w) for w in right], _mask(span) if any(c.isdigit() for c in span) else ""

    def _context_odds(self, rows) -> dict:
        """Log odds of each context word by side, of words within and of each format, smoothed toward no evidence."""
        counts: dict = defaultdict(lambda: [0.0, 0.0])
        total = [1.0, 1.0]
        for text, (kind, a, b), label in rows:
            left, right, mask = self._context(text, a, b)
            total[label] += 1
            for key in {("f", mask), ("l1", *left[-1:]), *(("l", w) for w in left), ("l2", *left[-2:]), *(("r", w) for w in right), ("r1", *right[:1]), ("r2", *right[:2]), *self._inner(text[a:b], kind in ("name", "pair"))}:
                counts[key][label] += 1
        return {k: float(np.log((v[1] + 0.5) / (total[1] + 1)) - np.log((v[0] + 0.5) / (total[0] + 1))) for k, v in counts.items() if sum(v) >= 3}

    def _inner(self, span: str, name: bool) -> list[tuple[str, str]]:
        """Words within a span; of a name only common ones, as its own words would be learned by heart."""
        words = re.findall(r"[^\W\d_]+/?", span.lower())
        if name:
            return [("s", w) for w in words if w in self.named]
        return [("s", w) for w in words] + [("x", w[-k:]) for w in words for k in (3, 4, 5, 6) if len(w) > k + 1] + [("0", w) for w in words[:1]]

    def _features(self, text: str, cand: tuple[str, int, int], odds: dict, levels: dict[str, float]) -> list[float]:
        kind, a, b = cand
        left, right, mask = self._context(text, a, b)
        get = odds.get
        ls, rs = [get(("l", w), 0.0) for w in left], [get(("r", w), 0.0) for w in right]
        span = text[a:b]
        parts = span.split(" ")
        first, last = parts[0].lower().strip(".,"), parts[-1].lower().strip(".,")
        named = kind in ("name", "pair")
        inner = [get(k, 0.0) for k in self._inner(span, named)] or [0.0]
        groups = [0] if named else [len(g) for g in _DIGITS.findall(span)] or [0]
        before, after = text[max(0, a - 2) : a], text[b : b + 2]
        return [
            get(("f", mask), 0.0), get(("l1", *left[-1:]), 0.0), get(("l2", *left[-2:]), 0.0), get(("r1", *right[:1]), 0.0), get(("r2", *right[:2]), 0.0), sum(ls), sum(rs), max(ls, default=0.0), min(ls, default=0.0), max(rs, default=0.0), min(rs, default=0.0),
            parts[0][-1:] == ".", parts[0][:1].isupper(), parts[-1][:1].isupper(), parts[-1][:2] == "ال", len(parts), sum(groups), len(groups), max(groups), min(groups), 0 if named else sum(map(str.isalpha, span)),
            (span[0] == "+") + 2 * (span[0] == "(") + 3 * (span[:2] in ("00", "٠٠")) + 4 * (span[0] in "0٠" and span[1:2] not in ("0", "٠")), ("-" in span) + 2 * ("/" in span) + 4 * ("." in span), "@" in span, b - a, a == 0 or text[a - 1] == "\n", after[:1] in ("", "\n", "."), after[:1] in (",", "(", "،", ")"),
            sum(inner), max(inner), min(inner), rarity(first, levels), rarity(last, levels), len(last), _CAPITALS.match(text, text.rfind("\n", 0, a) + 1) is not None, before[-1:] == " " and before[:1].isupper(), after[:1] == " " and after[1:].isupper(), kind == "pair",
            not named and _DATE.fullmatch(span) is not None, bool(left) and left[-1] in FUNCTION, bool(right) and right[0] in FUNCTION, span[0].isdigit(),
        ]

    def spans(self, texts: list[str | None], levels: dict[str, float], memo: dict[str, list] | None = None) -> list[list[tuple[str, int, int, float]]]:
        """For each text its selected (type, start, end, probability) spans, without overlaps, in order.

        ``levels`` are those of the corpus. Texts are read line by line, as no evidence crosses a line; ``memo`` keeps the
        spans of short lines for reuse.
        """
        memo = {} if memo is None else memo
        if len(memo) > MEMO:
            memo.clear()
        fresh = list({l for t in texts if t for l in t.split("\n") if l not in memo})
        known = dict(zip(fresh, self._line_spans(fresh, levels), strict=True))
        out = []
        for t in texts:
            spans, at = [], 0
            for l in t.split("\n") if t else ():
                found = known.get(l)
                spans += [(k, a + at, b + at, p) for k, a, b, p in (memo[l] if found is None else found)]
                at += len(l) + 1
            out.append(spans)
        memo.update((l, s) for l, s in known.items() if len(l) <= MEMO_LENGTH)
        return out

    def _line_spans(self, lines: list[str], levels: dict[str, float]) -> list[list[tuple[str, int, int, float]]]:
        cands, owner = [], []
        for i, t in enumerate(lines):
            c = [x for x in candidates(t) if self._passes(t, x, self.gate, levels)]
            cands += c
            owner += [i] * len(c)
        picked: list[list] = [[] for _ in lines]
        for kind, (odds, trees, scale, least) in self.models.items():
            at = [j for j, c in enumerate(cands) if self._generated(kind, c)]
            if not at:
                continue
            p = np.interp(trees.predict(np.array([self._features(lines[owner[j]], cands[j], odds, levels) for j in at], float)), *scale)
            for j, q in zip(at, p.tolist(), strict=True):
                if q >= least:
                    picked[owner[j]].append((_TYPE.get(kind, kind), cands[j][1], cands[j][2], q))
        out = []
        for spans in picked:
            kept: list = []
            for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
                if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
                    kept.append(s)
            out.append(sorted(kept, key=lambda s: s[1]))
        return out


@lru_cache(maxsize=1)
def personal_data_model() -> PersonalDataModel:
    """The model, fitted once in a process."""
    return PersonalDataModel()


def find_personal_data(df: DataFrame, key: str, text: str, levels: dict[str, float] | None = None) -> DataFrame:
    """(rec_id BIGINT, pii_type, start_pos INT from 1, length INT, probability) of every span.

    One pass counts words over all rows (unless ``levels`` of a larger corpus are given), one narrow pass finds.
    """
    model = personal_data_model()
    levels = word_levels(df.select(text)) if levels is None else levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list] = {}
        for batch in slices(batches, 3000):
            ids, spans = batch.column(0).to_pylist(), model.spans(batch.column(1).to_pylist(), levels, memo)
            rows = [(i, k, a + 1, b - a, p) for i, ss in zip(ids, spans, strict=True) for k, a, b, p in ss]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["rec_id", "pii_type", "start_pos", "length", "probability"])

    return df.select(F.col(key).cast("long").alias("rec_id"), F.col(text).alias("t")).mapInArrow(run, "rec_id bigint, pii_type string, start_pos int, length int, probability double")


def redact(df: DataFrame, text: str, out: str = "redacted", levels: dict[str, float] | None = None) -> DataFrame:
    """``df`` with column ``out``: the text with each span replaced by ``[EMAIL]``, ``[PHONE]``, ... ; null stays null."""
    model = personal_data_model()
    levels = word_levels(df.select(text)) if levels is None else levels

    @F.pandas_udf("string")
    def run(s):
        texts = [None if v is None or v != v else v for v in s]
        done = []
        for t, spans in zip(texts, model.spans(texts, levels), strict=True):
            for kind, a, b, _ in reversed(spans):
                t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
            done.append(t)
        return type(s)(done, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def _parts(spark, sf_dir: str) -> tuple[list[tuple[str, str, str, DataFrame]], dict[str, float]]:
    parts = [(t, k, c, spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t, k, c in (("user_messages", "message_id", "message"), ("pages", "page_id", "relevant_content"))]
    return parts, word_levels(parts[0][3].select("message").unionByName(parts[1][3].select(F.col("relevant_content").alias("message"))))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """One row for each occurrence of personal data in messages and pages."""
    parts, levels = _parts(spark, sf_dir)
    found = [find_personal_data(df, k, c, levels).select(F.lit(t).alias("src"), "rec_id", "pii_type", "start_pos") for t, k, c, df in parts]
    return found[0].unionByName(found[1]).distinct()


def p1_redacted(spark, sf_dir: str) -> DataFrame:
    """Messages and pages with placeholders for personal data: length and hash of every text."""
    parts, levels = _parts(spark, sf_dir)
    done = [redact(df.select(F.col(k).alias("rec_id"), F.col(c).alias("text")), "text", levels=levels).select(F.lit(t).alias("src"), "rec_id", F.length("redacted").alias("n_chars"), F.md5("redacted").alias("text_md5")) for t, k, c, df in parts]
    return done[0].unionByName(done[1]).distinct()

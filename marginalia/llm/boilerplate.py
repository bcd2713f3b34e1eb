"""Main text against page furniture (menus, notices, bylines, related links, footers).

A page is a tree: the page, its blocks (runs of neighbouring lines of one shape), their lines. Each node has a hidden
state: a page is *bare* or *framed*, a block *body* or *furniture*, a line main text or not. Parent-child potentials are
counted on labelled pages, a logistic model over words and shape gives each line's own evidence, and sum-product
messages, first upward then downward, give each line's marginal. All pages of an Arrow batch pass messages at once.

Edge cases: null or blank text has no lines and gives no rows; a repeated page_id gives rows for each copy before the
final ``distinct``; a line of any length is read whole.
"""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import phrases
from .learn import fit_logistic

#: Pairs of neighbouring words are features of lines of at most this many words; single words are of all lines.
PAIRED = 24
#: Letters of a word's beginning that count as a feature too.
STEM = 5
#: Words from which a closed sentence anchors the body of a page.
ANCHOR = 13
#: Labelled pages drawn for training.
TRAINING_PAGES = 3500
#: Lines whose evidence a worker keeps for reuse; the memo is emptied when full, so this bounds memory, not results.
MEMO = 200_000
#: Longer lines are not kept, as they seldom recur.
MEMO_LENGTH = 220
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_WORD = re.compile(r"[^\W_]+")
_BULLET = re.compile(r"\s*(?:([•*›»–-])\s|\d{1,2}\.\s)")
ENDS = (".", "!", "?", "؟", "…", ".)", ".»", "»)", ".\"")
#: Signs with which a bullet or a number begins, and the features of a line of so many words.
_BULLETS = frozenset("•*›»–-0123456789٠١٢٣٤٥٦٧٨٩")
_LENGTHS = [["n%d" % min(n, 4), "w%d" % (n >= 6), "w%d" % (2 + (n >= 10)), "w%d" % (4 + (n >= 18)), "w%d" % (6 + (n >= 30))] for n in range(31)]
_PIECES = re.compile(r"\s+[|·/»>›]\s+|\s{2,}")
_MARKS = ("|", "·", "/", "»", ">", ";", "#", "©", ":", "@", "(", "?", "!", "_", "{", "%", "[", "<")


def _shape(line: str) -> list[str]:
    """Shape features over the whole line."""
    text = line.strip()
    n = text.count(" ") + 1
    out = list(_LENGTHS[min(n, 30)])
    out += ["m" + m + str(min(text.count(m), 2)) for m in _MARKS if m in text]
    if text[0] in _BULLETS and (b := _BULLET.match(line)):
        out.append("b" + (b.group(1) or "1"))
    if text[-1] in ".?!؟":
        out.append("end" + text[-1])
    parts = _PIECES.split(text) if "  " in text or "|" in text or "·" in text or "/" in text or "»" in text or ">" in text or "›" in text else ()
    if len(parts) > 2:
        words = text.count(" ") + 1
        out.append("pieces%d" % min(len(parts), 6))
        out.append("piece%d%d" % (min(3, words // len(parts)), any(c.isdigit() for c in text)))
    return out


def _tokens(line: str) -> list[str]:
    return [t if t > ":" else "0" for t in _TOKEN.findall(line.lower())]


def _training_pages(rnd: random.Random) -> Iterator[list[tuple[str, int]]]:
    """Pages of labelled lines (1: main text) in one language each, framed or bare."""
    for _ in range(TRAINING_PAGES):
        lang = rnd.choice(list(phrases.MENU))
        yield _disturb(_training_page(lang, rnd), rnd)


def _training_page(lang: str, rnd: random.Random) -> list[tuple[str, int]]:
    fill = lambda t: phrases.fill(t, lang, rnd)
    furn = lambda: fill(rnd.choice(phrases.FURNITURE[lang]))
    page: list[tuple[str, int]] = []
    framed = rnd.random() < 0.75
    if framed:
        page += [(furn(), 0) for _ in range(rnd.randint(0, 3))]
        menu = rnd.sample(phrases.MENU[lang], rnd.randint(3, 11))
        bullet = rnd.choice(["", "", "• ", "- ", "› ", "* "])
        page += [(rnd.choice(["  ", " | ", " · ", " / ", " » "]).join(menu), 0)] if rnd.random() < 0.5 else [(bullet + m, 0) for m in menu]
        if rnd.random() < 0.5:
            last = fill(rnd.choice(phrases.TITLES[lang])) if rnd.random() < 0.75 else rnd.choice([*phrases.FAILED[lang], "{{ title }}", "%TITLE%"])
            page.append((rnd.choice([" > ", " / ", " » ", " › "]).join([rnd.choice(menu), fill(rnd.choice(phrases.TITLES[lang])), last][rnd.randint(0, 1) :]), 0))
        page += [(furn(), 0) for _ in range(rnd.choice([0, 0, 1, 2]))]
    if rnd.random() < 0.25:  # a page that holds a notice, filler or a heading and little else
        page += [(fill(rnd.choice(phrases.NOTICES[lang] if rnd.random() < 0.75 else phrases.FILLERS[lang])), 1)] * rnd.choice([1, 1, 1, 2])
        if rnd.random() < 0.4:
            page.append((rnd.choice([fill("  at {N}.{N}(core.{C}:{d})"), fill("({N})"), fill(rnd.choice(phrases.HEADINGS[lang])), "[%08x]" % rnd.getrandbits(32)]), 1))
    else:
        for _ in range(rnd.randint(1, 6)):
            kind = rnd.random()
            if kind < 0.5:
                text = " ".join(phrases.main_line(lang, rnd) for _ in range(rnd.choice([1, 1, 2, 3, 5])))
                page.append((text + (f" («{fill(rnd.choice(phrases.TITLES[lang]))}»)" if rnd.random() < 0.1 else ""), 1))
            elif kind < 0.7:
                page.append((fill(rnd.choice(phrases.HEADINGS[lang])), 1))
            elif kind < 0.88:
                mark = rnd.choice(["• ", "- ", "* ", "n"])
                page += [((f"{i + 1}. " if mark == "n" else mark) + fill(rnd.choice(phrases.ENTRIES[lang])), 1) for i in range(rnd.randint(1, 5))]
            elif kind < 0.96:
                s = rnd.choice([" | ", " / ", " · ", "  "])
                page += [(fill("{C}" + s + "{N}" + s + "{d} {N} {d}"), 1) for _ in range(rnd.randint(1, 4))]
            else:
                page.append((fill(rnd.choice(phrases.NOTICES[lang] + phrases.FILLERS[lang])), 1))
            if framed and rnd.random() < 0.2:
                page.append((furn(), 0))
    if framed:
        if rnd.random() < 0.5:
            page.append((rnd.choice([t for t in phrases.FURNITURE[lang] if "{" not in t][-12:]), 0))
            page += [(rnd.choice(["", "› ", "- "]) + fill(rnd.choice(phrases.TITLES[lang])) + rnd.choice(["", f" ({rnd.randint(1, 99)})"]), 0) for _ in range(rnd.randint(2, 6))]
        page += [(furn() if rnd.random() < 0.85 else " ".join(furn() for _ in range(rnd.randint(2, 5))), 0) for _ in range(rnd.randint(2, 8))]
    return page


def _disturb(page: list[tuple[str, int]], rnd: random.Random) -> list[tuple[str, int]]:
    """The page with some lines in capitals, indented, or with another bullet or ending."""
    out = []
    for text, label in page:
        r = rnd.random()
        text = text.upper() if r < 0.04 else "  " + text.replace(" ", "  ", 2) if r < 0.08 else text + rnd.choice([" »", "!", "."]) if r < 0.12 else "- " + text if r < 0.15 and not label else text
        out.append((text, label))
    return out


class Watch(NamedTuple):
    """A test of lines: the weights of their tokens and of their tokens' beginnings, each once, sum to more than ``least``."""

    words: dict[str, float]
    stems: dict[str, float]
    least: float


class _Codes(dict):
    """Numbers of tokens as they come, digits alike, and a row of figures for each token and each beginning."""

    def __init__(self, model: LineModel, watch: list[Watch]) -> None:
        self.model, self.watch = model, watch
        self.rows, self.stems, self.stem_rows, self.mixed = array("d"), {}, array("d"), []

    def __missing__(self, t: str) -> int:
        if t <= ":" and t != "0" and t.isdecimal():
            self[t] = n = self["0"]
            return n
        m, stem = self.model, -1
        if len(t) > STEM:
            b = t[:STEM]
            stem = self.stems.get(b)
            if stem is None:
                stem = self.stems[b] = len(self.stems)
                self.stem_rows.extend((m.begun.get(b, 0.0), *(w.stems.get(b, 0.0) for w in self.watch)))
        n = len(self.rows) // (3 + len(self.watch))
        self[t] = n
        self.rows.extend((m.names.get(t, 0), stem, m.said.get(t, 0.0), *(w.words.get(t, 0.0) for w in self.watch)))
        if not t.isalpha() and not t.isdecimal() and len(_TOKEN.findall(t)) > 1:
            self.mixed.append(n)
        return n


class LineModel:
    """Evidence of single lines and places, and the tree's potentials, fitted on labelled pages."""

    def __init__(self) -> None:
        rnd = random.Random(7)
        pages = list(_training_pages(rnd))
        tables = (phrases.FURNITURE, phrases.MENU, phrases.TITLES, phrases.HEADINGS, phrases.ENTRIES, phrases.SINGLES, phrases.TALK, phrases.FIELDS, phrases.NOTICES, phrases.FILLERS, *({k: sum(v, []) for k, v in t.items()} for t in (phrases.PROSE, phrases.MODAL)))
        self.words = frozenset(w for table in tables for ts in table.values() for t in ts for w in _tokens(re.sub(r"\{[NCdF]\}|\{date\}", " ", t)))
        self.stems = frozenset(w[:STEM] for w in self.words if len(w) > STEM)
        index: dict[str, int] = {"bias": 0}
        rows, values, labels = [], [], []
        for page in pages:
            lines = [t for t, _ in page]
            for (text, label), place in zip(page, places(lines), strict=True):
                # a word is dropped from a third of the lines, so that shape and place must carry lines of unknown words
                shape, words, scale = self.features(text, rnd.random() < 0.33)
                rows.append([index.setdefault(f, len(index)) for f in ("bias", *place, *shape, *words)])
                values.append([1.0] * (1 + len(place) + len(shape)) + [scale] * len(words))
                labels.append(label)
        y = np.array(labels)
        w = fit_logistic(rows, y, len(index), epochs=300, l2=3e-5, values=values)
        self.weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}
        self.said = {w: self.weights["w:" + w] for w in (*self.words, "0") if "w:" + w in self.weights}
        self.begun = {t: self.weights["p:" + t] for t in self.stems if "p:" + t in self.weights}
        #: Numbers of the words and marks that pairs are made of, the pairs by number, ascending, and their weights.
        self.names = {t: i for i, t in enumerate(("_", "0", "^", "$", *sorted(self.words - set("_0^$"))))}
        numbered = sorted((self.names[f.partition(" ")[0]] * len(self.names) + self.names[f.partition(" ")[2]], w) for f, w in self.weights.items() if " " in f)
        self.pairs, self.pair_weights = np.array([p for p, _ in numbered]), np.array([w for _, w in numbered])
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self._count_potentials(pages)

    def features(self, line: str, blind: bool = False) -> tuple[list[str], list[str], float]:
        """(shape features, word features, their scale). Words count less the more of them a line has."""
        tokens = _tokens(line)
        known = ["_" if blind and t != "0" or t != "0" and t not in self.words else t for t in tokens]
        words = ["w:" + t for t in set(known) if t != "_"]
        if not blind:
            words += {"p:" + t[:STEM] for t in set(tokens) if len(t) > STEM and t[:STEM] in self.stems}
        if len(known) <= PAIRED:
            last = "^"
            for t in known:
                if t != last or t not in "_0":
                    words.append(last + " " + t)
                last = t
            words.append(last + " $")
        return _shape(line), words, 1.0 / max(1.0, len(tokens) / 8) ** 0.5

    def evidence(self, line: str) -> float:
        """Log-odds that the line is main text by shape and words, without place and prior."""
        get = self.weights.get
        shape, words, scale = self.features(line)
        return get("bias", 0.0) + sum([get(f, 0.0) for f in shape]) + scale * sum([get(f, 0.0) for f in words]) - self.prior

    def read(self, lines: list[str], watch: list[Watch] = ()) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(evidence, whether a watch is exceeded, words in order) of each line; sums the same weights as ``features`` names, over all lines at once."""
        codes = _Codes(self, watch)
        words = [_WORD.findall(l.lower()) for l in lines]
        flat = np.array([c for ws in words for c in map(codes.__getitem__, ws)], np.int64)
        lens = np.array([len(ws) for ws in words], np.int64)
        if codes.mixed:
            # words that mix letters and digits are several tokens
            held = np.bincount(np.repeat(np.arange(len(lines)), lens)[np.isin(flat, codes.mixed)], minlength=len(lines)) > 0
            parts = np.split(flat, np.cumsum(lens)[:-1])
            for i in np.flatnonzero(held).tolist():
                parts[i] = np.array([codes[t] for t in _TOKEN.findall(lines[i].lower())], np.int64)
                lens[i] = len(parts[i])
            flat = np.concatenate(parts)
        names, stems, said, *watched = np.array(codes.rows).reshape(-1, 3 + len(watch)).T
        begun, *watched_stems = np.array(codes.stem_rows).reshape(-1, 1 + len(watch)).T
        owner = np.repeat(np.arange(len(lines)), lens)
        # each token of a line counts once, as does each beginning
        own, seen = np.divmod(np.unique(owner * len(said) + flat), max(1, len(said)))
        of = stems[seen].astype(np.int64)
        own_b, seen_b = np.divmod(np.unique((own * len(begun) + of)[of >= 0]), max(1, len(begun)))
        n = len(lines)
        total = np.zeros(n) + np.bincount(own, said[seen], n) + np.bincount(own_b, begun[seen_b], n)
        exceeded = np.zeros(n, bool)
        for w, by_token, by_stem in zip(watch, watched, watched_stems, strict=True):
            exceeded |= np.bincount(own, by_token[seen], n) + np.bincount(own_b, by_stem[seen_b], n) > w.least
        # pairs of neighbours, with both ends of the line
        at = np.flatnonzero((lens <= PAIRED)[owner])
        owner, name = owner[at], names[flat[at]].astype(np.int64)
        inner = owner[1:] == owner[:-1]
        short = np.flatnonzero(lens <= PAIRED)
        bare = short[lens[short] == 0]
        first, last = np.r_[True, ~inner][: len(at)], np.r_[~inner, True][: len(at)]
        inner &= (name[1:] != name[:-1]) | (name[1:] > 1)
        k = len(self.names)
        pair = np.r_[name[:-1][inner] * k + name[1:][inner], 2 * k + name[first], name[last] * k + 3, np.full(len(bare), 2 * k + 3)]
        where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        total += np.bincount(np.r_[owner[1:][inner], owner[first], owner[last], bare], np.where(self.pairs[where] == pair, self.pair_weights[where], 0.0), n)
        get = self.weights.get
        shape = np.array([sum([get(f, 0.0) for f in _shape(l)]) for l in lines])
        return get("bias", 0.0) + shape + total / np.maximum(1.0, lens / 8) ** 0.5 - self.prior, exceeded, words

    def at(self, place: tuple[str, ...]) -> float:
        """Log-odds of a place."""
        return sum(self.weights.get(f, 0.0) for f in place)

    def _count_potentials(self, pages: list[list[tuple[str, int]]]) -> None:
        root_block, block_line = np.ones((2, 2)), np.ones((2, 2))
        roots = np.ones(2)
        for page in pages:
            labels = np.array([l for _, l in page])
            first = starts_of([block_kind(t) for t, _ in page])
            root = int(labels.all())
            roots[root] += 1
            for a, b in zip(first, [*first[1:], len(page)], strict=True):
                block = int(labels[a:b].mean() >= 0.5)
                root_block[root, block] += 1
                for l in labels[a:b]:
                    block_line[block, l] += 1
        self.root = np.log(roots / roots.sum())
        self.root_block = np.log(root_block / root_block.sum(1, keepdims=True))
        self.block_line = np.log(block_line / block_line.sum(1, keepdims=True))

    def marginals(self, evidence: np.ndarray, block_of: np.ndarray, page_of: np.ndarray) -> np.ndarray:
        """Each line's marginal of being main text; ``block_of`` lines and ``page_of`` blocks are non-decreasing."""
        if not len(evidence):
            return np.zeros(0)
        unary = np.stack([np.zeros(len(evidence)), np.clip(evidence, -30, 30)], 1)
        first = np.flatnonzero(np.r_[True, np.diff(block_of) > 0])
        firstp = np.flatnonzero(np.r_[True, np.diff(page_of) > 0])
        joint = self.block_line[None] + unary[:, None, :]
        up = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        at_block = np.add.reduceat(up, first, axis=0)
        joint_b = self.root_block[None] + at_block[:, None, :]
        up_b = np.logaddexp(joint_b[:, :, 0], joint_b[:, :, 1])
        at_root = np.add.reduceat(up_b, firstp, axis=0) + self.root
        down_root = at_root[np.cumsum(np.r_[0, np.diff(page_of) > 0])] - up_b
        joint_d = self.root_block[None] + down_root[:, :, None]
        down_block = np.logaddexp(joint_d[:, 0], joint_d[:, 1]) + at_block
        cavity = down_block[np.cumsum(np.r_[0, np.diff(block_of) > 0])] - up
        belief = cavity[:, :, None] + self.block_line[None]
        belief = np.logaddexp(belief[:, 0], belief[:, 1]) + unary
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))
        # a page says something: condition on at least one main line, by the weight of the labelling without any
        bare = np.add.reduceat(np.broadcast_to(self.block_line[:, 0], (len(evidence), 2)), first, axis=0)
        bare = self.root_block[None] + bare[:, None, :]
        bare = np.add.reduceat(np.logaddexp(bare[:, :, 0], bare[:, :, 1]), firstp, axis=0) + self.root
        nothing = np.exp(np.minimum(np.logaddexp(bare[:, 0], bare[:, 1]) - np.logaddexp(at_root[:, 0], at_root[:, 1]), 0.0))
        page_of_line = np.cumsum(np.r_[0, np.diff(page_of) > 0])[np.cumsum(np.r_[0, np.diff(block_of) > 0])]
        return np.minimum(p / np.maximum(1 - nothing[page_of_line], 1e-12), 1.0)


def block_kind(line: str) -> int:
    """The shape by which neighbouring lines form a block: long, short, or the kind of bullet."""
    if (line[0] in _BULLETS or line[0].isspace()) and (b := _BULLET.match(line)):
        return 2 + "•*›»–-".find(b.group(1) or "?")
    return int(line.count(" ") >= 11)


def places(lines: list[str]) -> list[tuple[str, str]]:
    """For each non-blank line of a page: its place about the body (from the first to the last long sentence), by kind."""
    kinds = [block_kind(t) for t in lines]
    anchors = [i for i, t in enumerate(lines) if t.count(" ") >= ANCHOR and t.rstrip().endswith(ENDS)]
    return [place_of(i, k, anchors) for i, k in enumerate(kinds)]


def place_of(i: int, kind: int, anchors: list[int]) -> tuple[str, str]:
    """Features of a line's place: before, within or after the body, the distance to it, and the line's kind."""
    if not anchors:
        return ("none" + str(min(kind, 2)), "none")
    side = "before" if i < anchors[0] else "after" if i > anchors[-1] else "within"
    gap = anchors[0] - i if side == "before" else i - anchors[-1] if side == "after" else 0
    return (side + str(min(kind, 2)), side + "g" + str(min(gap, 4)))


def starts_of(kinds: list[int]) -> list[int]:
    return [i for i, k in enumerate(kinds) if not i or k != kinds[i - 1]]


@lru_cache(maxsize=1)
def line_model() -> LineModel:
    """The model, fitted once in a process."""
    return LineModel()


def split_main(texts: list[str | None], model: LineModel, memo: dict) -> tuple[list[list[str]], list[np.ndarray]]:
    """Per text its lines (all, blank ones included) and a boolean array: True for main lines. Blank lines are False."""
    lines_of, chances = line_chances(texts, model, memo)
    return lines_of, [c > 0.5 for c in chances]


def line_chances(texts: list[str | None], model: LineModel, memo: dict[str, tuple[float, int, bool, bool]], watch: list[Watch] = (), said: dict[str, list[str]] | None = None) -> tuple[list[list[str]], list[np.ndarray]]:
    """Per text its lines and their probabilities of being main text (0 for blank lines).

    With ``watch``, the probabilities of lines that exceed one of these are negated. ``said`` gets the words of lines that
    were not in the memo.
    """
    evidence: list[float] = []
    watched: list[bool] = []
    blocks: list[int] = []
    pages: list[int] = []
    where: list[list[int]] = []
    placed: dict[tuple[int, int], float] = {}
    block = -1
    lines_of = [text.split("\n") if text else [] for text in texts]
    fresh_lines = [l for l in dict.fromkeys(l for lines in lines_of for l in lines) if l and not l.isspace() and l not in memo]
    read: dict[str, tuple[float, int, bool, bool]] = {}
    if fresh_lines:
        odds_of, exceeded, words = model.read(fresh_lines, watch)
        for line, odds, over in zip(fresh_lines, odds_of.tolist(), exceeded.tolist(), strict=True):
            read[line] = (odds, block_kind(line), line.count(" ") >= ANCHOR and line.rstrip().endswith(ENDS), over)
        if said is not None:
            said.update(zip(fresh_lines, words, strict=True))
    for lines in lines_of:
        kept, last, fresh, kinds, anchors = [], None, True, [], []
        for i, line in enumerate(lines):
            if not line or line.isspace():
                continue
            known = read.get(line) or memo[line]
            if fresh or known[1] != last:
                block += 1
                pages.append(len(where))
                last, fresh = known[1], False
            if known[2]:
                anchors.append(len(kept))
            kinds.append(known[1])
            watched.append(known[3])
            evidence.append(known[0])
            blocks.append(block)
            kept.append(i)
        at = len(evidence) - len(kept)
        first, last = (anchors[0], anchors[-1]) if anchors else (-1, -1)
        for i, kind in enumerate(kinds):
            gap = -1 - min(first - i, 4) if i < first else min(i - last, 4) if i > last else 0
            spot = (gap if anchors else 9, kind if kind < 2 else 2)
            odds = placed.get(spot)
            if odds is None:
                odds = placed[spot] = model.at(place_of(i, kind, anchors))
            evidence[at + i] += odds
        where.append(kept)
    p = model.marginals(np.array(evidence), np.array(blocks, np.int64), np.array(pages, np.int64))
    if watch and watched:
        p = np.where(watched, -p, p)
    if len(memo) + len(read) > MEMO:
        memo.clear()
    memo.update((line, known) for line, known in read.items() if len(line) <= MEMO_LENGTH)
    out, at = [], 0
    for lines, kept in zip(lines_of, where, strict=True):
        chance = np.zeros(len(lines))
        if kept:
            chance[kept] = p[at : at + len(kept)]
            at += len(kept)
        out.append(chance)
    return lines_of, out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough for the workers' memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def furniture_lines(pages: DataFrame, key: str = "page_id", text: str = "relevant_content") -> DataFrame:
    """(key, line_no INT) of every non-blank line that is not main text; one narrow pass, no shuffle."""
    model = line_model()
    schema = f"`{key}` bigint, line_no int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            lines_of, flags_of = split_main(batch.column(1).to_pylist(), model, memo)
            out_id, out_no = [], []
            for k, lines, flags in zip(ids, lines_of, flags_of, strict=True):
                hit = [i + 1 for i, (l, f) in enumerate(zip(lines, flags.tolist(), strict=True)) if not f and l and not l.isspace()]
                out_no += hit
                out_id += [k] * len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_no, pa.int32())], names=[key, "line_no"])

    return pages.select(key, text).mapInArrow(run, schema)


def main_text(pages: DataFrame, key: str = "page_id", text: str = "relevant_content", out: str = "main_text") -> DataFrame:
    """(key, ``out``): each row's main lines joined by line feeds; null stays null."""
    model = line_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            lines_of, flags_of = split_main(texts, model, memo)
            main = [None if t is None else "\n".join(l for l, f in zip(ls, fs.tolist(), strict=True) if f) for t, ls, fs in zip(texts, lines_of, flags_of, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(main, pa.string())], names=[key, out])

    return pages.select(key, text).mapInArrow(run, f"`{key}` bigint, `{out}` string")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Every non-blank line that is not main text."""
    return furniture_lines(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "relevant_content")).distinct()


def p6_main(spark, sf_dir: str) -> DataFrame:
    """The main text of every page: its length and hash."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", F.length("main_text").alias("n_chars"), F.md5("main_text").alias("text_md5"))

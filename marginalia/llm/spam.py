"""Keyword-stuffed pages, link lists and product or tag lists, by a hidden Markov model over lines.

A text is cut into lines, sentences and, where these run on, chunks. Each gives an observation (links, tags, prices and
codes, function words, repetition of the words just before, separators, length, ending). The hidden states are prose,
record (timetables, course and reading lists), link list, tag list and menu (product entries); emissions and
transitions are counted on labelled texts. Forward-backward gives each chunk's posterior, and a page is flagged when
prose and records make up too small a share of its words.

Edge cases: null, blank and wordless texts are not flagged; texts of any length are read whole; repeated rows each count.
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

from . import phrases
from .boilerplate import slices
from .language import forward_backward

STATES = ("prose", "record", "link", "tag", "menu")
CONTENT = 2  # the first two states are content
#: Words of a chunk at most.
CHUNK = 18
#: A page is flagged when this share of its words is in link, tag or menu chunks.
LEAST = 0.6
TRAINING_TEXTS = 8000
# Common function words.
FUNCTION = set(
    "the a an of to and in is are be for by with on at from that which its as or who will can may must should was it this not have has you your our we they their than then once if what how when why i my no "
    "le la les un une des du de et en est à au aux pour par sur avec dans que qui ce cette se ne pas son sa ses il elle vous je mon doit peut va devrait selon avant après d l s n qu plus où "
    "der die das den dem des ein eine einen einem einer und in im ist zu zum zur für von vom mit auf am an bei nach vor aus über wie dass ich sie wir es nicht kann muss soll darf wird möchte oder als ob wenn war ihre "
    "el los las una unos unas y del al por para con se su sus lo es o como más antes después debe puede va quiere debería según cuando hay mi me qué cómo "
    "من في على إلى عن مع أن هو هي هذا هذه كل بعد قبل خلال التي الذي ثم أو لا ما لم قد كما وفق عبر عند بين غير ذلك لأنه أي هل كيف ماذا لماذا متى نحو يصل عام و".split()
)
# What such pages sell (for training texts only; the model sees no words).
WARES = {
    "en": ["running shoes", "discount watches", "free casino bonus", "cheap flights", "weight loss pills", "payday cash", "replica bags", "car insurance quote", "garden furniture", "phone repair", "hair dryer", "crypto signals"],
    "fr": ["chaussures de course", "montres en promo", "bonus casino gratuit", "vols pas chers", "perte de poids", "assurance auto", "sacs de luxe", "meubles de jardin", "réparation mobile"],
    "de": ["laufschuhe", "uhren rabatt", "gratis casino bonus", "billige flüge", "abnehmen pillen", "autoversicherung", "taschen replik", "gartenmöbel", "handy reparatur"],
    "es": ["zapatillas deportivas", "relojes rebajados", "bono casino gratis", "vuelos baratos", "pastillas adelgazar", "seguro coche", "bolsos réplica", "muebles jardín", "reparar móvil"],
    "ar": ["أحذية رياضية", "ساعات مخفضة", "رحلات رخيصة", "حبوب تنحيف", "تأمين سيارات", "حقائب مقلدة", "أثاث حدائق", "إصلاح هواتف", "قروض سريعة"],
}
_STUFFED = {
    "en": ["We sell {a}, {a} and more {a}.", "Looking for {a}? Buy {a}, try {b}.", "{b} beats {a}, order {b}!", "Top {a}, top {b}.", "{a}: cheap {a} near you."],
    "fr": ["Nous vendons {a}, {a} et encore {a}.", "Vous cherchez {a} ? Achetez {a}, essayez {b}.", "{b} bat {a}, commandez {b} !", "{a} : {a} près de chez vous."],
    "de": ["Wir verkaufen {a}, {a} und noch mehr {a}.", "Sie suchen {a}? Kaufen Sie {a}, testen Sie {b}.", "{b} schlägt {a}, {b} bestellen!", "{a}: {a} in Ihrer Nähe."],
    "es": ["Vendemos {a}, {a} y más {a}.", "¿Busca {a}? Compre {a}, pruebe {b}.", "¡{b} supera a {a}, pida {b}!", "{a}: {a} cerca de usted."],
    "ar": ["نبيع {a} و{a} والمزيد من {a}.", "تبحث عن {a}؟ اشتر {a} وجرب {b}.", "{b} أفضل من {a}، اطلب {b}!", "{a}: {a} بالقرب منك."],
}
_SENTENCE = re.compile(r"(?<=[.!?؟])\s+(?!(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b)|\s+[|·]\s+|;\s+|\s+(?=https?://)")
_URL = re.compile(r"https?://\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,8}/\S+")
_CODE = re.compile(r"\b(?:SKU|art-|no\. ?|#)\d{3,}|[$€£]\s?\d")
_ROW = re.compile(r"\b\d{1,2}:\d{2}\b|\b[A-Z]{2,4}[ -]?\d{3}\b")
_WORD = re.compile(r"\w+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def chunks(text: str) -> list[str]:
    """Lines, sentences within them, and pieces of at most ``CHUNK`` words of what still runs on."""
    out: list[str] = []
    if "<" in text:
        text = _TAG.sub("", text)
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        if "  " in line:
            line = " ".join(line.split())
        for part in _SENTENCE.split(line):
            if part.count(" ") <= CHUNK + 6:
                out.append(part)
            else:
                words = part.split(" ")
                out += [" ".join(words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]
    return [c for c in out if c and not c.isspace()]


def observe(parts: list[str]) -> tuple[list[tuple[int, ...]], list[int]]:
    """(feature values, number of words) of the chunks of one text."""
    seen: list[set[str]] = [set(), set(), set()]
    out, sizes = [], []
    for part in parts:
        url = "/" in part and len(_URL.findall(part))
        bare = _URL.sub(" ", part) if url else part
        words = _WORD.findall(bare.lower())
        n = len(words)
        content = [w for w in words if w not in FUNCTION and len(w) > 2]
        f = (n - sum(w not in FUNCTION for w in words)) / n if n else 0.0
        old = seen[0] | seen[1] | seen[2]
        fresh: set[str] = set()
        again = 0
        for w in content:
            if w in old or w in fresh:
                again += 1
            fresh.add(w)
        seen = [seen[1], seen[2], fresh]
        r = again / len(content) if content else 0.0
        end = part.rstrip("»\"') ")[-1:] in ".!?؟"
        marks = (part.count(",") + part.count("،")) / (n + 1)
        tags = part.count("#")
        sparse = (0 if f == 0 else 1 if f < 0.12 else 2 if f < 0.25 else 3) + (4 if n and (words[0][0] > "\u05ff") + (words[n // 2][0] > "\u05ff") + (words[-1][0] > "\u05ff") >= 2 else 0)
        again_ = 0 if r < 0.2 else 1 if r < 0.45 else 2 if r < 0.7 else 3 if r < 0.9 else 4
        size = 0 if n <= 2 else 1 if n <= 5 else 2 if n <= 9 else 3
        # features that go together are observed together
        out.append((
            0 if not url else 1 if n <= 2 else 2 if n <= 9 and f < 0.25 and not end else 3,
            0 if not tags else 1 if tags < 3 and tags * 2 < n else 2,
            1 + (n > 8) if ("SKU" in part or "art-" in part or "no." in part or "#" in part or "$" in part or "€" in part or "£" in part) and _CODE.search(part) else 0,
            sparse * 3 + (0 if marks < 0.03 else 1 if marks < 0.15 else 2),
            sparse * 5 + again_,
            size * 2 + int(end),
            2 if _ROW.search(part) and ":" in part else 1 if _ROW.search(part) else 0,
        ))
        sizes.append(part.count(" ") + 1)
    return out, sizes


_SIZES = (4, 3, 3, 24, 40, 8, 3)


def _labelled_text(rnd: random.Random) -> list[tuple[str, int]]:
    """Labelled parts of a text; each part is cut into chunks of that label."""
    lang = rnd.choice(list(phrases.MENU))
    name = lambda: phrases.fill("{N}", lang, rnd)
    ware = lambda: rnd.choice(WARES[lang])
    url = lambda: rnd.choice(["http://", "https://", ""]) + f"{name().lower()}-{rnd.choice(['top', 'deals', 'info'])}.{rnd.choice(['example', 'com', 'net'])}/{name().lower()}"
    prose = lambda k: [(rnd.choice([" ", " ", "\n"]).join(phrases.sentence(lang, rnd) for _ in range(k)), 0)]
    kind, n = rnd.random(), rnd.randint(10, 40)
    if rnd.random() < 0.1:
        return prose(1)
    sep = rnd.choice(["\n", " | ", " · ", ", ", ", ", "; ", " "])
    if kind < 0.25:
        out = prose(rnd.randint(1, 8))
        if rnd.random() < 0.15:  # paragraphs under one keyword
            k = name()
            out = [(" ".join(f"{k}: " + phrases.sentence(lang, rnd) for _ in range(rnd.randint(2, 8))), 0)]
        if rnd.random() < 0.4:
            out.insert(0, (phrases.fill(rnd.choice(phrases.TITLES[lang]), lang, rnd) + "\n\n", 0))
        if rnd.random() < 0.3:
            out.append((" ".join("#" + name() for _ in range(rnd.randint(2, 6))), 3))
        return out
    if kind < 0.33:
        return [("\n".join(rnd.choice(phrases.QUESTIONS[lang]) + " " + phrases.sentence(lang, rnd)[:-1] + "?" if i % 2 else phrases.sentence(lang, rnd) for i in range(rnd.randint(2, 8))), 0)]
    if kind < 0.4:  # tales that repeat a few names
        cast = [name() for _ in range(4)]
        tale = {"en": "In {4} the {0} brothers met {1} on the road and sold {3} the {2} farm for {5} coins. After {5} winters {1} came back with {0}, found {2} empty and asked {3} for bread.",
                "fr": "En {4} les frères {0} croisèrent {1} sur la route et vendirent à {3} la ferme {2} pour {5} écus. Après {5} hivers {1} revint avec {0}, trouva {2} vide et demanda du pain à {3}.",
                "de": "Im Jahr {4} trafen die Brüder {0} auf {1} und verkauften {3} den Hof {2} für {5} Taler. Nach {5} Wintern kam {1} mit {0} wieder, fand {2} leer und bat {3} um Brot.",
                "es": "En {4} los hermanos {0} vieron a {1} en el camino y vendieron a {3} la granja {2} por {5} reales. Tras {5} inviernos {1} volvió con {0}, halló {2} vacía y pidió pan a {3}.",
                "ar": "في عام {4} التقى الإخوة {0} مع {1} في الطريق وباعوا إلى {3} مزرعة {2} بثمن {5} درهم. بعد {5} شتاء عاد {1} مع {0} فوجد {2} خالية وطلب الخبز من {3}."}[lang]
        told = " ".join(tale.format(*cast, rnd.randint(50, 2000), rnd.randint(50, 2000)) for _ in range(rnd.choice([1, 1, 2])))
        if rnd.random() < 0.5:
            told = re.sub(r"(.{25,50}) ", r"\1\n", told)
        if rnd.random() < 0.3:
            told = re.sub(r"[.,،]", "", told)
        return prose(rnd.randint(0, 2)) + [(rnd.choice(["", "Q: ", "> ", "### "]) + told, 0)] + prose(rnd.randint(0, 2))
    if kind < 0.5:  # timetables and course lists
        rows = [phrases.fill(rnd.choice(["{time}  {C}  {main}", "{C}  {main}", "{C} – {F} {N}", "{main} ({C})"]).replace("{time}", f"{rnd.randint(8, 18):02}:{rnd.choice(['00', '15', '30'])}").replace("{main}", rnd.choice(phrases.ENTRIES[lang])), lang, rnd) for _ in range(rnd.randint(5, 25))]
        return [("\n".join(rows), 1)]
    if kind < 0.56:  # reading lists with sentences
        return [("\n".join(phrases.sentence(lang, rnd) + " " + url() for _ in range(rnd.randint(3, 15))), 0)]
    head = prose(rnd.randint(1, 2)) if rnd.random() < 0.35 else []
    if kind < 0.66:
        return head + [(rnd.choice([" ", " ", "\n"]).join(rnd.choice(_STUFFED[lang]).format(a=a, b=ware()) for a in rnd.choices(rnd.sample(WARES[lang], 4), k=n)), 3)]
    if kind < 0.72:
        few = rnd.sample(WARES[lang], rnd.randint(2, 5))
        return head + [(" ".join(rnd.choice(few) for _ in range(n * 2)), 3)]
    if kind < 0.8:
        sep = ", " if rnd.random() < 0.5 else sep
        return head + [(sep.join(ware() + rnd.choice(["", " " + name(), f" {rnd.randint(2015, 2027)}"]) for _ in range(n)), 3)]
    if kind < 0.86:
        return head + [(rnd.choice([" ", "\n", ", "]).join("#" + ware().replace(" ", rnd.choice(["", "_"])) for _ in range(n)), 3)]
    if kind < 0.93:
        label = rnd.choice([lambda: "", lambda: ware() + rnd.choice([" >> ", " : ", " -> ", "  "]), lambda: phrases.fill(rnd.choice(phrases.TITLES[lang]), lang, rnd) + " – "])
        return head + [(sep.join(label() + url() for _ in range(n)), 2)]
    return head + [(sep.join(f"{name()} {rnd.choice(['XL', 'Set', 'Pro', 'A4', '2-pack', ''])} {rnd.choice(['SKU', '#', 'no. ', 'art-'])}{rnd.randint(1000, 99999)} {rnd.choice(['€', '$', ''])}{rnd.randint(3, 90)}{rnd.choice(['', '.99', ',50'])}" for _ in range(n)), 4)]


class LineMarkov:
    """Emission and transition log probabilities counted on labelled texts."""

    def __init__(self) -> None:
        rnd = random.Random(31)
        k = len(STATES)
        emit = [np.full((k, s), 0.5) for s in _SIZES]
        trans, start = np.full((k, k), 0.5), np.full(k, 1.0)
        for _ in range(TRAINING_TEXTS):
            parts, labels = [], []
            for text, label in _labelled_text(rnd):
                c = chunks(text)
                parts += c
                labels += [label] * len(c)
            obs, _ = observe(parts)
            for j, (o, l) in enumerate(zip(obs, labels, strict=True)):
                for e, v in zip(emit, o, strict=True):
                    e[l, v] += 1
                if j:
                    trans[labels[j - 1], l] += 1
                else:
                    start[l] += 1
        self.emissions = [np.log(e / e.sum(1, keepdims=True)) for e in emit]
        self.transitions = np.log(trans / trans.sum(1, keepdims=True))
        self.start = np.log(start / start.sum())

    def content_shares(self, texts: list[str | None]) -> list[tuple[float, int] | None]:
        """(share of words in prose and records, words) of each text; None where it has no words."""
        obs: list[tuple[int, ...]] = []
        sizes: list[int] = []
        lens = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            o, s = observe(chunks(t)) if t else ([], [])
            obs += o
            sizes += s
            lens[i] = len(o)
        out: list[tuple[float, int] | None] = [None] * len(texts)
        if not obs:
            return out
        x = np.array(obs)
        # features depend on each other, so their joint evidence is tempered
        unary = 0.7 * sum(e[:, x[:, j]].T for j, e in enumerate(self.emissions))
        some = np.flatnonzero(lens)
        first = np.r_[0, np.cumsum(lens[some])[:-1]]
        unary[first] += self.start
        p = forward_backward(unary, lens[some], self.transitions)[:, :CONTENT].sum(1)
        w = np.array(sizes, float)
        total = np.add.reduceat(w, first)
        good = np.add.reduceat(w * p, first)
        for i, g, n in zip(some.tolist(), good.tolist(), total.tolist(), strict=True):
            out[i] = (g / n, int(n))
        return out


@lru_cache(maxsize=1)
def line_markov() -> LineMarkov:
    """The model, fitted once in a process."""
    return LineMarkov()


def content_share(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content_share DOUBLE, words INT): share of words in prose and records; null for texts without words."""
    model = line_markov()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            got = model.content_shares(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g and g[0] for g in got], pa.float64()), pa.array([g[1] if g else 0 for g in got], pa.int32())], names=[key, "content_share", "words"])

    return df.select(key, text).mapInArrow(run, f"`{key}` bigint, content_share double, words int")


def p10_found(spark, sf_dir: str) -> DataFrame:
    """Documents that are by far mostly keywords, tags, product entries or links."""
    shares = content_share(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return shares.filter(F.col("content_share") < 1 - LEAST).select("doc_id").distinct()

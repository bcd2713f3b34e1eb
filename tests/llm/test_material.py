"""The training material is kept apart from the test tables: no phrase of three words or more stands in both."""

import re

import pyarrow.parquet as pq

from marginalia.llm import language, phrases, pii, pii_training, residue, spam

COLUMNS = {"pages": ["title", "relevant_content"], "user_messages": ["message"], "documents": ["text"], "question_analysis": ["original_question"], "eval_items": ["question", "passage"]}
#: Word lists of single words, which name things and are no phrases.
LISTS = {"FUNCTION", "LATIN", "ARABIC"}


def plain(text):
    return " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "


def strings(x):
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        for v in x.values():
            yield from strings(v)
    elif isinstance(x, (list, tuple, set, frozenset)):
        for v in x:
            yield from strings(v)


def test_no_phrase_stands_in_the_tables(data_dir):
    tables = "\n".join({plain(line) for t, cs in COLUMNS.items() for c in cs for v in pq.read_table(f"{data_dir}/{t}.parquet", columns=[c]).column(0).to_pylist() if v for line in v.split("\n")})
    seen = []
    for module in (phrases, pii_training, pii, language, residue, spam):
        for name, value in vars(module).items():
            if name.lstrip("_").isupper() and name not in LISTS:
                for text in set(strings(value)):
                    seen += [(name, part) for part in re.split(r"\{\w*\}", text) if len(plain(part).split()) > 2 and plain(part) in tables]
    assert not seen

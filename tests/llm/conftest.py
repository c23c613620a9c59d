from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts() -> list[tuple]:
    """Nulls, empties, short, long, repeated and equal texts."""
    r = random.Random(11)
    base = words(r, 120)
    parts = base.split()
    near = " ".join([*parts[:60], "changed", *parts[61:]])
    long_ = words(r, 6000)
    texts = [None, "", "  \n\t ", "One", "one TWO", "a b c", base, base, near, base.upper(), long_, "x " * 300, "line\nline\nline\n" * 9, "é ß 中文 ́ mixed", "<|endoftext|> don't"]
    return [(i, t, None if i == 4 else "en", None if i == 5 else "s", len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    return spark.createDataFrame(odd_texts, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

from __future__ import annotations

import random

import pytest

WORDS = "the of a to and in is it for on with as at by from or an be this that which river stone cloud bread lamp ÄPFEL café naïve 東京".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(11)
    base = [prose(rng, rng.choice([1, 3, 9, 25, 60, 200])) for _ in range(40)]
    rows: list = [(i, t) for i, t in enumerate(base)]
    passage = prose(rng, 55)
    rows += [(100 + i, f"{prose(rng, 12)} {passage} {prose(rng, 5)}") for i in range(6)]
    rows += [(200, base[5]), (201, base[5].replace(" ", "  \t")), (202, base[5] + " "), (203, base[7]), (204, base[6].upper())]
    long = prose(rng, 400)
    rows += [(300, long), (301, long + " end"), (302, long.replace("river", "RIVER"))]
    rows += [(400, ""), (401, None), (402, " \n\t "), (403, "a\x0b\x0cb"), (404, "x" * 3000), (406, "<|endoftext|> begins, in <|endoftext|>the middle, ends<|endoftext|>"), (405, f"{passage} {passage} {passage}")]
    rows += [(None, base[3]), (None, None), (17, base[17]), (200, base[5])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns that operators use names of."""
    table = [(i, t, "s", 1, 2.0, "k") for i, t in rows]
    return spark.createDataFrame(table, "doc_id long, text string, source string, n int, score double, digest string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

"""Small corpora for the tests of the training-data operators."""

from __future__ import annotations

import random

import duckdb
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "te", "su") for b in ("ra", "ne", "pi", "do") for c in ("", "s", "th", "lin", "ver")]


def prose(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return [draw.choice(WORDS) for _ in range(n)]


@pytest.fixture
def docs(spark):
    """docs(texts) or docs([(id, text), ...]) as a documents table."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        rows = [(*r, "en", "web", None if r[1] is None else len(r[1]))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def odd(docs):
    """Null ids and texts, empty, blank and very long texts, repeated rows, ids with two texts."""
    long = " ".join(prose(1, 30_000))
    return docs([(None, None), (None, "one word after another."), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "x"), (6, long), (6, long), (7, long + " tail"), (8, "é" * 5000), (9, "\u0000   ok."), (10, "two texts"), (10, "of one id")])


@pytest.fixture
def clashing(odd):
    """The same with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    extra = ("text_hash", "key", "q", "in0", "in1", "words", "spots", "held", "node", "f0", "TEXT", "Doc_Id", "removed", "q_id")
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(extra)])


@pytest.fixture
def sql(spark):
    """Runs SQL on DataFrames given by name; rows as sorted tuples by column name."""

    def run(text, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        found = con.execute(text)
        names = [d[0] for d in found.description]
        return same_rows([dict(zip(names, r)) for r in found.fetchall()])

    return run


def same_rows(rows) -> list[str]:
    rows = [r if isinstance(r, dict) else r.asDict(True) for r in rows]
    return sorted(repr(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.items())) for r in rows)

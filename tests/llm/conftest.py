from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHES = ["_row", "row", "whole", "spans", "n", "set", "key", "name", "matches", "registers", "_part", "rejected", "x", "id"]


def words(rng: random.Random, n: int, vocabulary: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(n))


def with_clashes(df):
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in df.columns))


def corpus() -> list[tuple]:
    """Rows with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(7)
    texts: list[str | None] = [None, "", " \n", "12 34", "Été, naïve ΣΑΣ 日本語 ok", "a", "a b c", "Ab C", "x" * 450, "ab" * 300]
    base = words(rng, 120)
    passage = words(rng, 60)
    for k in range(12):  # near copies: some within the threshold, some chained, some outside
        own = base.split(" ")
        for _ in range(k):
            own[rng.randrange(len(own))] = words(rng, 1, "xyz")
        texts.append(" ".join(own))
    texts += [base] * 4
    texts += [f"{words(rng, rng.randint(1, 80))} {passage} {words(rng, rng.randint(1, 80))}" for _ in range(6)]
    texts += [passage[:250], passage[3:260], passage[:250] + passage[:250], "é" * 150, "é" * 150 + passage]
    texts += [words(rng, n) for n in (1, 2, 3, 4, 5, 50, 5000)]
    texts.append(words(rng, 20_000, "abcdefghijklmnop"))  # very long
    rows = [(i, t, "ab"[i % 2] if i % 5 else None, f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[13], rows[13], (None, base, "a", None, 3), (None, None, None, None, None), (5, "another text", "b", "s1", 12)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(4)).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))

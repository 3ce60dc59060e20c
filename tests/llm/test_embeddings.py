from __future__ import annotations

import math

import numpy as np
import pytest

from panelytics.llm import embeddings as em


def brute(rows, cosine):
    part = list(range(len(rows)))
    n = [0] * len(rows)
    able = []
    for i, (_, label, v) in enumerate(rows):
        good = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        able.append(_unit(v) if good else None)
    for i in range(len(rows)):
        for j in range(i):
            a, b = able[i], able[j]
            if a is not None and b is not None and rows[i][1] == rows[j][1] and len(a) == len(b) and a @ b >= cosine:
                n[i] += 1
                n[j] += 1
                part = [part[j] if p == part[i] else p for p in part]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((r[0], n[i], least, r[0] == least if r[0] is not None and least is not None else True))
    return out


def _unit(v):
    x = np.array(v) / np.abs(v).max()
    return x / np.linalg.norm(x)


def vectors(seed=0, n=260, size=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=size)
        if rows and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][2]) + rng.normal(size=size) * rng.choice([0.0, 0.02, 0.15, 0.3])
        rows.append((i, int(rng.integers(2)) if i % 40 else None, [float(x) for x in v]))
    rows += [(1000, 0, None), (1001, 0, []), (1002, 0, [0.0] * size), (1003, 0, [math.nan] + [1.0] * (size - 1))]
    rows += [(1004, 1, [math.inf] + [1.0] * (size - 1)), (1005, 1, [None] + [1.0] * (size - 1)), (1006, 0, [1.0, 2.0])]
    rows += [(1007, 0, rows[1][2]), (1, 0, rows[1][2]), (1008, 0, [x * 1e200 for x in rows[1][2]]), (1009, 0, [2.0, 4.0])]
    return rows


@pytest.mark.parametrize("leaf,children", [(2048, 8), (20, 4)])
def test_equals_comparing_all_with_all(spark, monkeypatch, leaf, children):
    monkeypatch.setattr(em, "LEAF", leaf)
    monkeypatch.setattr(em, "CHILDREN", children)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, row string")
    got = [tuple(r) for r in em.near_vectors(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, 0.93)))


def test_a_crowd_at_one_place_is_divided(spark, monkeypatch):
    monkeypatch.setattr(em, "LEAF", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=5)
    rows = [(i, 3, [float(x) for x in base * (1 + i) + rng.normal(size=5) * 1e-12]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {tuple(r)[1:3] for r in em.near_vectors(df).collect()} == {(119, 0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert em.near_vectors(df).collect() == []

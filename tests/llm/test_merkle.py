from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelytics.llm import merkle
from panelytics.llm.merkle import fold, manifest, proofs, report, verify

from conftest import SCHEMA, with_clashes


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def siblings(tree, place):
    for nodes in tree[:-1]:
        run = place // 8 * 8
        yield nodes[run:place], nodes[place + 1 : run + 8]
        place //= 8


def lowered(row):
    if row[0] is None or row[1] is None or zlib.crc32(str(row[0]).encode()) % 3:
        return row[1]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append(row)
    langs = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    ordered = {lang: sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for lang in langs}
    trees = {lang: levels([leaf(r, r[1]) for r in ordered[lang]]) for lang in langs}
    top = levels([trees[lang][-1][0] for lang in langs])
    for k, lang in enumerate(langs):
        for place, row in enumerate(ordered[lang]):
            path = [*siblings(trees[lang], place), *siblings(top, k)]
            node = leaf(row, lowered(row))
            for left, right in path:
                node = H(*left, node, *right)
            root, proof = top[-1][0], H(*(x for left, right in path for x in left + right))
            yield row[0], leaf(row, row[1]), trees[lang][-1][0], root, proof, node, node == root


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_equals_plain_trees(docs, rows):
    """Nulls, empty and long texts, repeated rows, rows without ids, clashing names."""
    assert in_order(report(docs).collect()) == in_order(brute(rows))


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 512, 513, 4100])
def test_sizes_at_the_edges_of_runs_and_blocks(spark, n):
    """A tree of ``n`` leaves beside one of a single leaf; beyond one block, rounds recurse."""
    rows = [(i * 7 % n, f"Text {i}", "x", None, i) for i in range(n)] + [(1, "Alone", None, "s", 3)]
    got = report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert in_order(got) == in_order(brute(rows))


def test_many_languages_and_blocks_of_blocks(spark, monkeypatch):
    """With blocks of one run, trees and the tree over 70 roots need several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "_LEVELS", ["level0"])
    rng = random.Random(3)
    rows = [(i, f"T {i}", rng.choice(["a", None, "é", "Z", *map(str, range(66))]), None, 1) for i in range(400)]
    rows += [(i, "same", "hot", None, 1) for i in range(300)]
    assert in_order(report(spark.createDataFrame(rows, SCHEMA)).collect()) == in_order(brute(rows))


def test_equal_rows_spread_over_tasks(spark):
    rows = [(None, "same", "x", None, 4)] * 3000
    got = report(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert in_order(got) == in_order(brute(rows))


def test_tables_without_rows(no_docs):
    assert report(no_docs).collect() == []
    assert manifest(no_docs).root().collect() == []


def test_paths_lead_to_the_manifests_root(docs):
    held = manifest(docs)
    (root,) = held.root().collect()
    got = proofs(held).withColumn("up", fold(F.col("leaf"), F.col("path"))).select("up", "root").distinct().collect()
    assert [tuple(r) for r in got] == [(root[0], root[0])]


def test_any_changed_row_is_found(docs):
    """A null made empty is a change too."""
    got = verify(docs, F.when(F.col("doc_id") == 13, F.concat("text", F.lit(" "))).otherwise(F.coalesce("text", F.lit(""))))
    texts = dict(docs.select("doc_id", F.col("text").isNull()).where("doc_id is not null").collect())
    for row in got.where("doc_id is not null").collect():
        assert row["verified"] == (row["doc_id"] != 13 and not texts[row["doc_id"]])


def test_columns_of_the_same_names_as_inside(spark):
    rows = with_clashes(spark.createDataFrame([(1, "A", "x", "s", 1), (2, None, None, None, None)], SCHEMA))
    more = rows.withColumns({c: F.lit("?") for c in ("tree", "node", "pos", "held", "_id", "_part", "block", "path", "top")})
    assert in_order(report(more).collect()) == in_order(report(rows).collect())

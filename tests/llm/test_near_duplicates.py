from __future__ import annotations

import random
import re

import numpy as np
import pytest

from panelytics.llm import near_duplicates as nd
from panelytics.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    part = list(range(len(rows)))
    linked = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for n, i in enumerate(linked):
        for j in linked[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                part = [part[j] if p == part[i] else p for p in part]
    out = []
    for i, r in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None), default=None)
        own = least if r[0] is not None else None
        out.append((r[0], len(sets[i]), own, own == r[0]))
    return out


def test_equals_comparing_all_with_all(docs, rows):
    got = [tuple(r) for r in nd.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_no_link_is_lost_to_a_bucket_of_many_components(spark, monkeypatch):
    """Chains and clusters whose members share buckets without being linked to the bucket's first."""
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "WIDE_BLOCK", 5)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(100), rng.randint(0, 9)):
            own[k] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in nd.near_duplicates(df).collect()]
    assert sorted(got) == sorted(brute(rows))


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_sketches_are_shuffled_once_with_the_members_of_buckets(spark, monkeypatch):
    """Beside the exchange that brings them to their members; and no member of a small bucket is dealt out twice."""
    monkeypatch.setattr(nd, "BLOCK", 256)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    plain_stored, plain_batches = nd.stored, nd.in_batches
    exchanges, dealt = [], []

    def stored(df):
        nodes = list(_nodes(df._jdf.queryExecution().executedPlan()))
        outputs = [n.output().mkString(" ") for n in nodes if n.nodeName() == "Exchange"]
        exchanges.append(sum("digits#" in names for names in outputs))
        return plain_stored(df)

    def in_batches(rows, step, schema):
        if {"band", "digits"} <= set(rows.columns):
            dealt.extend(rows.select("band", "key", "id").collect())
        return plain_batches(rows, step, schema)

    monkeypatch.setattr(nd, "stored", stored)
    monkeypatch.setattr(nd, "in_batches", in_batches)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        own = list(base)
        for k in rng.sample(range(100), rng.randint(0, 9)):
            own[k] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = [tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(brute(rows))
    assert max(exchanges) == 2
    assert dealt and len(dealt) == len(set(dealt))


@pytest.mark.parametrize("block, wide", [(1, 1), (2, 3), (4, 100), (100, 2)])
def test_units_compare_each_pair_across_components(spark, monkeypatch, block, wide):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "WIDE_BLOCK", wide)
    rng = np.random.default_rng(7)
    own = rng.integers(0, 2**63, 50).astype(np.uint64)
    part = {i: 0 if i < 9 else i // 2 for i in range(20)}  # one large component and others of two
    members = [(i, 0, bucket, part[i]) for bucket in range(2) for i in range(20) if i % 2 == bucket or i < 4]
    members += [(30, 0, 5, 30), (31, 0, 5, 30)]  # nothing to compare
    sketch = (len(own), nd.registers(own).tobytes(), nd._digits(own).tobytes())
    detailed = [(i, *sketch) for i in [*range(20), 30, 31]]
    pairs = nd._across(
        spark.createDataFrame(members, "id long, band int, key long, component long"),
        spark.createDataFrame(detailed, "id long, n long, registers binary, digits binary"),
        80,
    ).collect()
    want = {
        (a, b)
        for bucket in range(2)
        for a in range(20)
        for b in range(a + 1, 20)
        if part[a] != part[b] and all(i % 2 == bucket or i < 4 for i in (a, b))
    }
    assert {tuple(p) for p in pairs} == want


def test_empty_table(no_docs):
    assert nd.near_duplicates(no_docs).collect() == []


def test_one_of_each_group_stays_whole(docs, rows):
    kept = nd.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [r for r, b in zip(rows, brute(rows), strict=True) if b[3]]
    assert sorted(map(str, (tuple(r)[:5] for r in kept.collect()))) == sorted(map(str, want))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    one, two = nd.registers(np.concatenate([shared, a])), nd.registers(np.concatenate([shared, b]))
    union = nd.registers(np.concatenate([shared, a, b]))
    assert (nd.merge(one, two) == union).all()
    assert abs((one == two).mean() - 0.8) < 0.12
    n = np.array([900.0])
    assert nd.plausible(one[None], two[None], n, n)[0]
    far = nd.registers(rng.integers(0, 2**63, 900).astype(np.uint64))
    assert not nd.plausible(one[None], far[None], n, n)[0]
    assert not nd.plausible(one[None], one[None], n, n * 2)[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_stars_and_random_links(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    links += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(45)] + [(5, 5)]
    part = {x: x for link in links for x in link if link[0] != link[1]}
    for a, b in links:
        if a != b:
            low, high = sorted((part[a], part[b]))
            part = {k: low if v == high else v for k, v in part.items()}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == part


def test_rows_of_one_id_have_their_own_answers(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(24)]
    rows = [(100, t) for t in texts] + [(200 + i, f"{t} end") for i, t in enumerate(texts)]
    rows += [(1, texts[0] + " start"), (300, "another text of its own"), (None, texts[1]), (None, texts[2])]
    rows += [(250, "a text that is alone with its words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sorted(map(str, (tuple(r) for r in nd.near_duplicates(df).collect()))) == sorted(map(str, want))
    left = [r for r, b in zip(rows, want, strict=True) if b[3]]
    assert sorted(map(str, (tuple(r) for r in nd.without_near_duplicates(df).collect()))) == sorted(map(str, left))

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from panelytics.llm import decontaminate
from panelytics.llm.decontaminate import longest_matches, report, without_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, items):
    w = words(text)
    hit, found = [False] * len(w), set()
    for item, item_text in items:
        own = words(item_text)
        n = min(10, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit[k : k + n] = [True] * n
                found.add(item)
    ids = ",".join(sorted(str(i) for i in found if i is not None))
    n_items = len([i for i in found if i is not None])
    return len(w), sum(hit), n_items, hashlib.sha256(ids.encode()).hexdigest(), any(hit)


@pytest.fixture(scope="module")
def items(rows):
    passage = [r[1] for r in rows if r[1] and len(r[1]) > 200][-12].split(" ")
    long_text = rows[14][1].split(" ")
    own = [
        (1, " ".join(long_text[10:40]).upper()),
        (10, "-".join(long_text[35:60])),
        (2, " ".join(passage[:30])),
        (3, "été NAÏVE"),
        (4, None),
        (5, " ,;"),
        (6, "a"),
        (None, "Ab C"),
        (1, " ".join(passage[20:33])),
    ]
    return own


@pytest.mark.parametrize("sieve", [True, False])
def test_equals_trying_every_window(spark, docs, rows, items, monkeypatch, sieve):
    if not sieve:  # what the sieve lets through by chance is no match
        monkeypatch.setattr(decontaminate, "_passing", lambda hashes, sieve: np.ones(len(hashes), bool))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in report(docs, bench).drop("longest").collect()]
    want = [(r[0], *brute(r[1], items)) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(w[5] for w in want) > 8


def test_longest_matches_and_their_places(spark):
    text = "zero " + " ".join(f"w{i}" for i in range(30)) + " end"
    item = "start " + " ".join(f"W{i}" for i in range(5, 25)) + " stop"
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(3, item)], "item_id long, text string")
    assert [tuple(r) for r in longest_matches(docs, bench).collect()] == [(7, "3", 1, 6, 20)]
    assert report(docs, bench).first()["longest"] == 20


def brute_matches(text, items):
    """(item, first word in it, first word here, words) of each longest run, by walking every diagonal."""
    w, out = words(text), []
    for item, item_text in items:
        own = words(item_text)
        n = min(10, len(own))
        for way in range(-len(w), len(own)):
            run = 0
            for k in range(len(w) + 1):
                if k < len(w) and 0 <= k + way < len(own) and w[k] == own[k + way]:
                    run += 1
                    continue
                if n and run >= n:
                    out.append((str(item), k + way - run, k - run, run))
                run = 0
    return out


def test_longest_matches_of_items_that_part(spark):
    """Items share parts of a passage, hold it twice, or repeat; each match is found whole."""
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w)), (2, " ".join(w[10:35])), (3, " ".join(w[20:50] + ["x"] + w[20:50])), (3, " ".join(w)), (4, "w7 w8")]
    items += [(5, " ".join(["a"] * 14)), (6, " ".join(w[0:12] + ["y"] + w[13:30]))]
    texts = [" ".join(w), " ".join(["q", *w[5:40], "w3", *w[8:33]]), " ".join(["a"] * 25), " ".join(w[30:] + w[:30]), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = [tuple(r) for r in longest_matches(docs, bench).collect()]
    want = [(i, *m) for i, t in enumerate(texts) for m in brute_matches(t, items)]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_a_window_of_many_items_at_many_places(spark):
    """800 items hold the words that stand 400 times in a text: work goes with hits, not with items x places."""
    same = " ".join(f"s{i}" for i in range(12))
    items = [(i, f"{same} own{i}") for i in range(800)]
    docs = spark.createDataFrame([(1, f"{same} and ".join([""] * 401)), (2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.occurrences(bench)
    suffixes = decontaminate.bench_suffixes(found)
    searched = decontaminate._searched(docs.select("doc_id", "text"), suffixes)
    assert decontaminate._passages(searched, suffixes, ["doc_id"]).count() == 400
    rows = {r["doc_id"]: r for r in report(docs, bench).collect()}
    assert (rows[1]["n_hit"], rows[1]["n_items"], rows[1]["longest"], rows[2]["n_items"]) == (4800, 800, 12, 0)


def test_empty_tables(spark, docs, no_docs, items, rows):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert report(no_docs, bench).collect() == []
    got = report(docs, bench.limit(0)).collect()
    assert len(got) == len(rows) and not any(r["contaminated"] for r in got)


def test_clean_rows_stay_whole(spark, docs, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = without_leaks(docs, bench)
    assert kept.columns == docs.columns
    want = [r for r in rows if not brute(r[1], items)[4]]
    assert sorted(map(str, (tuple(r)[:5] for r in kept.collect()))) == sorted(map(str, want))

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest

from panelytics.llm import anchors, batches
from panelytics.llm.suffix_dedup import remove_repeats, report


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [(i, j) for i, j in _runs(gone)]
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def _runs(gone):
    start = None
    for i, g in enumerate([*gone, 0]):
        if g and start is None:
            start = i
        elif not g and start is not None:
            yield start, i
            start = None


def test_equals_comparing_all_strings_with_all(docs, rows):
    got = report(docs).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 200), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_shorter_strings_and_real_outputs(spark):
    base = "".join(chr(97 + i * i % 23) for i in range(300))
    texts = [base, base[40:130] + "!" + base[:70], "zz" + base[100:161], "tail" * 40, base[:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(df, length=60).collect()}
    for i, (size, gone, n_runs, digest) in enumerate(brute(texts, 60)):
        r = got[i]
        assert (r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == (size, n_runs, digest)
        assert sum(s["end"] - s["start"] for s in r["spans"]) == gone
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_empty_table(no_docs):
    assert report(no_docs).collect() == []


def test_length_outside_the_sample(docs):
    with pytest.raises(ValueError, match="can be searched"):
        remove_repeats(docs, length=10)


def test_segments_do_not_change_the_result(spark, monkeypatch):
    """A text longer than a segment is sampled in parts; every string is in one."""
    import numpy as np

    data = np.frombuffer(bytes(97 + (i * i * 7 + i // 9) % 19 for i in range(5000)), np.uint8)
    bounds = np.array([0, 1800, 5000])
    whole = anchors.sampled(anchors.Hashes(data), bounds, 200)
    covered = np.zeros(5000, int)
    for low, high in zip(whole.low, whole.high, strict=True):
        covered[low : high + 1] += 1
    want = np.zeros(5000, int)
    want[:1601], want[1800:4801] = 1, 1
    assert (covered == want).all() and (whole.place >= whole.high).all()
    assert batches.text_bytes.__doc__


def test_rows_without_ids_are_told_apart(spark):
    """Texts of one check, which only their keys tell apart, and copies of one row."""
    rng = random.Random(5)
    shared, own, other = ("".join(rng.choices("abcdefgh", k=k)) for k in (90, 200, 200))
    check = zlib.crc32((shared + own).encode()) & 0xFFFF
    clean = next(t for t in (f"{other}{i}" for i in range(10**7)) if zlib.crc32(t.encode()) & 0xFFFF == check)
    texts = [shared + own, clean, shared + "xyz" * 9, shared * 2, shared * 2, None]

    def answers(ids):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        out = remove_repeats(df, length=60).collect()
        return sorted((r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in out)

    got = answers([None, None, 7, None, None, None])
    assert got == answers(range(6)) == answers([3] * 6)
    assert (len(clean), [], clean.encode()) in got and got[1][1] and got[-1][1]

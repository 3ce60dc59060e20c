from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelytics.llm.packing import best_fit, pack
from panelytics.llm.vocabularies import WORD_BPE, ChunkTokenizer


def pieces(rows, size):
    encoder = Tokenizer.from_file(WORD_BPE)
    for doc_id, text in rows:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), size)):
            own = ids[start : start + size]
            yield doc_id, piece, start, len(own), zlib.crc32(own.tobytes())


@pytest.mark.parametrize("size", [4096, 50])
def test_every_piece_once_in_sequences_without_gaps(docs, rows, size):
    got = pack(docs, size=size).collect()
    want = list(pieces([r[:2] for r in rows], size))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    least = -(-sum(r["length"] for r in got) // size)
    assert len(held) <= least * 11 / 9 + 1


def test_best_fit_fills_gaps_by_rank():
    moves = best_fit({6: 3, 4: 2, 3: 1}, 10)
    assert [tuple(m) for m in moves] == [(6, 0, 3, 0, 0), (4, 0, 2, 0, 6), (3, 0, 1, 2, 6)]


def test_best_fit_is_best_fit_decreasing():
    """Against placing one piece at a time, the longest first, into the fullest sequence that takes it."""
    rng = random.Random(5)
    lengths = [rng.randint(1, 60) for _ in range(400)]
    counts = defaultdict(int)
    gaps = []
    for n in sorted(lengths, reverse=True):
        counts[n] += 1
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(60 - n)
    assert len({s for m in best_fit(counts, 60) for s in range(m.sequence, m.sequence + m.count)}) == len(gaps)


def test_empty_table(no_docs):
    assert pack(no_docs).collect() == []


def test_ids_are_those_of_the_whole_text(rows, monkeypatch):
    from panelytics.llm import vocabularies

    monkeypatch.setattr(vocabularies, "MOST_KEPT", 5)
    texts = [r[1] or "" for r in rows] + ["A<|endoftext|>b  \t\u2003c\x1cd\x85e", "don't\nI'LL 1234", "e\u0301 \u0301x"]
    encoder, own = Tokenizer.from_file(WORD_BPE), ChunkTokenizer(WORD_BPE)
    for text in texts:
        assert own.ids(text).tolist() == encoder.encode(text, add_special_tokens=False).ids

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken

from panelytics.llm.token_counts import attribute, character_spans, count_tokens, report
from panelytics.llm.vocabularies import BYTE_BPE


def encoder():
    with open(BYTE_BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(text, encoding):
    """Every token's code points, one by one."""
    text = text or ""
    tokens = [encoding.decode_single_token_bytes(t) for t in encoding.encode_ordinary(text)]
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    begins = [0] + [i + 1 for i, c in enumerate(text[:-1]) if c == "\n"] if text else []
    section = np.searchsorted(begins, range(len(text)), "right") - 1 if text else []
    counts, crossing, at = [0] * len(begins), 0, 0
    for token in tokens:
        chars = sorted(set(owner[at : at + len(token)]))
        at += len(token)
        held = [section[c] for c in chars]
        crossing += len(set(held)) > 1
        counts[min(set(held), key=lambda s: (-held.count(s), s))] += 1
    return len(tokens), len(begins), crossing, counts


def test_equals_counting_token_by_token(spark, rows):
    texts = [r[1] for r in rows if len(r[1] or "") < 50_000]
    texts += ["a\n\n\nb", "\n\n\n\n", "x\n", "\nx", "日本語\n\n 😀😀\n", "  \n  \n  y", "a\r\n\r\nb", "<|endoftext|>\n"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    encoding = encoder()
    got = {r["doc_id"]: tuple(r)[1:] for r in count_tokens(df).collect()}
    assert got == {i: brute(t, encoding) for i, t in enumerate(texts)}
    assert sum(g[2] for g in got.values()) > 3


def test_ties_go_to_the_earlier_section():
    counts, crossing = attribute(np.array([0, 2]), np.array([2, 6]), np.array([0, 1, 4]), 6)
    assert (counts.tolist(), crossing) == ([1, 1, 0], 2)


def test_tokens_inside_a_character_have_it():
    data = np.frombuffer("é日".encode(), np.uint8)
    first, last = character_spans(data, np.array([1, 2, 3, 5]))
    assert (first.tolist(), last.tolist()) == ([0, 0, 1, 1], [1, 1, 2, 2])


def test_sections_add_up_and_odd_tables(docs, no_docs, rows):
    got = report(docs).collect()
    assert len(got) == len(rows)
    assert all(sum(r["section_tokens"]) == r["n_tokens"] and len(r["section_tokens"]) == r["n_sections"] for r in got)
    assert report(no_docs).collect() == []

from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from panelytics.llm import personal_data
from panelytics.llm.personal_data import CONTEXTS, GENERALISED, NAMES, REMOVED, WINDOW, base_spans, document_counts, report, sanitise

from conftest import SCHEMA, with_clashes

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def valid(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        odd = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(odd) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    """The contract's patterns, as they stand."""
    found = [
        (m.start(), kind, m.end(), m[0])
        for kind, pattern in enumerate(PATTERNS)
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["@", ".", "a", "b.c", "x@y.z", "1", "22", "255", "256.", "+", "+1 (", ") ", " ", "-", "4111 1111 1111 1111", "é",
             "4111-1111-1111-1111", "0012.3.4.5", "１", "\n", "(", "+49 30 123456", "378282246310005", "--", "  ", "%"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [x[:3] for x in base_spans(text)] == [x[:3] for x in plain(text)], text


@pytest.mark.parametrize(
    "text", ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "1." * 200_000, "@" * 400_000, "+1" * 200_000, "a@b" * 130_000,
             "+1" + " " * 400_000, "a.b@c.d " * 20_000, "1.2.3." * 60_000 + "x"]
)
def test_long_texts_in_linear_time(text):
    started = time.perf_counter()
    base_spans(text)
    assert time.perf_counter() - started < 5


def words(text, spans):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z\u0080-\U0010ffff]+", low)]
    return [w for w in found if not any(w[0] < end and start < w[1] for start, _, end, _ in spans)], {w[2] for w in found}


def brute(texts):
    """(base spans, marked words) of each text, from counts by sets."""
    n, holds, both, contexts, values, near = len(texts), {}, {}, {}, {}, []
    for row, text in enumerate(texts):
        spans = plain(text)
        free, all_words = words(text or "", spans)
        for w in all_words:
            holds.setdefault(w, set()).add(row)
        own = []
        for start, kind, end, value in spans:
            value = value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value)
            around = [w for w in free if w[1] <= start][-WINDOW:] + [w for w in free if w[0] >= end][:WINDOW]
            values.setdefault((kind, value), set()).add(row)
            for w in around:
                key = (kind, value), w[2]
                both.setdefault(key, set()).add(row)
                contexts.setdefault(key, set()).add(tuple(x[2] for x in around))
                own.append((key, w[0], w[1]))
        near.append(own)
    out = []
    for row, text in enumerate(texts):
        marked = {}
        for key, start, end in near[row]:
            entity, term = key
            information = math.log2(n / len(values[entity]))
            if len(contexts[key]) >= CONTEXTS and information:
                share = 1 + math.log2(len(both[key]) / len(holds[term])) / information
                if share >= GENERALISED:
                    marked[start, end] = max(share, marked.get((start, end), 0))
        extra = [(s, 5 if share >= REMOVED else 4, e) for (s, e), share in marked.items()]
        out.append(([x[:3] for x in plain(text)], sorted([x[:3] for x in plain(text)] + extra)))
    return out


def corpus():
    """Values that come with the same words again and again, copies of passages, and much else."""
    rng = random.Random(11)
    common = ["the", "and", "of", "Été", "zu", "mail", "call"]
    pool = common * 6 + [f"w{''.join(rng.choices('abcdef', k=3))}" for _ in range(60)]
    say = lambda k: " ".join(rng.choices(pool, k=k))
    texts = [say(rng.randint(0, 60)) for _ in range(150)] + [None, "", " \n", "x" * 9000]
    for mail, nick in (("Ann.b@ex.org", "zorro"), ("c%d@mail.example.com", "Élan"), ("+1 (988) 555-2485", "quux"), ("10.0.0.7", "boss")):
        texts += [f"{say(9)} {rng.choice([nick, nick.upper(), 'the'])} {say(2)} {mail}, {say(rng.randint(0, 8))}" for _ in range(9)]
    texts += [f"{say(4)} {nick} {say(3)}" for nick in ("quux", "boss", "boss")]
    texts += [f"copied the passage zebra {'4111 1111 1111 1111'} and of"] * 8
    texts += ["a@b.c d@e.f g@h.i zorro 1.2.3.4 zorro", f"{'long text. ' * 4000} ann.b@ex.org zorro"]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_equals_counting_by_sets(spark, texts):
    rows = [(i, t, "x", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in report(with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()}
    named = lambda spans: ",".join(f"{NAMES[k]}:{s}:{e}" for s, k, e in spans)
    kinds = set()
    for i, (base, spans) in enumerate(brute(texts)):
        row = got[i]
        assert row["spans"] == named(spans), texts[i]
        assert row["base_sha256"] == hashlib.sha256(named(base).encode()).hexdigest()
        counts = [sum(k == n for _, k, _ in spans) for n in range(6)]
        assert [row[f"n_{name}"] for name in NAMES] == counts
        kinds |= {k for _, k, _ in spans}
    assert kinds == set(range(6)) and len(got) == len(texts)


def test_documents_of_each_word(spark):
    rows = [(1, "Ab ab c", "x", "s", 1), (1, "ABé", "x", "s", 1), (None, None, None, None, None), (2, "c " * 400_000, "x", "s", 1)]
    got = document_counts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(r["n_documents"] for r in got) == [1, 1, 2]


def test_odd_rows(docs, no_docs, rows):
    """Nulls, repeated rows, equal ids, empty tables."""
    assert len(report(docs).collect()) == len(rows)
    assert report(no_docs).collect() == [] and sanitise(no_docs).collect() == []


def test_values_and_what_discloses_them_go(spark, texts):
    rows = [(i, t, "x", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {r["doc_id"]: r for r in sanitise(docs).collect()}
    assert sanitise(docs).columns == docs.columns
    for i, (base, spans) in enumerate(brute(texts)):
        text = got[i]["text"]
        if not spans:
            assert text == texts[i]
        else:
            assert not plain(text) and got[i]["n_chars"] == len(text)
    assert personal_data.sanitised_text("a@b.c d", [(0, 0, 5), (1, 4, 3), (6, 4, 7)]) == "[EMAIL] d*"
    assert any("z*" in (r["text"] or "") or "Z*" in (r["text"] or "") for r in got.values()) or any(
        "zorro" not in r["text"].lower() for i, r in got.items() if "zorro" in (texts[i] or "").lower()
    )


def test_a_value_in_every_document_discloses_nothing(spark):
    rows = [(i, f"zorro {i % 3 * 'b '} a@b.c", "x", "s", 1) for i in range(9)]
    got = report(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("n_removed"), F.sum("n_general"), F.sum("n_email")).first()
    assert tuple(got) == (0, 0, 9)

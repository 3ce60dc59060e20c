from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelytics.llm import conversations
from panelytics.llm.conversations import by_lengths, cheapest, examine, folded, repair, report

GRAMMAR = re.compile("(s?(ua)+)?")
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute(turns):
    """(cost, audit) of the first complete repair that leaves a queue ordered by cost, then audit."""
    queue, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, place = heapq.heappop(queue)
        if i == len(turns) and place in (0, 3):
            return cost, audit
        if (i, place) in seen:
            continue
        seen.add((i, place))
        steps = []
        if i < len(turns):
            steps.append((3, "D", i + 1, place))
            if turns[i] != "x":
                extra = turns[i].isupper()
                if turns[i].lower() in NEXT[place]:
                    steps.append((extra, "K", i + 1, NEXT[place][turns[i].lower()]))
                steps += [(2 + extra, "R", i + 1, to) for r, to in NEXT[place].items() if r != "s"]
        steps += [(2, "I", i, to) for r, to in NEXT[place].items() if r != "s"]
        for more, edit, to_i, to in steps:
            heapq.heappush(queue, (cost + more, audit + edit, to_i, to))


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_and_least_audits(seed):
    rng = random.Random(seed)
    for _ in range(250):
        turns = "".join(rng.choices("suaoSUAOx", weights=[1, 5, 5, 1, 1, 2, 2, 1, 2], k=rng.randint(0, 11)))
        assert by_lengths(turns) == folded(turns) == brute(turns), turns


def test_every_short_conversation():
    pool = [""]
    for _ in range(4):
        pool += [t + c for t in pool if len(t) == len(pool[-1]) for c in "suaoUx"]
    for turns in pool:
        assert by_lengths(turns) == folded(turns) == brute(turns), turns


def test_long_conversations_in_one_pass():
    turns = "".join(random.Random(1).choices("suaoUx", k=200_000))
    cost, audit = cheapest(turns)
    assert len(audit) - audit.count("I") == len(turns) and cost > 0
    assert folded(turns[:70]) == by_lengths(turns[:70])


def plain(rows):
    """The contract, conversation by conversation."""
    space = lambda v: " " if v is None else str(v)
    kept = {}
    for conv, turn, role, text in rows:
        own = kept.setdefault(conv, [])
        lot = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", space(text)) if lot == 2 else space(text)
        role = "user" if lot == 4 else space(role)
        own += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        found, seen, turns = dict(gaps=0, blank=0, duplicate=0, truncated=0, illegal=0), set(), ""
        for turn, role, text in own:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                found[fault] += 1
            sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
            turns += "x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        found["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        numbers = [t for t, _, _ in own if t is not None]
        if numbers:
            found["gaps"] = max(numbers) - min(numbers) + 1 - len(set(numbers))
        cost, audit = brute(turns)
        queue, out, made = list(own), [], len(audit) - audit.count("D")
        for edit in audit:
            row = queue.pop(0) if edit != "I" else (None, None, "")
            if edit != "D":
                out.append((row[1] if edit == "K" else ("user", "assistant")[(len(out) - made % 2) % 2], row[2]))
        assert GRAMMAR.fullmatch("".join(role[:1] for role, _ in out))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        yield conv, *found.values(), cost, audit, digest


SCHEMA = "conv_id long, turn long, role string, text string"


def corpus():
    rng = random.Random(5)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choices(["user", "assistant", "system", "tool", "", None, "User"], [9, 9, 2, 1, 1, 1, 1])[0]
            text = rng.choice(["Yes.", "Yes", " ", "", None, "Why? \n", "é!", "Long. " * 50, f"t{turn}.", f"No {turn}"])
            rows.append((conv, rng.choices([turn, None, turn + 3], [20, 1, 1])[0], role, text))
    return [*{r[:3]: r for r in rows}.values()]  # turns and roles of one conversation are told apart by text otherwise


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


def test_equals_the_contract(talks):
    clashing = talks.withColumns({c: F.lit(1) for c in ("fault", "tie", "again", "initial", "copy", "found", "is_turn", "audit")})
    assert in_order(report(clashing).collect()) == in_order(plain(corpus()))


def test_batches_of_one_row(spark, talks):
    """Conversations that go over batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert in_order(report(talks).collect()) == in_order(plain(corpus()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeated_rows_and_one_large_conversation(spark):
    """Equal rows are duplicates from the second on, whatever their number."""
    rows = [(7, i, ("user", "assistant")[i % 2], f"T{i % 900}.") for i in range(3000)] + [(8, 1, "user", "A.")] * 40
    got = {r["conv_id"]: r for r in examine(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert (got[8]["duplicate"], got[8]["audit"].count("D"), got[8]["gaps"]) == (39, 39, 0)
    assert got[7]["duplicate"] == 2100 and got[7]["cost"] >= 6300


def test_no_rows_and_nothing_left(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert report(empty).collect() == [] and repair(empty).collect() == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = report(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "U"), (1, 2, "user", "V."), (1, 3, "assistant", " ")]
    got = repair(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    cost, audit = brute("sUux")
    assert [r["edit"] for r in got] == [e for e in audit if e != "D"]
    assert GRAMMAR.fullmatch("".join(r["role"][0] for r in got))


def test_folding_is_used_for_long_ones(monkeypatch):
    monkeypatch.setattr(conversations, "LONG", 3)
    assert cheapest("uauaua") == by_lengths("uauaua") == (0, "KKKKKK")

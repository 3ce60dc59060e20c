"""Repair of conversations whose turns no longer alternate: the cheapest edits that make them do so again.

Roles have to read ``s?(ua)+`` by their initials, or nothing. A conversation's turns are aligned to the strings of that
grammar, one for each length that can still win (Wagner and Fischer's matrix of edits, of which Ukkonen's band holds the
cells that the cheapest alignment so far allows); each alignment is traced back to the least of its cheapest
audits, and the least audit of the cheapest lengths is taken. A conversation beyond LONG turns would fill a matrix for
very many lengths; there the columns that stand for the same place in the grammar are one (``folded``), with the same
result in one pass for all lengths.

Turns are read in order of turn (nulls first), then role, then a hash of the text; equal rows are next to each other. Rows
of one conversation pass through one task in that order, because a digest of the repaired conversation is asked for; the
task holds a byte for each turn and never the texts. Nulls in role and text are one space; rows without conv_id are one
conversation. No rows give no conversations.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics.llm.batches import in_batches
from panelytics.llm.storage import stored

#: Prices of the edits; keeping costs nothing. A truncated turn that stays costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Turns up to which a conversation is aligned to each length by itself.
LONG = 64
WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
FULL = {"u": "user", "a": "assistant"}
_FAR = 1 << 60


def align(turns: str, target: str, most: int) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from ``turns`` to ``target``, or None if they cost more than ``most``.

    A turn is its role's initial, in upper case if truncated, or x if it has to go.
    """
    n, m = len(turns), len(target)

    def at_least(diagonal: int) -> int:  # what getting to that diagonal and from there to the end costs
        rest = m - n - diagonal
        return (INSERT * diagonal if diagonal > 0 else -DELETE * diagonal) + (INSERT * rest if rest > 0 else -DELETE * rest)

    band = [d for d in range(-n, m + 1) if at_least(d) <= most]
    if not band:
        return None
    low, width = band[0], band[-1] - band[0] + 1
    table = [[_FAR] * (width + 1) for _ in range(n + 2)]  # by row and diagonal; the last column stays far

    def choices(i: int, k: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, cost to the end, next row, next diagonal), by the edits' letters."""
        j = i + low + k
        if i < n:
            yield "D", DELETE + (table[i + 1][k - 1] if k else _FAR), i + 1, k - 1
        if j < m and target[j] != "s":
            yield "I", INSERT + table[i][k + 1], i, k + 1
        if i < n and j < m and turns[i] != "x":
            extra = TRUNCATED if turns[i].isupper() else 0
            if turns[i].lower() == target[j]:
                yield "K", extra + table[i + 1][k], i + 1, k
            elif target[j] != "s":
                yield "R", extra + REROLE + table[i + 1][k], i + 1, k

    for i in range(n, -1, -1):
        for k in range(min(width - 1, m - i - low), max(-1, -i - low - 1), -1):
            table[i][k] = 0 if (i, i + low + k) == (n, m) else min((c[1] for c in choices(i, k)), default=_FAR)
    cost = table[0][-low] if low <= 0 <= band[-1] else _FAR
    if cost > most:
        return None
    audit, i, k = [], 0, -low
    while (i, i + low + k) != (n, m):
        edit, i, k = next((e, ni, nk) for e, c, ni, nk in choices(i, k) if c == table[i][k])
        audit.append(edit)
    return cost, "".join(audit)


def by_lengths(turns: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, over all lengths that can be as cheap as the best so far."""
    gone = turns.count("x")
    left = len(turns) - gone

    def at_least(length: int) -> int:
        return DELETE * gone + (INSERT * (length - left) if length > left else DELETE * (left - length))

    best = (DELETE * len(turns), "D" * len(turns))  # the empty conversation
    system = "s" in turns.lower()
    lengths = sorted(range(2, left + 1 + DELETE * left // INSERT + 2), key=at_least)
    for length in lengths:
        if at_least(length) > best[0]:
            break
        if length % 2 == 0 or system:
            found = align(turns, "s" * (length % 2) + "ua" * (length // 2), best[0])
            best = min(best, found) if found else best
    return best


# The grammar's places: at the start, after the system's turn, the user's, the assistant's.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # where the next inserted or rerolled turn leads
_KEPT = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}


def folded(turns: str) -> tuple[int, str]:
    """As ``by_lengths``, with the columns of all lengths folded into the grammar's four places."""
    n = len(turns)
    to_end = [array("q", bytes(8 * (n + 1))) for _ in range(4)]

    def go(i: int, place: int) -> tuple[int, int, int, int]:
        """Cost to the end by deleting, keeping and reroling turn ``i``, and the place that keeping leads to."""
        turn, kept, changed, to = turns[i], _FAR, _FAR, -1
        if turn != "x":
            extra = TRUNCATED if turn.isupper() else 0
            to = _KEPT.get(turn.lower(), {}).get(place, -1)
            if to >= 0:
                kept = extra + to_end[to][i + 1]
            changed = extra + REROLE + to_end[_NEXT[place]][i + 1]
        return DELETE + to_end[place][i + 1], kept, changed, to

    for i in range(n, -1, -1):
        plain = [min(go(i, p)[:3]) for p in range(4)] if i < n else [0, _FAR, _FAR, 0]
        user = min(plain[_USER], INSERT + plain[_ASSISTANT])
        assistant = min(plain[_ASSISTANT], INSERT + plain[_USER])
        for p, cost in enumerate((min(plain[_START], INSERT + user), min(plain[_SYSTEM], INSERT + user), user, assistant)):
            to_end[p][i] = cost
    audit, i, places = [], 0, {_START}
    while i < n or all(to_end[p][i] for p in places):
        here = {p: to_end[p][i] for p in places}
        steps = {p: go(i, p) for p in places} if i < n else {}
        if deleted := {p for p, s in steps.items() if s[0] == here[p]}:
            edit, places = "D", deleted
        elif inserted := {_NEXT[p] for p in places if INSERT + to_end[_NEXT[p]][i] == here[p]}:
            edit, places = "I", inserted
        elif kept := {s[3] for p, s in steps.items() if s[1] == here[p]}:
            edit, places = "K", kept
        else:
            edit, places = "R", {_NEXT[p] for p, s in steps.items() if s[2] == here[p]}
        audit.append(edit)
        i += edit != "I"
    return to_end[_START][0], "".join(audit)


@lru_cache(100_000)
def _short(turns: str) -> tuple[int, str]:
    return by_lengths(turns)


def cheapest(turns: str) -> tuple[int, str]:
    """Cost of the cheapest repair, and of all audits at that cost the first in ASCII order."""
    return _short(turns) if len(turns) <= LONG else folded(turns)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults that the CRC of conversation and turn deals out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(lot == 4, "user").otherwise(space("role"))
    copies = F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(lot != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tie, again, initial, fault): ``fault`` is blank, duplicate, truncated or null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    core = F.rtrim(F.col("text"), F.lit(WHITE))
    marked = plain.withColumn("blank", core == "").withColumn(
        "ended", core.endswith(".") | core.endswith("!") | core.endswith("?")
    )
    # blank turns are no duplicates, so they needn't meet
    same = Window.partitionBy("conv_id", "role", "text", F.when(F.col("blank"), F.col("turn")))
    marked = marked.withColumn("again", F.row_number().over(same.orderBy(F.col("turn").asc_nulls_first())))
    fault = F.when(F.col("blank"), "blank").when(F.col("again") > 1, "duplicate").when(~F.col("ended"), "truncated")
    return marked.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.xxhash64("text").alias("tie"),
        "again",
        F.substring("role", 1, 1).alias("initial"),
        fault.alias("fault"),
    )


_ORDER = ("turn", "role", "tie", "again")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What is known of the conversation whose turns are coming in."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.last = conv_id, bytearray(), None
        self.first_turn = self.last_turn = None
        self.n_turns = 0
        self.counts = dict.fromkeys(_COUNTS, 0)

    def add(self, turn, initial: str, fault: str | None) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.n_turns = turn, self.n_turns + 1
        self.counts["illegal"] += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        if fault:
            self.counts[fault] += 1
        sign = initial if initial in ("s", "u", "a") else "o"
        self.turns += ("x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign).encode()

    def row(self) -> tuple:
        if self.n_turns:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.n_turns
        self.counts["cost"], audit = cheapest(self.turns.decode())
        return (self.conv_id, *self.counts.values(), audit)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _in_pieces(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held) if held else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield batch()
            held = []
    yield batch()


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", *order)]
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def audits(faulty: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``faults``."""
    id_type = _arrow(faulty, "conv_id")

    def conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        for conv_id, turn, _, _, _, initial, fault in rows:
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now.row()
                now = _Conversation(conv_id)
            now.add(turn, initial, fault)
        if now is not None:
            yield now.row()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [id_type, *[pa.int64()] * len(_COUNTS), pa.string()]
        yield from _in_pieces(conversations(_rows_of(batches)), ["conv_id", *_COUNTS, "audit"], types)

    narrow = _by_conversation(faulty.select("conv_id", *_ORDER, "initial", "fault"), *_ORDER)
    kind = faulty.schema["conv_id"].dataType.simpleString()
    return in_batches(narrow, step, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string")


def _repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn after ``audit``, from (role, text) before it."""
    made = len(audit) - audit.count("D")
    place = -(made % 2)  # a system's turn comes before the first pair
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit != "D":
            yield edit, role if edit == "K" else FULL["ua"[place % 2]], text
            place += 1


def _with_audits(faulty: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, as a row of its own, before its turns."""
    head = found.select("conv_id", F.lit(0).alias("is_turn"), F.struct(*_COUNTS, "audit").alias("found"))
    rows = faulty.select("conv_id", F.lit(1).alias("is_turn"), *_ORDER, "text")
    both = head.unionByName(rows, allowMissingColumns=True)
    both = _by_conversation(both, "is_turn", *_ORDER)
    return both.select("conv_id", "is_turn", "found", "role", "text")


def _by_heads(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, found, turns) of each conversation; ``turns`` has to be used up before the next."""
    waiting = next(rows, None)
    while waiting is not None:
        conv_id, _, found, _, _ = waiting
        waiting = None

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal waiting
            for row in rows:
                if row[1] == 0:
                    waiting = row
                    return
                yield row[3], row[4]

        own = turns()
        yield conv_id, found, own
        for _ in own:
            pass


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, role, text, edit), with place counted from 0; deleted turns are gone."""
    faulty = stored(faults(rows))
    id_type = _arrow(faulty, "conv_id")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, found, own in _by_heads(_rows_of(batches)):
            for place, (edit, role, text) in enumerate(_repaired(found["audit"], own)):
                yield conv_id, place, role, text, edit

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
        yield from _in_pieces(turns(batches), ["conv_id", "place", "role", "text", "edit"], types)

    kind = faulty.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place bigint, role string, text string, edit string"
    return in_batches(_with_audits(faulty, audits(faulty)), step, schema)


def examine(rows: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """Counts, cost, audit and the digest of the repaired turns of each conversation of ``rows``.

    ``all_ids`` (conv_id, each once) are answered too where they have no rows: zeros, an empty audit, nothing to hash.
    """
    faulty = stored(faults(rows))
    found = audits(faulty)
    if all_ids is not None:
        found = stored(found)
        ids = all_ids.select(F.col("conv_id").alias("_id"))
        zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in _COUNTS} | {"audit": F.coalesce("audit", F.lit(""))}
        found = ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left")
        found = found.select(F.col("_id").alias("conv_id"), *(c.alias(n) for n, c in zeros.items()))
    id_type = _arrow(faulty, "conv_id")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, known, own in _by_heads(_rows_of(batches)):
            digest, between = hashlib.sha256(), b""
            for _, role, text in _repaired(known["audit"], own):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield conv_id, *(known[c] for c in _COUNTS), known["audit"], digest.hexdigest()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [id_type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        yield from _in_pieces(digests(batches), ["conv_id", *_COUNTS, "audit", "repaired_sha256"], types)

    kind = faulty.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string, repaired_sha256 string"
    return in_batches(_with_audits(faulty, found), step, schema)


def report(conversations: DataFrame) -> DataFrame:
    """The damaged conversations, examined and repaired; one row for each conversation, also where no turn is left."""
    return examine(damaged(conversations), conversations.select("conv_id").distinct())

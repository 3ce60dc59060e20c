"""Near-duplicate texts by SetSketch registers over word shingles.

A register is the minimum of an exponentially distributed hash over a text's shingles, on a logarithmic scale that is
cut to whole numbers: ``floor(-log_b(min))``. Registers of a union are the larger of both, and equal with about the
probability of the Jaccard similarity. Bands of registers bring candidates together; the joint likelihood of all
registers drops those that can hardly be similar; the full shingle sets decide on the others.

Texts with equal shingle sets are one class from the start. In a bucket, every member is compared with the bucket's
first. What that leaves in different components is compared with all other members of the bucket, in blocks, so no link
is lost to large buckets and none needs all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics.llm.batches import byte_table, in_batches, mixed, text_bytes, text_chunks, window_hashes, words_of
from panelytics.llm.components import components
from panelytics.llm.storage import free, row_key, stored

#: Fixed value: words are runs of all but blank, tab, line feed, vertical tab, form feed and carriage return.
IN_WORD = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, SIMILAR = 4, 80
#: Registers, their base, and registers of a band. Two texts of similarity 0.8 share no band with probability 5e-8.
REGISTERS, BASE, BAND = 128, 1.001, 4
BANDS = REGISTERS // BAND
#: Logarithm of how much less likely the registers may be under enough similarity than under their best one.
UNLIKELY = 18.0
#: Further registers, of which a byte each is kept, for pairs that the first can't decide, and the logarithm as above
#: for them: a pair of similarity 0.8 is refused with probability 5e-7.
DIGITS, UNLIKELY_DIGITS = 1280, 12.0
#: Members that are compared with each other in a task.
BLOCK, WIDE_BLOCK = 256, 4096
#: Ids that are broadcast at most when their texts are fetched; more are joined by a shuffle.
MOST_BROADCAST_IDS = 1_000_000

_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_FURTHER = mixed(np.arange(1000, 1000 + DIGITS, dtype=np.uint64)) | np.uint64(1)


def shingles(batch: pa.RecordBatch, size: int, column: int = 1) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its shingles."""
    data, bounds = text_bytes(batch.column(column))
    words = words_of(data, bounds, IN_WORD)
    counts = np.bincount(words.row, minlength=batch.num_rows)
    first_word = np.cumsum(counts) - counts
    at, hashes = window_hashes(words, size)
    ends = np.searchsorted(words.row[at], np.arange(batch.num_rows + 1))
    for row in range(batch.num_rows):
        if ends[row] < ends[row + 1]:
            yield np.unique(hashes[ends[row] : ends[row + 1]])
        elif n := int(counts[row]):  # fewer words than a shingle has: the whole sequence is one
            own = words.hash[first_word[row] : first_word[row] + n]
            yield _short(own)
        else:
            yield np.zeros(0, np.uint64)


def _short(own: np.ndarray) -> np.ndarray:
    value = np.uint64(len(own))
    for h in own:
        value = mixed(np.array([value ^ h], np.uint64))[0]
    return np.array([value], np.uint64)


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes; that of an empty set is all zero."""
    if not len(values):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(least, (values[at : at + 512, None] * _FACTORS).min(0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53))
    return np.clip(np.floor(-np.log(exponential) / math.log(BASE)) + 4000, 0, 65535).astype(np.uint16)


def _digits(values: np.ndarray) -> np.ndarray:
    """Low bytes of DIGITS further registers of a set: more of them for the same room, for pairs near the threshold."""
    least = np.full(DIGITS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 128):
        np.minimum(least, (values[at : at + 128, None] * _FURTHER).min(0), out=least)
    return (mixed(least) >> np.uint64(56)).astype(np.uint8)


def _digits_plausible(equal: np.ndarray, similar: int) -> np.ndarray:
    """Whether so many equal digits are not too unlikely at the least similarity. Others are equal by chance in 256."""
    expected = similar / 100 + (1 - similar / 100) / 256
    share = np.clip(equal / DIGITS, 1e-9, 1 - 1e-9)
    distance = share * np.log(share / expected) + (1 - share) * np.log((1 - share) / (1 - expected))
    return (share >= expected) | (DIGITS * distance <= UNLIKELY_DIGITS)


def merge(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(one, two)


def _log_p(x: np.ndarray) -> np.ndarray:
    """Logarithm of the probability that one register is above the other by a share ``x`` of the union."""
    p = -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    return np.log(np.maximum(p, 1e-300))


def plausible(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Which pairs of sketches (rows) may be of enough similarity, by the joint likelihood of all registers.

    The sizes of the sets are known, so the similarity is the only unknown; it is at most the ratio of the sizes.
    """
    above, below = (one > two).sum(1)[:, None], (one < two).sum(1)[:, None]
    equal = one.shape[1] - above - below
    u = (n_one / (n_one + n_two))[:, None]
    v = 1 - u
    most = (np.minimum(n_one, n_two) / np.maximum(n_one, n_two))[:, None]
    threshold = similar / 100

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = _log_p(u - v * j), _log_p(v - u * j)
        same = np.log(np.maximum(1 - np.exp(x) - np.exp(y), 1e-300))
        return above * x + below * y + equal * same

    grid = np.linspace(0, 1, 21)[None, :]
    best = likelihood(most * grid).max(1)
    good = likelihood(np.minimum(threshold + (most - threshold) * grid, most)).max(1)
    return (100 * most[:, 0] >= similar) & (good >= best - UNLIKELY)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``row`` (its key), ``doc_id``, ``n`` (shingles), ``set`` (128 bits of the set), ``registers`` of each row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                counts, names, held = [], [], []
                for own in shingles(chunk, size):
                    counts.append(len(own))
                    turned = mixed(own)
                    names.append(np.array([own.sum(dtype=np.uint64), turned.sum(dtype=np.uint64)]).tobytes())
                    held.append(registers(own).tobytes())
                columns = [pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(2), chunk.column(0), *columns], ["row", "doc_id", "n", "set", "registers"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", row_key().alias("row"))
    return in_batches(rows, step, f"row long, doc_id {kind}, n long, set binary, registers binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(id, doc, band, key): a band's registers are its key, so members of a bucket agree in all of them."""
    digits = F.hex("registers")
    width = BAND * 4
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(digits, i * width + 1, F.lit(width)))
    return classes.select("id", "doc", F.posexplode(F.transform(keys, lambda k: F.conv(k, 16, -10).cast("long"))).alias("band", "key"))


def _hashed_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, set) with the full sorted shingle hashes of the rows ``ids``: id, row (the row's key)."""
    wanted = ids.select("id", "row").distinct()
    if wanted.count() <= MOST_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = docs.select(row_key().alias("row"), "text").join(wanted, "row").select("id", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                sets = pa.array([own.tobytes() for own in shingles(chunk, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([chunk.column(0), sets], ["id", "set"])

    return in_batches(rows, step, "id long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a, b = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            kept = []
            for x, y in zip(batch.column(names.index("set_a")), batch.column(names.index("set_b")), strict=True):
                one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                kept.append(100 * both >= similar * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return in_batches(pairs.join(a, "a").join(b, "b"), step, f"a {kind}, b {kind}")


def _sketched(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) that are plausible by their sketches."""
    a, b = (classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")) for c in ("a", "b"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n_a, n_b = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            r_a, r_b = (_matrix(batch.column(names.index(c)).to_pylist()) for c in ("r_a", "r_b"))
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(plausible(r_a, r_b, n_a, n_b, similar)))

    kind = dict(pairs.dtypes)["a"]
    return in_batches(pairs.join(a, "a").join(b, "b"), step, f"a {kind}, b {kind}")


def _matrix(held: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(held), np.uint16).reshape(-1, REGISTERS)


def _detailed(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, n, registers, digits) of the classes in ``sets``; the digits are the low bytes of further registers."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = [_digits(np.frombuffer(own.as_buffer(), np.uint64)).tobytes() for own in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digits, pa.binary())], ["id", "digits"])

    kind = dict(sets.dtypes)["id"]
    digits = in_batches(sets, step, f"id {kind}, digits binary")
    return stored(digits.join(classes.select("id", "n", "registers"), "id"))


def _pairs_across(rows: pa.Table, similar: int) -> pa.RecordBatch:
    """Plausible pairs (a, b) of the rows, which are sorted by task; of different components, each in the first band
    that it shares."""
    column = lambda c: rows.column(c).to_numpy()
    bands, keys, i, j = (column(c) for c in ("band", "key", "i", "j"))
    new = np.ones(len(bands), bool)
    new[1:] = (np.diff(bands) != 0) | (np.diff(keys) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(bands))
    in_main, block = column("in_main"), column("block")
    ids, parts, sizes = column("id"), column("component"), column("n")
    held = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    further = np.frombuffer(b"".join(rows.column("digits").to_pylist()), np.uint8).reshape(-1, DIGITS)
    by_band = held.view(np.uint64)
    out_a, out_b = [], []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def decide() -> None:
        if not waiting:
            return
        x, y = (np.concatenate(side) for side in zip(*waiting, strict=True))
        waiting.clear()
        for at in range(0, len(x), 5_000):
            a, b = x[at : at + 5_000], y[at : at + 5_000]
            kept = (by_band[a] == by_band[b]).argmax(1) == bands[a]
            a, b = a[kept], b[kept]
            kept = plausible(held[a], held[b], sizes[a], sizes[b], similar)
            a, b = a[kept], b[kept]
            kept = _digits_plausible((further[a] == further[b]).sum(1), similar)
            out_a.append(np.minimum(ids[a[kept]], ids[b[kept]]))
            out_b.append(np.maximum(ids[a[kept]], ids[b[kept]]))

    due = 0
    for start, end in zip(starts, ends, strict=True):
        own = np.arange(start, end)
        small = own[~in_main[own]]
        first = small[block[small] == i[start]]
        second = own[in_main[own]] if j[start] < 0 else small[block[small] == j[start]]
        if j[start] == -1:  # the small block meets itself here, too
            second = np.append(second, first)
        x, y = np.repeat(first, len(second)), np.tile(second, len(first))
        kept = parts[x] != parts[y]
        if j[start] == -1:
            kept &= in_main[y] | (x < y)
        waiting.append((x[kept], y[kept]))
        due += kept.sum()
        if due > 200_000:
            decide()
            due = 0
    decide()
    none = np.zeros(0, ids.dtype)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *side])) for side in (out_a, out_b)], ["a", "b"])


def _across(members: DataFrame, detailed: DataFrame, similar: int) -> DataFrame:
    """Plausible pairs (a, b) of ``members`` (id, band, key, component) of one bucket that lie in different components.

    The largest component of a bucket is only compared with the other members, not with itself; both are dealt out in
    blocks, and a task's unit of work is two blocks, so its memory is bounded. A small block is compared with itself in
    its first unit with the largest component, so members of a bucket of two blocks are dealt out once. Sketches
    (``detailed``) join when all units are known and are shuffled with their members once.
    """
    held = members.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    buckets = stored(
        held.groupBy("band", "key")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("band", "key", F.col("top.component").alias("main"), F.col("top.n").alias("n_main"), "all")
    )
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    rows = members.join(buckets, ["band", "key"]).withColumns(
        {
            "in_main": F.col("component") == F.col("main"),
            "n_blocks": blocks(F.col("all") - F.col("n_main"), BLOCK),
            "n_wide": blocks(F.col("n_main"), WIDE_BLOCK),
        }
    )
    rows = rows.withColumn(
        "block", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("n_wide")).otherwise(F.col("n_blocks"))).cast("int")
    )
    # a unit's name: (small block, other block), the others being other small blocks from 0 on and wide ones from -1 down
    others = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    wides = F.transform(F.sequence(F.lit(0), F.col("n_wide") - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j")))
    small = F.transform(
        F.array_remove(others, F.col("block")), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))
    )
    mains = F.transform(others, lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j")))
    unit = ["band", "key", "i", "j"]
    dealt = (
        rows.withColumn("unit", F.explode(F.when(F.col("in_main"), mains).otherwise(F.concat(small, wides))))
        .select("band", "key", "unit.i", "unit.j", "id", "component", "in_main", "block")
        .join(detailed, "id")
        .repartition(*unit)
        .sortWithinPartitions(*unit)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # rows of a unit that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([left, rows]) if left is not None else rows
            names = [rows.column(c).to_numpy() for c in unit]
            same = np.logical_and.reduce([n == n[-1] for n in names])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield _pairs_across(rows.slice(0, last), similar)
            left = rows.slice(last)
        if left is not None:
            yield _pairs_across(left, similar)

    kind = dict(members.dtypes)["id"]
    return in_batches(dealt, compare, f"a {kind}, b {kind}")


def class_components(docs: DataFrame, classes: DataFrame, size: int, similar: int) -> DataFrame:
    """(id, component) of the classes that are linked with others. ``classes``: id, row (the key of a row of
    it), doc (its doc_id), n, registers. A bucket's leader is its smallest doc_id."""
    buckets = _buckets(classes)
    leaders = buckets.groupBy("band", "key").agg(F.min(F.struct("doc", "id")).alias("first"), F.count("*").alias("n"))
    leaders = stored(leaders.where("n > 1").select("band", "key", F.col("first.id").alias("a")))
    shared = stored(buckets.drop("doc").join(leaders, ["band", "key"]))
    pairs = stored(_sketched(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct(), classes, similar))
    ids = shared.select("id").distinct()
    rows = ids.join(classes.select("id", "row"), "id")
    sets = stored(_hashed_sets(docs, rows, size).dropDuplicates(["id"]))
    links = stored(_confirmed(pairs, sets, similar))
    known = stored(components(links))
    members = (
        shared.select("id", "band", "key")
        .join(known, "id", "left")
        .select("id", "band", "key", F.coalesce("component", "id").alias("component"))
    )
    several = (
        members.groupBy("band", "key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("band", "key")
    )
    members = stored(members.join(stored(several), ["band", "key"], "left_semi"))
    open_sets = sets.join(stored(members.select("id").distinct()), "id", "left_semi")
    detailed = _detailed(open_sets, classes)
    further = stored(_across(members, detailed, similar).join(pairs, ["a", "b"], "left_anti"))
    free(detailed)
    more = stored(_confirmed(further, sets, similar))
    free(sets)
    if more.isEmpty():
        return known
    return components(links.union(more))


def _as_classes(held: DataFrame) -> DataFrame:
    """One row per distinct shingle set: a number, the key and doc_id of its smallest document, its size, its registers.

    The numbers, unlike the keys, are small on disk. They hold once the table is stored.
    """
    some = held.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = some.groupBy("set", "n").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("registers").alias("registers"))
    return first.select(
        "set", "n", F.monotonically_increasing_id().alias("id"), "first.row", F.col("first.doc_id").alias("doc"), "registers"
    )


def _judged(docs: DataFrame, size: int, similar: int) -> DataFrame:
    """The columns of ``near_duplicates`` and ``row``, the rows' keys."""
    sketched = stored(sketches(docs, size))
    classes = stored(_as_classes(sketched))
    held = stored(sketched.drop("registers"))
    free(sketched)
    linked = class_components(docs, classes, size, similar).join(classes.select("id", "doc"), "id")
    smallest = stored(linked.groupBy("component").agg(F.min("doc").alias("least")))
    found = linked.join(smallest, "component").select("id", "least")
    of_class = classes.select("set", "n", "id", "doc").join(found, "id", "left").select(
        "set", "n", F.coalesce("least", "doc").alias("component")
    )
    return held.select("row", "doc_id", "n", "set").join(of_class, ["set", "n"], "left").select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        _component().alias("component_id"),
        F.coalesce(_component() == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row of ``docs``.

    Rows are linked if 100 x intersection >= ``similar`` x union of their shingle sets; ``component_id`` is the smallest
    doc_id reachable over links. Rows without words are linked with nothing. ``kept`` is true for a component's smallest
    doc_id. Each row has its own answer, also if ids repeat; rows that share a doc_id have the same if their texts agree.
    A row without an id is linked with nothing, has no component and is kept.
    """
    return _judged(docs, size, similar).drop("row")


def _component() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))


def without_near_duplicates(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; each row by its own answer, also if ids repeat."""
    gone = stored(_judged(docs, size, similar).where(~F.col("kept")).select(F.col("row").alias("_gone")).distinct())
    if gone.count() <= MOST_BROADCAST_IDS:
        gone = F.broadcast(gone)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    kept = whole.join(gone, row_key("_row.doc_id", "_row.text") == F.col("_gone"), "left_anti")
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))

"""Bytes of texts that belong to a string of a given length which also begins elsewhere, found by sorted suffixes.

Induced sorting sorts few suffixes and derives the others from them. Here the few are positions that every string of
the searched length chooses by its own content (``anchors``), about one in seventy bytes. Spark's shuffles and sorts,
which go to disk, are the external queues that carry the suffix tuples:

1. a tuple for each sampled suffix: its name (hash of the first bytes), and its context, which holds all strings that
   chose it. Names that occur once are done: no string that chose them has an equal.
2. equal contexts have a common prefix long enough for all their strings: those are repeated.
3. the strings of the remaining contexts are induced level by level from the sampled suffix they belong to, first in
   blocks of neighbouring starts, by the common part and the union of a block's strings, and then, where the two
   disagree, one by one.

Each level is a sort by (name, hash), so results are those of comparing all strings with all, up to collisions of
128 bits of hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.llm.anchors import NAME_BYTES, SEGMENT_BYTES, Hashes, Samples, sampled
from panelytics.llm.batches import in_batches, text_bytes, text_chunks
from panelytics.llm.storage import row_key, stored

#: Bytes of a repeated string.
LENGTH = 200
#: Neighbouring starts that are tested together before they are tested one by one.
BLOCK = 16


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _checks(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of each row's text, beside the 64 of its key."""
    held = memoryview(data)
    return np.array([zlib.crc32(held[a:b]) & 0xFFFF for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)


def _pack(place: np.ndarray, far: np.ndarray, near: np.ndarray, check: np.ndarray) -> np.ndarray:
    """A sampled suffix in one number: its place in the row, how far before it the strings begin, the row's check."""
    return place << 32 | far << 24 | near << 16 | check


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 32, packed >> 24 & 255, packed >> 16 & 255, packed & 0xFFFF


def _in_segments(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, Hashes, Samples]]:
    """Samples of a chunk, whose hashes cover a bounded number of bytes at a time; each string is in one segment."""
    for start in range(0, max(len(data), 1), SEGMENT_BYTES):
        part = data[start : start + SEGMENT_BYTES + length - 1]
        hashes = Hashes(part)
        yield start, hashes, sampled(hashes, np.clip(bounds - start, 0, len(part)), length)


def samples_of(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(name, context, row, packed) of every sampled suffix. Null texts and those below ``length`` have none."""
    if not NAME_BYTES < length <= NAME_BYTES + 255:
        raise ValueError(f"strings of {NAME_BYTES + 1} to {NAME_BYTES + 255} bytes can be searched")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                data, bounds = text_bytes(chunk.column(1))
                checks = _checks(data, bounds)
                for start, hashes, (place, low, high) in _in_segments(data, bounds, length):
                    if not len(place):
                        continue
                    row = np.searchsorted(bounds, start + low, "right") - 1
                    packed = _pack(start + place - bounds[row], place - low, place - high, checks[row])
                    columns = [
                        _longs(hashes.of(place, place + NAME_BYTES)),
                        _longs(hashes.of(low, high + length)),
                        chunk.column(0).take(pa.array(row)),
                        _longs(packed),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["name", "context", "row", "packed"])

    rows = docs.select(row_key().alias("row"), "text")
    return in_batches(rows, step, "name long, context long, row long, packed long")


def _with_texts(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """(doc_id, text) of ``docs`` joined with a list for each row."""
    lists = lists.withColumnRenamed("row", "_of")
    rows = docs.select("doc_id", "text", row_key().alias("_row"))
    return rows.join(lists, F.col("_row") == F.col("_of"), how).drop("_row", "_of")


def _contexts_with_bytes(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts, and the hashes of their blocks of strings: of what a block's strings have in common, and
    of all they cover."""
    own = F.collect_list(F.struct("name", "context", "single", "packed")).alias("own")
    rows = _with_texts(docs, contexts.groupBy("row").agg(own), "inner")
    block = pa.list_(pa.struct([("block", pa.int64()), ("inner", pa.int64()), ("outer", pa.int64())]))
    names = ["name", "context", "single", "near", "far", "bytes", "blocks"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                out: list[list] = [[] for _ in names]
                for text, own in zip(chunk.column(1), chunk.column(2), strict=True):
                    data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                    check = zlib.crc32(data) & 0xFFFF
                    for item in own.as_py():
                        place, far, near, theirs = (int(x) for x in _unpack(np.array(item["packed"])))
                        if theirs != check or place - near + length > len(data):
                            continue
                        part = data[place - far : place - near + length]
                        hashes = Hashes(part)
                        numbers = np.arange(near // BLOCK, far // BLOCK + 1)
                        first, last = np.maximum(numbers * BLOCK, near), np.minimum(numbers * BLOCK + BLOCK - 1, far)
                        inner = hashes.of(far - numbers * BLOCK, far - numbers * BLOCK - BLOCK + 1 + length)
                        outer = hashes.of(far - last, far - first + length)
                        blocks = zip(
                            numbers.tolist(), inner.view(np.int64).tolist(), outer.view(np.int64).tolist(), strict=True
                        )
                        row = (item["name"], item["context"], item["single"], near, far, part.tobytes())
                        for column, value in zip(
                            out, (*row, [{"block": b, "inner": i, "outer": o} for b, i, o in blocks]), strict=True
                        ):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), block]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return in_batches(
        rows,
        step,
        "name long, context long, single boolean, near long, far long, bytes binary,"
        " blocks array<struct<block:long,inner:long,outer:long>>",
    )


def _strings_of(contexts: DataFrame, length: int) -> DataFrame:
    """(name, context, single, distance, string) of each string in the wanted blocks of contexts: its hash, and how far
    before the sampled suffix it begins."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_chunks(batch, "bytes"):
                which, distances, hashed = [], [], []
                rows = zip(*(piece.column(c).to_pylist() for c in ("near", "far", "bytes", "wanted")), strict=True)
                for i, (near, far, part, wanted) in enumerate(rows):
                    blocks = np.array(sorted(wanted))[:, None] * BLOCK + np.arange(BLOCK)
                    own = blocks[(blocks >= near) & (blocks <= far)]
                    distances.append(own)
                    hashed.append(Hashes(np.frombuffer(part, np.uint8)).of(far - own, far - own + length))
                    which.append(np.full(len(own), i))
                if not which:
                    continue
                row = pa.array(np.concatenate(which))
                columns = [piece.column(c).take(row) for c in ("name", "context", "single")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _longs(np.concatenate(distances)), _longs(np.concatenate(hashed))],
                    ["name", "context", "single", "distance", "string"],
                )

    return in_batches(contexts, step, "name long, context long, single boolean, distance long, string long")


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys with several rows, of which at least one is single. Stored, so that Spark can split a join on them where a
    key has very many rows; it can't while the keys are still being folded in the join's own stage."""
    held = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("single").alias("single"))
    return stored(held.where((F.col("n") > 1) & F.col("single")).select(*keys))


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, packed, near, far): in the row's document, all strings that begin ``near`` to ``far`` bytes before the packed
    suffix also begin elsewhere. All such strings of all documents are given, some more than once."""
    samples = samples_of(docs, length)
    several = stored(samples.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    held = stored(samples.join(several, "name"))
    contexts = stored(
        held.groupBy("name", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "packed")).alias("first")
        )
    ).select("name", "context", (F.col("n") == 1).alias("single"), "first.row", "first.packed")
    far, near = (F.shiftright("packed", n).bitwiseAND(F.lit(255)) for n in (24, 16))
    copied = contexts.where(~F.col("single")).select("name", "context")
    whole = held.join(copied, ["name", "context"], "left_semi").select(
        "row", "packed", near.alias("near"), far.alias("far")
    )

    open_names = contexts.where("single").select("name").distinct()
    bytes_of = stored(_contexts_with_bytes(docs, contexts.join(open_names, "name", "left_semi"), length))
    blocks = bytes_of.select("name", "context", "single", F.inline("blocks"))
    inner = _shared(blocks, "name", "block", "inner")
    outer = _shared(blocks, "name", "block", "outer").withColumn("settled", F.lit(True))
    likely = stored(
        blocks.join(inner, ["name", "block", "inner"], "left_semi")
        .join(outer, ["name", "block", "outer"], "left")
        .select("name", "context", "single", "block", "inner", F.coalesce("settled", F.lit(False)).alias("settled"))
    )
    settled = likely.where("single and settled").select(
        "name", "context", (F.col("block") * BLOCK).alias("near"), (F.col("block") * BLOCK + BLOCK - 1).alias("far")
    )
    undecided = stored(likely.where("single and not settled").select("name", "block", "inner").distinct())
    wanted = (
        likely.join(undecided, ["name", "block", "inner"], "left_semi")
        .groupBy("name", "context")
        .agg(F.collect_set("block").alias("wanted"))
    )
    strings = stored(_strings_of(bytes_of.drop("blocks").join(wanted, ["name", "context"]), length))
    equal = _shared(strings, "name", "string")
    found = strings.where("single").join(equal, ["name", "string"], "left_semi")
    single = settled.union(found.select("name", "context", "distance", "distance")).join(
        contexts.where("single"), ["name", "context"]
    )
    parts = single.select(
        "row", "packed", F.greatest("near", near).alias("near"), F.least("far", far).alias("far")
    )
    return whole.union(parts)


def _covered(size: int, check: int, ranges: list[dict], length: int) -> np.ndarray:
    """Bytes of a text that lie in a repeated string, as runs (start, end)."""
    packed, near, far = (np.array([r[c] for r in ranges], np.int64) for c in ("packed", "near", "far"))
    place, _, _, checks = _unpack(packed)
    kept = checks == check
    start, end = (place - far)[kept], (place - near)[kept] + length
    kept = (start >= 0) & (end <= size)
    order = np.argsort(start[kept], kind="stable")
    start, end = start[kept][order], end[kept][order]
    if not len(start):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return np.stack([start[first], reach[np.append(first[1:], len(start)) - 1]], 1)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed runs of bytes, end exclusive) and ``kept`` (the other bytes).

    A byte goes if any string of ``length`` bytes over it also begins elsewhere, in the same document or another;
    overlapping ones count, and all strings are judged on the input. Matches never cross documents. Null is empty; a
    text below ``length`` loses nothing; all but no bytes of exact copies of longer texts go, from every copy. Each row
    is a document of its own, also if ids repeat or are null; those equal in id and text have one answer.
    """
    # as a set, so that rows equal in id and text don't lengthen their list; stored, so that Spark can split their join
    lists = repeated_starts(docs, length).groupBy("row").agg(F.collect_set(F.struct("packed", "near", "far")).alias("ranges"))
    rows = _with_texts(docs, stored(lists), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                sizes, spans, kept = [], [], []
                for text, ranges in zip(chunk.column(1), chunk.column(2), strict=True):
                    data = (text.as_py() or "").encode()
                    runs = []
                    if ranges.is_valid:
                        runs = _covered(len(data), zlib.crc32(data) & 0xFFFF, ranges.as_py(), length).tolist()
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    ends = [0, *(b for _, b in runs)]
                    kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(data)], strict=True)))
                columns = [chunk.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), *T._parse_datatype_string("n_bytes long, spans array<struct<start:long,end:long>>, kept binary")]
    )
    return in_batches(rows, step, schema)


def report(docs: DataFrame) -> DataFrame:
    """Sizes before and after, the number of removed runs, and a digest of what is left."""
    removed: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

"""Documents as token pieces, packed best-fit into as few sequences of bounded length as possible.

Lengths are whole numbers up to the sequence length, so documents and gaps range-sort into that many classes. Tasks
count the pieces of each class; a bulk-synchronous sweep matches, from the longest class down, all pieces of a class
with the classes of gaps that are their successors (the smallest gaps that hold them), as many at a time as the smaller
class has; the gaps move to their new classes, and the sweep goes on. What two pieces would both take is decided by
rank: the n-th piece of a class gets its n-th gap. The sweep's state is a few numbers for each class whatever the
corpus, and the pieces find their place by joining their rank with the sweep's moves.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelytics.llm.batches import in_batches
from panelytics.llm.storage import stored
from panelytics.llm.vocabularies import WORD_BPE, ChunkTokenizer

#: Tokens of a sequence at most, and the id that ends each document.
SEQUENCE, END_ID = 4096, 1


class Move(NamedTuple):
    """Pieces of ``length`` tokens with ranks from ``rank`` on go, ``count`` of them, to sequences from ``sequence``
    on, one each, at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> list[Move]:
    """Best-fit decreasing over classes of lengths; all pieces of ``counts`` are placed."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, how many)
    state = np.zeros(size + 1, bool)  # which gaps there are
    moves, used = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = np.flatnonzero(state[length:])  # the successor: the smallest gap that holds the length
            if len(fits):
                gap = length + int(fits[0])
                first, there = gaps[gap].pop()
                if not gaps[gap]:
                    state[gap] = False
            else:
                # new sequences: as many as hold the rest when each takes as many of this length as it can
                gap, first, there = size, used, -(-left // (size // length))
                used += there
            take = min(left, there)
            moves.append(Move(length, rank, take, first, size - gap))
            if there > take:
                gaps.setdefault(gap, []).append((first + take, there - take))
                state[gap] = True
            if rest := gap - length:
                gaps.setdefault(rest, []).append((first, take))
                state[rest] = True
            rank, left = rank + take, left - take
    return moves


def pieces_of(docs: DataFrame, tokenizer_path: str = WORD_BPE, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its part and rank among equal lengths there.

    A document is its ids and then ``end_id``; only one of more than ``size`` ids is cut. A null text is empty, so its
    only id is ``end_id``. Repeated rows are documents of their own. ``_part`` is the task that read the document.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = ChunkTokenizer.of(tokenizer_path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            docs_of = []
            ids_of = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    docs_of.append(i)
                    rows.append((piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"]
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(docs_of, pa.int64())), *columns], names)
        encode.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, _part long, _rank long"
    return in_batches(docs.select("doc_id", "text"), cut, schema)


def pack(docs: DataFrame, tokenizer_path: str = WORD_BPE, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; offsets in a sequence have no gaps and start from 0.

    Ranks run over the parts in turn, so that no task sorts the pieces of one length; an empty table gives no rows.
    """
    pieces = stored(pieces_of(docs, tokenizer_path, size, end_id))
    held = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = stored(held.select("length", "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    counts = {n: c for n, c in held.groupBy("length").agg(F.sum("_n")).collect()}  # at most one row per length
    moves = docs.sparkSession.sparkContext.broadcast(_by_length(best_fit(counts, size)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                ranks, sequences, offsets = moves.value[int(n)]
                move = np.searchsorted(ranks, rank[own], "right") - 1
                sequence[own], offset[own] = sequences[move] + rank[own] - ranks[move], offsets[move]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        pieces.join(held.drop("_n"), ["length", "_part"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
        .mapInArrow(
            placed, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
        )
    )


def _by_length(moves: list[Move]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First ranks, sequences and offsets of the moves of each length, in order of rank."""
    out: dict[int, list[Move]] = {}
    for move in moves:
        out.setdefault(move.length, []).append(move)
    return {n: tuple(np.array([[m.rank, m.sequence, m.offset] for m in own], np.int64).T) for n, own in out.items()}

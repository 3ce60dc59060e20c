"""Token counts of documents and of their sections, from one encoding of each whole document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.llm.batches import in_batches
from panelytics.llm.vocabularies import BYTE_BPE


class OffsetEncoder:
    """A byte-level BPE that also says which bytes each id covers."""

    _loaded: dict[str, OffsetEncoder] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._length[rank] = len(token)

    @classmethod
    def of(cls, path: str) -> OffsetEncoder:
        """The one of this Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def ends(self, text: str) -> np.ndarray:
        """The byte position after each token."""
        ids = np.asarray(self._encoding.encode_to_numpy(text, disallowed_special=()), np.int64)
        return np.cumsum(self._length[ids])


def character_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points that each token touches: the first, and one past the last. A token inside a character has that one."""
    starts = np.concatenate([[0], ends[:-1]])
    leads = np.cumsum((data & 0xC0) != 0x80)  # code points begun up to and with each byte
    return leads[starts] - 1, leads[ends - 1]


def sections_of(text: str) -> np.ndarray:
    """Code points at which the sections begin: each line with the break that ends it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.flatnonzero(points[:-1] == 10) + 1]) if len(points) else np.zeros(0, np.int64)


def attribute(first: np.ndarray, last: np.ndarray, begins: np.ndarray, total: int) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary.

    The rule: a token goes to the section that holds most of its code points; of equals, to the earliest. Each token
    goes to exactly one section.
    """
    low, high = (np.searchsorted(begins, x, "right") - 1 for x in (first, last - 1))
    own = low.copy()
    crossing = np.flatnonzero(low != high)
    bounds = np.append(begins, total)
    for t in crossing:
        sections = np.arange(low[t], high[t] + 1)
        held = np.minimum(last[t], bounds[sections + 1]) - np.maximum(first[t], bounds[sections])
        own[t] = sections[np.argmax(held)]
    return np.bincount(own, minlength=len(begins)), len(crossing)


def count_tokens(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_sections``, ``n_crossing`` and ``section_tokens`` of each row of ``docs``.

    Sections are the text's lines; ``section_tokens`` has a count for each and adds up to ``n_tokens``. ``n_crossing``
    counts tokens that touch more than one section. Null and empty texts have no tokens and no sections. A narrow
    step: the intervals of a document's tokens and sections are joined where the document is read.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = OffsetEncoder.of(path)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                begins = sections_of(text)
                if not len(begins):
                    rows.append((0, 0, 0, []))
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                first, last = character_spans(data, encoder.ends(text))
                held, crossing = attribute(first, last, begins, len(text))
                rows.append((len(first), len(begins), crossing, held))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            sections = pa.array([r[3] for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, sections], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"]
            )

    fields = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_sections", "n_crossing")]
    sections = T.StructField("section_tokens", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields, sections])
    return in_batches(docs.select("doc_id", "text"), step, schema)


def report(docs: DataFrame) -> DataFrame:
    """Counts of each document, and the largest section's."""
    return count_tokens(docs).withColumn("max_section_tokens", F.coalesce(F.array_max("section_tokens"), F.lit(0).cast("long")))

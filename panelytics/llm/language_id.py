"""Languages of texts by compression: the language whose sample, as a Zstandard dictionary, makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.llm.batches import in_batches, text_chunks
from panelytics.llm.storage import row_key, stored

#: What a text gets that is null or has no letter.
UNKNOWN = "und"
#: Most rows of each language that a dictionary is made from (those with the smallest keys, see ``row_key``), its most
#: bytes, and the most bytes of all dictionaries together: with very many languages each is as much smaller.
SAMPLE_ROWS, DICTIONARY_BYTES, MODEL_BYTES = 600, 64 << 10, 16 << 20
#: A text is compressed in blocks of about so many bytes, each with the dictionary alone, so that the end of a long
#: text counts like its beginning. All blocks count.
BLOCK_BYTES = 2048
LEVEL = 6
#: Logarithms of the compressor's tables, large enough for a dictionary; the level's own would take 3 MB a language.
TABLES = {"window_log": 17, "chain_log": 16, "hash_log": 16}
#: Bytes that end each block. The format stores a block as it is unless that saves enough; this constant run saves it,
#: so that even a word is stored by its matches in the dictionary.
ENDING = bytes(32)
#: Smallest share by which the second smallest size must exceed the smallest; a text below that is rejected.
NARROW = 0.002

#: Letters and signs of numbers; ``str.isalpha`` tells these apart.
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_BLANK = re.compile(r"\s+")


def _has_letter(text: str) -> bool:
    return any(found[0].isalpha() for found in _MAYBE_LETTER.finditer(text))


def training_rows(docs: DataFrame, may_learn: Column | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` (lang, key, text) of each language: those of the smallest keys, from all rows with text and
    language for which ``may_learn`` holds. A row that repeats counts once, whatever the id is, null too. Only keys
    move before the choice is made, and of a longer text no more than a dictionary holds is fetched."""
    some = F.col("lang").isNotNull() & F.col("text").isNotNull()
    labelled = docs.where(some if may_learn is None else some & may_learn).select(
        F.col("lang").cast("string").alias("lang"),
        row_key().alias("key"),
        F.substring("text", 1, DICTIONARY_BYTES).alias("text"),
    )
    chosen = labelled.select("lang", "key").distinct().withColumn("deal", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(64)))
    for parts in (["lang", "deal"], ["lang"]):  # first in shares, so that a language's keys don't meet in one task
        place = F.row_number().over(Window.partitionBy(*parts).orderBy("key"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= rows).drop("place")
    # stored, so that Spark knows its size when it chooses the join
    return labelled.join(stored(chosen.drop("deal")), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])


def dictionary(texts: Iterable[str], size: int) -> bytes:
    """At most ``size`` bytes of raw text, of each text a like share, so that no single long one fills it."""
    ordered = sorted({_plain(text) for text in texts if _has_letter(text)}, key=lambda text: (len(text), text))
    share = max(256, size // max(1, len(ordered)))
    parts, room = [], size
    for i, text in enumerate(ordered):
        part = text[: max(share, room // (len(ordered) - i))]
        parts.append(part)
        room = max(0, room - len(part))
    return b"".join(parts)[:size]


def dictionaries(docs: DataFrame, may_learn: Column | None = None) -> dict[str, bytes]:
    """For each language with letters a dictionary of raw text, made where its sampled rows meet. One language's rows
    never change another's dictionary; only the number of languages does, beyond MODEL_BYTES / DICTIONARY_BYTES."""
    sample = stored(training_rows(docs, may_learn))
    size = min(DICTIONARY_BYTES, MODEL_BYTES // max(1, sample.select("lang").distinct().count()))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "dictionary": [dictionary(group["text"], size)]})

    # SAMPLE_ROWS x DICTIONARY_BYTES characters a group at most, MODEL_BYTES in all
    made = sample.select("lang", "text").groupBy("lang").applyInPandas(make, "lang string, dictionary binary").collect()
    return {lang: bytes(found) for lang, found in sorted(made) if found}


def _plain(text: str) -> bytes:
    """Lower case, with one blank around and between words, so that words match those of the dictionary."""
    return f" {_BLANK.sub(' ', text).strip().lower()} ".encode()


class Compressors:
    """One compressor for each language, ready to use."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, **TABLES, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self._compressors = []
        for lang in self.languages:
            sample = zstandard.ZstdCompressionDict(samples[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sample.precompute_compress(compression_params=parameters)
            self._compressors.append(zstandard.ZstdCompressor(dict_data=sample, compression_params=parameters))

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes of the whole text with each language's dictionary."""
        return [
            sum(len(c.compress(text[at : at + BLOCK_BYTES] + ENDING)) for at in range(0, len(text), BLOCK_BYTES))
            for c in self._compressors
        ]

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and the margin: by which share the next size is above the smallest. 1.0 if there is no next."""
        if not text or not self.languages or not _has_letter(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(_plain(text))
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        return self.languages[order[0]], (second - best) / second


def identify(docs: DataFrame, samples: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected`` of each row of ``docs``.

    Null, empty and letterless texts are UNKNOWN, with score 0, and rejected; so are those with a margin below
    ``narrow``, which keep the predicted language. Of equal sizes the first language in alphabetical order wins. No
    shuffle; equal texts get equal answers.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(samples)  # MODEL_BYTES at most

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Compressors(shared.value)
        for batch in batches:
            for chunk in text_chunks(batch):
                found = [ready.classify(text) for text in chunk.column(1).to_pylist()]
                lang, score = ([f[i] for f in found] for i in (0, 1))
                rejected = [name == UNKNOWN or margin < narrow for name, margin in found]
                columns = [chunk.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return in_batches(docs.select("doc_id", "text"), step, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    samples = dictionaries(docs, ~held_out(F.col("doc_id")))
    return identify(docs, samples).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, samples: dict[str, bytes] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is told, with all their columns. Without ``samples``, learned from ``docs``."""
    samples = dictionaries(docs) if samples is None else samples
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), "text")
    kept = identify(whole, samples).where(~F.col("rejected"))
    return kept.select(*(F.col("doc_id").getField(c).alias(c) for c in docs.columns))

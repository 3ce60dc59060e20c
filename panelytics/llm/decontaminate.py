"""Verbatim passages of a benchmark in documents, found by searching suffixes of words in one sorted order.

A suffix is named by a digest of its first words (ten, or all of a shorter item), so equal beginnings stand together
however suffixes are spread. The benchmark's suffixes are a table with one row per name; a sieve of bounded size made
from their hashes goes to the tasks that read documents, and only document suffixes that pass it are written. Both are
sorted by name and merged by Spark's join. A name keeps how often it occurs and which name follows all its occurrences,
so neighbouring hits grow to longest matches without a row for each item that shares them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.llm.batches import LOWER, Words, byte_table, in_batches, text_bytes, text_chunks, window_hashes, words_of
from panelytics.llm.storage import row_key, stored

#: Words are runs of digits, letters a-z and every byte of a character beyond ASCII.
IN_WORD = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: The sieve has this many bits for each name, between these powers of two. A fuller one only lets more suffixes pass.
BITS_PER_NAME, LEAST_POWER, MOST_POWER = 64, 22, 29
#: The sieve is put together from pages of this power of two of bits.
_PAGE_POWER = 16

_SUFFIXES = "array<struct<place:int,name:binary>>"
_OCCURRENCES = "item_row long, item_id string, word int, depth int, hash long, name binary, next binary"


def _names(low: bytes, words: Words, at: np.ndarray, depth: int) -> list[bytes]:
    """The digest of the ``depth`` words from each of the positions ``at``; words hold no blank, so it joins them."""
    start, end = words.start, words.end
    out = []
    for i in at.tolist():
        own = [low[s:e] for s, e in zip(start[i : i + depth].tolist(), end[i : i + depth].tolist(), strict=True)]
        out.append(blake2b(b" ".join(own), digest_size=16).digest())
    return out


def occurrences(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every suffix of the benchmark: its item, first word, depth (words that name it), hash, name, and the name of the
    suffix a word later in the same item. Items without words have none; of items with fewer words than ``window`` only
    the whole is a suffix."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                data, bounds = text_bytes(chunk.column(2))
                words = words_of(data, bounds, IN_WORD)
                low = LOWER[data].tobytes()
                counts = np.bincount(words.row, minlength=chunk.num_rows)
                offset = np.cumsum(counts) - counts
                for depth in sorted({min(int(n), window) for n in counts if n}):
                    at, hashes = window_hashes(words, depth)
                    kept = counts[words.row[at]] >= window if depth == window else counts[words.row[at]] == depth
                    at, hashes = at[kept], hashes[kept]
                    names, item = _names(low, words, at, depth), words.row[at]
                    goes_on = np.append(item[1:] == item[:-1], False)
                    follows = [n if more else None for n, more in zip([*names[1:], None], goes_on, strict=True)]
                    columns = [
                        chunk.column(0).take(pa.array(item)),
                        chunk.column(1).take(pa.array(item)),
                        pa.array((at - offset[item]).astype(np.int32)),
                        pa.array(np.full(len(at), depth, np.int32)),
                        pa.array(hashes.view(np.int64)),
                        pa.array(names, pa.binary()),
                        pa.array(follows, pa.binary()),
                    ]
                    names_of = ["item_row", "item_id", "word", "depth", "hash", "name", "next"]
                    yield pa.RecordBatch.from_arrays(columns, names_of)

    rows = items.select(
        F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("string").alias("item_id"), "text"
    )
    return stored(in_batches(rows, step, _OCCURRENCES))


def bench_suffixes(found: DataFrame) -> DataFrame:
    """One row for each name among ``occurrences``: depth, hash, ``n`` occurrences, the name that ``follows`` all of them
    and nothing else, and a class shared by names with the same set of (not null) item ids."""
    of_item = found.groupBy("name", "item_id").agg(
        F.min("depth").alias("depth"),
        F.min("hash").alias("hash"),
        F.count("*").alias("n"),
        F.count("next").alias("n_next"),
        F.min("next").alias("low"),
        F.max("next").alias("high"),
    )
    known = F.col("item_id").isNotNull()
    names = stored(
        of_item.groupBy("name").agg(
            F.min("depth").alias("depth"),
            F.min("hash").alias("hash"),
            F.sum("n").alias("n"),
            F.when((F.sum("n_next") == F.sum("n")) & (F.min("low") == F.max("high")), F.min("low")).alias("next"),
            F.count("item_id").alias("n_items"),
            F.coalesce(F.expr("bit_xor(if(item_id is null, 0, xxhash64(item_id)))"), F.lit(0)).alias("one"),
            F.coalesce(F.expr("bit_xor(if(item_id is null, 0, xxhash64(1, item_id)))"), F.lit(0)).alias("two"),
        )
    )
    after = names.select(F.col("name").alias("next"), F.col("n").alias("n_after"))
    return stored(
        names.join(after, "next", "left").select(
            "name", "depth", "hash", F.when(F.col("n") == F.col("n_after"), F.col("next")).alias("follows"), "n_items", "one", "two"
        )
    )


def _sieve(suffixes: DataFrame) -> np.ndarray:
    """A bit for each of two parts of the hashes, as bytes; made in pages by tasks, at most 64 MB in all."""
    wanted = max(1, suffixes.count() * BITS_PER_NAME)
    power = min(MOST_POWER, max(LEAST_POWER, (wanted - 1).bit_length()))
    high, low = F.shiftrightunsigned("hash", 64 - power), F.col("hash").bitwiseAND((1 << power) - 1)
    bits = suffixes.select(F.explode(F.array(high, low)).alias("bit"))

    def page(rows: pa.Table) -> pa.Table:
        bit = rows.column("bit").to_numpy()
        inside = np.zeros(1 << _PAGE_POWER, bool)
        inside[bit & ((1 << _PAGE_POWER) - 1)] = True
        packed = np.packbits(inside, bitorder="little").tobytes()
        return pa.table({"page": pa.array([int(bit[0]) >> _PAGE_POWER], pa.int64()), "bits": pa.array([packed], pa.binary())})

    pages = bits.distinct().groupBy(F.shiftright("bit", _PAGE_POWER).alias("of")).applyInArrow(page, "page long, bits binary")
    out = np.zeros(1 << (power - 3), np.uint8)
    size = 1 << (_PAGE_POWER - 3)
    for number, packed in pages.toLocalIterator():
        out[number * size : (number + 1) * size] = np.frombuffer(packed, np.uint8)
    return out


def _passing(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    power = (len(sieve) << 3).bit_length() - 1
    out = np.ones(len(hashes), bool)
    for bit in (hashes >> np.uint64(64 - power), hashes & np.uint64((1 << power) - 1)):
        bit = bit.astype(np.int64)
        out &= (sieve[bit >> 3] >> (bit & 7) & 1).astype(bool)
    return out


def _searched(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``rows`` with ``n_words`` and, in place of their last column ``text``, the place and name of each suffix that
    passes the sieve. The benchmark itself doesn't travel: only the sieve and the depths in use (``WINDOW`` at most)."""
    depths = sorted(d for (d,) in suffixes.select("depth").distinct().collect())
    sieve = rows.sparkSession.sparkContext.broadcast(_sieve(suffixes))
    added = T._parse_datatype_string(f"n_words long, suffixes {_SUFFIXES}")
    schema = T.StructType([*rows.schema.fields[:-1], *added.fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                data, bounds = text_bytes(chunk.column(chunk.num_columns - 1))
                words = words_of(data, bounds, IN_WORD)
                counts = np.bincount(words.row, minlength=chunk.num_rows)
                offset = np.cumsum(counts) - counts
                low, ats, names = None, [np.zeros(0, np.int64)], []
                for depth in depths:
                    at, hashes = window_hashes(words, depth)
                    at = at[_passing(hashes, sieve.value)]
                    if len(at):
                        low = low or LOWER[data].tobytes()
                        ats.append(at)
                        names += _names(low, words, at, depth)
                at = np.concatenate(ats)
                order = np.argsort(at, kind="stable")
                row = words.row[at[order]]
                place = (at[order] - offset[row]).astype(np.int32)
                own = pa.StructArray.from_arrays(
                    [pa.array(place), pa.array(names, pa.binary()).take(pa.array(order))], ["place", "name"]
                )
                ends = np.searchsorted(row, np.arange(chunk.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), own)
                columns = [*chunk.columns[:-1], pa.array(counts.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return stored(in_batches(rows, step, schema))


def _passages(searched: DataFrame, suffixes: DataFrame, key: list[str]) -> DataFrame:
    """Longest runs of hits that the same items share throughout: ``start``, ``n_words``, the first suffix's name and
    depth, and the class of the items. ``key`` tells the documents apart. Work grows with hits, not with hits x items."""
    own = searched.where(F.size("suffixes") > 0).select(*key, F.inline("suffixes"))
    hits = own.join(suffixes.drop("hash"), "name")
    order = Window.partitionBy(*key, "depth").orderBy("place")
    joined = (F.lag("follows").over(order) == F.col("name")) & (F.lag("place").over(order) == F.col("place") - 1)
    runs = hits.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return stored(
        runs.groupBy(*key, "depth", "run")
        .agg(
            F.min("place").alias("start"),
            (F.count("*") + F.first("depth") - 1).cast("int").alias("n_words"),
            F.min_by("name", "place").alias("name"),
            F.first("n_items").alias("n_items"),
            F.first("one").alias("one"),
            F.first("two").alias("two"),
        )
        .drop("run")
    )


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each longest match: doc_id, item_id, its first word in the item and in the document, words.

    A match is the longest run of ``window`` or more words that a document and an item share there (all words of an
    item that has fewer). Null texts, texts without words and an empty benchmark give none. Repeated documents are
    searched alike, each for itself; so are repeated items. The rows are as many as there are matches.
    """
    found = occurrences(items, window)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    suffixes = bench_suffixes(found)
    passages = _passages(_searched(rows, suffixes), suffixes, ["row", "doc_id"])
    pairs = stored(passages.join(found.select("name", "item_row", "item_id", "word"), "name"))
    order = Window.partitionBy("row", "item_row", "depth", F.col("word") - F.col("start")).orderBy("start")
    joined = F.lag(F.col("start") + F.col("n_words")).over(order) == F.col("start") + F.col("depth") - 1
    runs = pairs.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        runs.groupBy("row", "item_row", "depth", (F.col("word") - F.col("start")).alias("way"), "run")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("item_id").alias("item_id"),
            F.min("word").alias("item_word"),
            F.min("start").alias("start"),
            (F.max(F.col("start") + F.col("n_words")) - F.min("start")).alias("n_words"),
        )
        .select("doc_id", "item_id", "item_word", "start", "n_words")
    )


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items found and their digest, whether any word is hit, and the words of
    its longest passage that the same items share throughout (0 without one).

    Null texts and texts without words have no hits; an empty benchmark gives none. Repeated documents, also with null
    ids, are searched alike; items with equal ids count as one, those with a null id hit words but aren't counted.
    """
    found = occurrences(items, window)
    suffixes = bench_suffixes(found)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    searched = _searched(rows, suffixes)
    passages = _passages(searched, suffixes, ["row"])
    end = F.col("start") + F.col("n_words")
    before = F.max(end).over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    more = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hit = (
        passages.select("row", "n_words", more.alias("more"))
        .groupBy("row")
        .agg(F.sum("more").alias("n_hit"), F.max("n_words").alias("longest"))
    )
    of_class = ["n_items", "one", "two"]
    classes = stored(passages.where("n_items > 0").select("row", *of_class).distinct())
    spelled = suffixes.where("n_items > 0").groupBy(*of_class).agg(F.min("name").alias("name"))
    ids = spelled.join(found.where("item_id is not null").select("name", "item_id").distinct(), "name")
    by_row = (
        classes.join(stored(ids.select(*of_class, "item_id")), of_class)
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    )
    none = F.array().cast("array<string>")
    both = searched.select("row", "doc_id", "n_words").join(hit, "row", "left").join(by_row, "row", "left")
    listed: Column = F.coalesce("ids", none)
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no passage of ``items`` occurs, with all their columns. Rows are told apart by 128
    bits of id and text; null and empty texts stay, and so does everything if the benchmark is empty."""
    other_key = F.xxhash64(F.lit(1), "text", "doc_id")
    suffixes = bench_suffixes(occurrences(items, window))
    searched = _searched(docs.select(row_key().alias("one"), other_key.alias("two"), "text"), suffixes)
    own = searched.where(F.size("suffixes") > 0).select("one", "two", F.inline("suffixes"))
    leaky = stored(own.join(suffixes.select("name"), "name", "left_semi").select("one", "two").distinct())
    return docs.join(leaky, (row_key() == leaky["one"]) & (other_key == leaky["two"]), "left_anti")

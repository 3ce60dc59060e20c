"""Exact membership of URL keys in rule lists by a cascade of Bloom filters, without joining the URLs to the lists."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.llm.storage import stored

# The rules as (host, path) and verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hosts that are blocked, with their subdomains, where no rule fits.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")
#: Bits a key in a filter, and the number of its hash functions.
BITS_PER_KEY, PROBES = 20, 7
#: A filter is broadcast; lists that need a larger one are split by hash into as many cascades as keep below this.
MOST_FILTER_BYTES = 64 << 20
_LEAST_FILTER_BYTES = 64
#: Filters reach the driver in pages of this power of two of 64-bit words.
_PAGE_POWER = 10


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """All keys under which a URL may be listed, the longest first: the host's last labels, as many as some listed host
    has, without and with the path's first characters, as many as some listed path has. An empty host or path gives
    none of that kind. A long host gives no more keys than the list has such numbers."""
    parts = F.split(host, r"\.")
    counts = F.array(*(F.lit(n) for n in sorted(labels, reverse=True))).cast("array<int>")
    suffixes = F.transform(
        F.filter(counts, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    )
    heads = F.filter(
        F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True))),
        lambda head: head.isNotNull(),
    )
    with_paths = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda head: F.concat(s, head))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(with_paths, suffixes))


class Cascade(NamedTuple):
    """Filters of listed keys and, in turn, of keys that wrongly passed the one before; arrays of 64-bit words."""

    filters: tuple[Broadcast, ...]


def _hashed() -> list[Column]:
    return [F.xxhash64("key").alias("one"), F.xxhash64(F.lit(1), "key").alias("two")]


def _bits(one: np.ndarray, two: np.ndarray, n_words: int, level: int, probe: int) -> np.ndarray:
    """Numbers of the bits of keys, given as two hashes each, in a filter of the cascade's ``level``."""
    turned = one.view(np.uint64) * np.uint64(2 * level + 1) + (two.view(np.uint64) | np.uint64(1)) * np.uint64(probe)
    return (turned ^ (turned >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(64 * n_words)


def _passes(words: np.ndarray, one: np.ndarray, two: np.ndarray, level: int) -> np.ndarray:
    """Whether each key passes a filter."""
    out = np.ones(len(one), bool)
    for probe in range(PROBES):
        bit = _bits(one, two, len(words), level, probe)
        out &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _filter_of(keys: DataFrame, n_keys: int, level: int) -> Broadcast:
    """The filter of ``keys``: tasks set bits, join equal words with OR and put them together in pages of 8 KB; the
    driver gets the pages one by one and sends the whole to the tasks."""
    n_words = max(1, -(-n_keys * BITS_PER_KEY // 64))

    def words(batches):
        for batch in batches:
            one, two = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two"))
            bit = np.concatenate([_bits(one, two, n_words, level, probe) for probe in range(PROBES)])
            word, mask = (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))
            at, where = np.unique(word, return_inverse=True)
            joined = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(joined, where, mask)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(joined.view(np.int64))], ["word", "bits"])

    def page(own: pa.Table) -> pa.Table:
        word, bits = (own.column(c).to_numpy() for c in ("word", "bits"))
        out = np.zeros(1 << _PAGE_POWER, np.int64)
        out[word & ((1 << _PAGE_POWER) - 1)] = bits
        return pa.table({"page": pa.array([int(word[0]) >> _PAGE_POWER], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    rows = keys.select("one", "two").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    pages = rows.groupBy(F.shiftright("word", _PAGE_POWER).alias("of")).applyInArrow(page, "page long, bits binary")
    size = 1 << _PAGE_POWER
    out = np.zeros(-(-n_words // size) * size, np.uint64)
    for number, bits in pages.toLocalIterator():
        out[number * size : (number + 1) * size] = np.frombuffer(bits, np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out[:n_words])


def _passing(keys: DataFrame, words: Broadcast, level: int) -> DataFrame:
    """The keys that pass a filter."""

    def kept(batches):
        for batch in batches:
            one, two = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two"))
            yield batch.filter(pa.array(_passes(words.value, one, two, level)))

    return keys.mapInArrow(kept, keys.schema)


def build(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """A cascade that tells which keys of ``universe`` are in ``listed``, exactly; both have the column ``key``.

    The first filter holds the listed keys; the second those keys of the universe that wrongly pass it; the third the
    listed keys that wrongly pass the second; and so on, until none passes wrongly. None if a filter would be larger
    than MOST_FILTER_BYTES; ``cascades`` then splits the keys. Null keys are in no list. An empty list gives an empty
    first filter.
    """
    ours = listed.where(F.col("key").isNotNull()).select("key").distinct().select("key", *_hashed())
    inside, outside, filters = stored(ours), None, []
    theirs = universe.where(F.col("key").isNotNull()).select("key", *_hashed())
    while True:
        level = len(filters)
        count = inside.count()
        if count * BITS_PER_KEY > max(MOST_FILTER_BYTES, _LEAST_FILTER_BYTES) * 8:
            _drop(filters)
            return None
        if level and not count:
            return Cascade(tuple(filters))
        filters.append(_filter_of(inside, count, level))
        if outside is None:  # the universe is tested once; only what passes is compared with the list
            outside = _passing(theirs, filters[0], 0).join(ours.select("key"), "key", "left_anti").select("key", "one", "two")
        else:
            outside = _passing(outside, filters[-1], level)
        inside, outside = stored(outside), inside


def _drop(filters) -> None:
    for words in filters:
        words.unpersist()


def _in_part(number: int, of: int) -> Callable[[Column], Column]:
    return lambda key: F.pmod(F.xxhash64(F.lit(2), key), F.lit(of)) == number


def members(one: np.ndarray, two: np.ndarray, cascade: Cascade) -> np.ndarray:
    """Which keys are listed: those that leave the cascade after an odd number of filters."""
    listed, going = np.zeros(len(one), bool), np.arange(len(one))
    for level, words in enumerate(cascade.filters):
        going = going[_passes(words.value, one[going], two[going], level)]
        listed[going] = level % 2 == 0
    return listed


def listed_keys(rows: DataFrame, cascade: Cascade, out: str, keys: str = "keys") -> DataFrame:
    """``rows`` with ``out``: those of the row's array ``keys`` that the cascade has. A narrow step, without a join."""
    hashed = rows.withColumns(
        {
            "_one": F.transform(keys, lambda k: F.xxhash64(k)),
            "_two": F.transform(keys, lambda k: F.xxhash64(F.lit(1), k)),
        }
    )
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

    def marked(batches):
        for batch in batches:
            names = batch.schema.names
            keys_of_rows = batch.column(names.index(keys))
            one, two = (
                batch.column(names.index(c)).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_one", "_two")
            )
            listed = members(one, two, cascade)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(keys_of_rows), 0).to_numpy(False))[listed]
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), keys_of_rows.flatten().filter(pa.array(listed)))
            columns = [batch.column(i) for i, c in enumerate(names) if c not in ("_one", "_two")]
            yield pa.RecordBatch.from_arrays([*columns, found.cast(pa.list_(pa.string()))], [f.name for f in schema])

    return hashed.mapInArrow(marked, schema)


def _listed(rows: DataFrame, listed: DataFrame, universe: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: those of the row's ``keys`` that are listed.

    A list too large for one broadcast is split by hash; each part has a cascade of its own over its part of the
    universe, and the parts are looked up one after another, so that a task holds the filters of one part only.
    """
    bounded = max(MOST_FILTER_BYTES, _LEAST_FILTER_BYTES)
    listed = stored(listed.where(F.col("key").isNotNull()).select("key").distinct())
    parts = max(1, -(-listed.count() * BITS_PER_KEY // (8 * bounded)))
    if parts == 1 and (cascade := build(listed, universe)):
        return listed_keys(rows, cascade, out)
    rows = rows.withColumn(out, F.array().cast("array<string>"))
    parts = max(2, parts)
    to_do = [(number, parts) for number in range(parts)]
    while to_do:
        number, of = to_do.pop()
        own = _in_part(number, of)
        cascade = build(listed.where(own(F.col("key"))), universe.where(own(F.col("key"))))
        if cascade is None:  # too many keys passed wrongly for one filter: this part divides in two
            to_do += [(number, 2 * of), (number + of, 2 * of)]
            continue
        some = rows.withColumn("_own", F.filter("keys", own))
        found = listed_keys(some, cascade, "_found", "_own")
        rows = stored(found.withColumn(out, F.concat(out, "_found")).drop("_own", "_found"))
        _drop(cascade.filters)
    return rows


def _table(spark, rows, schema: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return rows.select(*names) if isinstance(rows, DataFrame) else spark.createDataFrame([*rows], schema)


def judge(pages: DataFrame, rules=RULES, hosts=LISTED_HOSTS) -> DataFrame:
    """page_id, host, path, rule and verdict of each row.

    The longest fitting rule decides (of two as long, the one with the longer host); ``rule`` is its host and path.
    Without one ``rule`` is null, and the verdict is block if the host or a parent of it is among ``hosts``, else
    allow. Null URLs and those without ``://`` have empty host and path, which no rule fits. Repeated rows are judged
    alike. Which of a URL's keys are listed is told by one cascade for each list. ``rules`` (host, path, verdict) and
    ``hosts`` (host) are rows or tables of any size; a rule or host with a null is in no list.
    """
    spark = pages.sparkSession
    rules = _table(spark, rules, "host string, path string, verdict string")
    hosts = _table(spark, hosts if isinstance(hosts, DataFrame) else [(h,) for h in hosts], "host string")
    key = F.concat("host", "path").alias("key")
    lists = {
        "_allow": rules.where("verdict = 'allow'").select(key),
        "_block": rules.where("verdict = 'block'").select(key),
        "_host": hosts.select(F.col("host").alias("key")),
    }
    # numbers of characters and labels that are in use: no more of them than the longest path and host have
    lengths = [n for (n,) in rules.where("path <> ''").select(F.length("path")).distinct().collect()]
    labels = [
        n
        for (n,) in rules.select("host").union(hosts).where("host is not null").select(F.size(F.split("host", r"\."))).distinct().collect()
    ]
    rows = stored(
        pages.select("page_id", "url")
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    )
    universe = stored(rows.select(F.explode("keys").alias("key")).distinct())
    for out, keys in lists.items():
        rows = _listed(rows, keys, universe, out)

    def fitting(name: str, verdict: str) -> Column:
        slash = lambda k: F.when(F.instr(k, "/") > 0, F.instr(k, "/")).otherwise(F.length(k) + 1)
        return F.transform(
            name,
            lambda k: F.struct(F.length(k).alias("n"), slash(k).alias("host"), k.alias("rule"), F.lit(verdict).alias("verdict")),
        )

    best = F.array_max(F.concat(fitting("_allow", "allow"), fitting("_block", "block")))
    return rows.withColumn("_best", best).select(
        "page_id",
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.when(F.size("_host") > 0, "block").otherwise("allow")).alias("verdict"),
    )

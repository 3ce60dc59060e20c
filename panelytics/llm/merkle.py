"""A manifest of documents as hash trees: one over the rows of each language by id, and one over the trees' roots.

The nodes of a level lie one after another, so a tree's shape follows from its number of leaves: every FAN_OUT
consecutive nodes have one parent, the last ones fewer. Spark holds a tree in aligned blocks of BLOCK nodes. A block
keeps each of its levels as one string of hex digests; parents are hashes of its substrings of fixed width, a node's
siblings are the substrings on both sides of it, and the blocks' roots are the nodes of the next round, until one block
holds what is left. No task ever holds more than a block, however many rows a language has, and each round is
BLOCK times smaller than the one before.

Null fields are told apart from empty ones, a null language has a tree of its own, and rows without an id come first.
Rows that are equal in all fields are leaves of their own next to each other. No documents have no tree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics.llm.storage import stored

#: Children of a node, characters of a digest, and levels that a block climbs.
FAN_OUT, DIGEST, LEVELS = 8, 64, 3
BLOCK = FAN_OUT**LEVELS
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Columns of a block that hold its levels, from its own nodes up.
_LEVELS = [f"level{k}" for k in range(LEVELS)]
_EMPTY_PATH = "array<struct<left:string,right:string>>"
_MAX_ID_BITS = 33  # monotonically_increasing_id: the bits above count partitions


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column | None = None) -> Column:
    """The hash of a row: each field as its length in bytes, a colon and its value, or a dash if it is null."""
    values = [F.col(name).cast("string") for name in FIELDS]
    if text is not None:
        values[FIELDS.index("text")] = text
    return digest(
        *(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)
    )


def tree_key(lang: Column) -> Column:
    """The tree of a language; in the order of languages, null before all, and never null itself."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree`` by ``order`` (nulls first), and ``n``, the tree's size.

    One range partitioning by tree, order and input place, so that neither a large tree nor equal rows meet in one task;
    places are then counted on from sums for each tree and partition. The result is stored.
    """
    marked = rows.withColumn("_input", F.monotonically_increasing_id())
    keys = ["tree", *order, "_input"]
    dealt = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_input")
    dealt = stored(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _MAX_ID_BITS)
    # a row for each partition and tree that meet: together no more than both
    starts = dealt.groupBy("tree", part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_held"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    starts = stored(
        starts.select(
            "tree",
            "_part",
            (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_held").over(whole).alias("n"),
        )
    )
    placed = dealt.withColumn("_part", part).join(starts, ["tree", "_part"])
    return placed.withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def parents(level: Column) -> Column:
    """The level above, as one string: the hash of each run of FAN_OUT digests."""
    width = FAN_OUT * DIGEST
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    # levels are bytes, of which substrings are cut without walking over the characters before them
    hashed = F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256))
    return F.array_join(hashed, "").cast("binary")


def _height(n: Column) -> Column:
    """Levels to climb in a block of a tree with ``n`` nodes in this round."""
    height = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        height = F.when(n <= FAN_OUT**k, F.lit(k)).otherwise(height)
    return height


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, held, level0.., height, node): one row for each BLOCK of ``nodes`` (tree, n, pos, node, item).

    ``held`` has the block's nodes with what came with them, ``node`` is the block's root.
    """
    held = F.array_sort(F.collect_list(F.struct("pos", "node", "item"))).alias("held")
    out = nodes.groupBy("tree", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(held)
    out = out.withColumn(_LEVELS[0], F.array_join("held.node", "").cast("binary"))
    for below, above in zip(_LEVELS, [*_LEVELS[1:], "_top"]):
        out = out.withColumn(above, parents(F.col(below)))
    out = out.withColumn("height", _height(F.col("n")))
    root = F.col("_top")
    for k, level in enumerate(_LEVELS):
        root = F.when(F.col("height") == k, F.col(level)).otherwise(root)
    return out.withColumn("node", root.cast("string")).drop("_top")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of each round from ``nodes`` up, stored; in the last one each tree is one block."""
    rounds = []
    while True:
        rounds.append(stored(blocks_of(nodes)))
        if (rounds[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return rounds
        nodes = rounds[-1].select(
            "tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), "node", F.lit(None).alias("item")
        )


def _siblings(place: Column) -> Column:
    """What flanks the node at ``place`` of a block on each level that the block climbs."""
    steps = []
    for k, level in enumerate(_LEVELS):
        at = F.floor(place / FAN_OUT**k).cast("int")
        in_run = at % FAN_OUT
        left = F.substring(F.col(level), (at - in_run) * DIGEST + 1, in_run * DIGEST)
        right = F.substring(F.col(level), (at + 1) * DIGEST + 1, (FAN_OUT - 1 - in_run) * DIGEST)
        steps.append(F.struct(left.cast("string").alias("left"), right.cast("string").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("height"))


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, node, item, path, top) of every node of the first round.

    ``path`` has (left, right), the siblings joined on both sides, for each level up to the tree's root and then those
    that ``above`` (tree, path, top) adds; ``top`` is carried down from there.
    """
    higher = above.select("tree", F.lit(0).cast("long").alias("block"), F.col("path").alias("_higher"), "top")
    for i, blocks in reversed(list(enumerate(rounds))):
        place = lambda x: x["pos"] - F.col("block") * BLOCK
        each = F.transform(
            "held",
            lambda x: F.struct(
                x["pos"].alias("pos"),
                x["node"].alias("node"),
                x["item"].alias("item"),
                F.concat(_siblings(place(x)), F.col("_higher")).alias("path"),
            ),
        )
        out = blocks.join(higher, ["tree", "block"]).select("tree", "top", F.inline(each))
        if i:
            higher = stored(out.select("tree", F.col("pos").alias("block"), F.col("path").alias("_higher"), "top"))
    return out


class Manifest(NamedTuple):
    """``rounds``: blocks of the trees of all languages, ``top``: blocks of the tree over their roots, ``lang_roots``:
    (tree, subroot, lang)."""

    rounds: list[DataFrame]
    top: list[DataFrame]
    lang_roots: DataFrame

    def root(self) -> DataFrame:
        """One row: the root of all (no row without documents)."""
        return self.top[-1].select(F.col("node").alias("root"))


def manifest(docs: DataFrame, *more: Column) -> Manifest:
    """The trees of ``docs``; ``more`` columns go with each leaf. Texts are hashed once and don't move."""
    item = F.struct("doc_id", "lang", *more).alias("item")
    leaves = docs.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf().alias("node"), item)
    # stored first, as range partitioning reads its input twice
    rounds = climb(ranked(stored(leaves), ["doc_id", "node"]))
    lang = F.get(F.col("held.item.lang"), F.lit(0))
    if len(rounds) > 1:  # upper rounds carry no items; a tree's name tells its language
        lang = F.when(F.col("tree") != "", F.substring(F.col("tree"), F.lit(2), F.length("tree")))
    lang_roots = stored(rounds[-1].select("tree", F.col("node").alias("subroot"), lang.alias("lang")))
    over = lang_roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node"))
    top = climb(ranked(over.withColumn("item", F.struct("name")), ["name"]))
    return Manifest(rounds, top, lang_roots)


def proofs(held: Manifest) -> DataFrame:
    """(item, leaf, subroot, root, path) of every row: ``fold`` of its path from its leaf gives the root."""
    bottom = held.top[-1].select("tree", F.from_json(F.lit("[]"), _EMPTY_PATH).alias("path"), F.col("node").alias("root"))
    roots = held.lang_roots.select(F.col("tree").alias("name"), "subroot")
    over = paths(held.top, bottom.select("tree", "path", F.struct("root").alias("top")))
    over = over.select(F.col("item.name").alias("name"), "path", "top.root").join(roots, "name")
    over = stored(over.select(F.col("name").alias("tree"), "path", F.struct("subroot", "root").alias("top")))
    return paths(held.rounds, over).select("item", F.col("node").alias("leaf"), "top.subroot", "top.root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to between the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda so_far, x: F.sha2(F.concat(x["left"], so_far, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def verify(docs: DataFrame, text: Column) -> DataFrame:
    """Every row's place in the manifest of ``docs``, and whether the row still proves to belong to it with ``text``.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): ``folded_root`` goes up from the leaf of the
    changed row between the original siblings.
    """
    changed = leaf(text)
    found = proofs(manifest(docs, F.when(~text.eqNullSafe(F.col("text")), changed).alias("changed")))
    folded = F.col("_folded")
    return found.withColumn("_folded", fold(F.coalesce("item.changed", "leaf"), F.col("path"))).select(
        F.col("item.doc_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


def tampered(doc_id: Column, text: Column) -> Column:
    """``text`` with A-Z lower-cased where 3 divides the CRC of the id; a row without an id is left alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, upper, upper.lower())).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """Every row's proof, checked against rows of which a third were tampered with."""
    return verify(docs, tampered(F.col("doc_id"), F.col("text")))

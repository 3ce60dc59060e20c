"""Connected components of links, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (columns a and b, not null); ``component`` is the smallest id reachable.

    Each round, every id goes to the neighbour, or itself, that comes first in one random order of all ids; links
    between what ids went to remain. That takes a number of rounds in the order of the logarithm of the number of ids,
    whatever the shape. A hub's neighbours are folded before they are shuffled.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = stored(links.where("a <> b").select("a", "b"))
    where = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("at", F.col("id"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("other"))
        goes = stored(first.select(F.col("a").alias("x"), F.least(rank("a"), F.col("other"))["id"].alias("to")))
        where = stored(
            where.join(goes, where["at"] == goes["x"], "left").select("id", F.coalesce("to", "at").alias("at"))
        )
        left = edges.join(goes, edges["a"] == goes["x"]).select(F.col("to").alias("a"), "b")
        right = left.join(goes, left["b"] == goes["x"]).select("a", F.col("to").alias("b")).where("a <> b")
        edges = stored(right.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    smallest = where.groupBy("at").agg(F.min("id").alias("component"))
    return where.join(smallest, "at").select("id", "component")

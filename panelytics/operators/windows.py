"""Running totals and trailing means, with and without a whole entity in one task.

Panels hold one row per entity and day, so an entity is small and one plain window is the cheapest plan. For tables
whose entities have unbounded numbers of rows per day (events), ``chunk`` cuts each entity's rows by time (``date_trunc``
units) into chunks that are windowed independently. What a chunk needs from earlier rows is worked out from per-chunk
summaries (one total, or at most n-1 rows) and added to the chunk as extra leading rows before the window, then
removed; the input is read once for the summaries and once for the rows. Running totals take several nested units, from
coarse to fine, and carry totals from level to level, so no window holds more rows than a unit has parts. Totals of
fractions may differ from those of one window in their last bits, as they are added in another order; whole numbers and
trailing means of the same rows don't.

``spread`` needs no unit of time and holds whatever the keys are, a single instant with a third of all rows included: rows
are sorted once into ranges of even size, which are stored. A running total then adds to each range the totals of the
entity's ranges before it, and a trailing mean runs over blocks of BLOCK_ROWS rows by their place, each with the last n-1
rows of the block before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics.contract import ENTITY, TIME, TRAILING_ROWS
from panelytics.sources.sinks import write_panel
from panelytics.sources.workspace import workspace

#: Rows of an entity in one window of a spread trailing mean.
BLOCK_ROWS = 1 << 16
_ID, _PART, _SHIFT, _BEFORE, _PLACE, _BLOCK = "_row_id", "_part", "_shift", "_before", "_place", "_block"
_PART_BITS = 33  # monotonically_increasing_id: the bits above count partitions

_CHUNK, _OWN, _ADDED, _COARSE, _ABOVE = "_chunk", "_own_row", "_added", "_coarse", "_above"


def _ascending(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


def running_total(
    df: DataFrame,
    value: str,
    out: str,
    entity: Sequence[str] = (ENTITY,),
    order: Sequence[str] = (TIME,),
    chunk: str | Sequence[str] | None = None,
    spread: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` from the entity's first row to this one, missing counted as 0.

    ``order`` should identify a row within the entity; the first column is the time that ``chunk`` (a unit, or nested
    units from coarse to fine) truncates. ``spread`` stores the sorted rows when called.
    """
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    if spread:
        rows = _with_ranges(df.withColumn(_ADDED, amount), entity, order)
        in_range = Window.partitionBy(*entity, _PART).orderBy(_ID)
        here = F.sum(_ADDED).over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumn(out, here + F.col(_BEFORE)).drop(_ADDED, _ID, _PART, _SHIFT, _BEFORE)
    if chunk is None:
        so_far = Window.partitionBy(*entity).orderBy(*_ascending(order))
        return df.withColumn(out, F.sum(amount).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    units = [chunk] if isinstance(chunk, str) else list(chunk)
    rows = df.withColumns({_CHUNK: F.date_trunc(units[-1], order[0]), _ADDED: amount})
    carried = _carried(rows.groupBy(*entity, _CHUNK).agg(F.sum(_ADDED).alias(_ADDED)), entity, units)
    carried = carried.withColumn(_OWN, F.lit(False)).filter(F.col(_ADDED).isNotNull())
    so_far = (
        Window.partitionBy(*entity, _CHUNK)
        .orderBy(*_ascending([_OWN, *order]))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn(_OWN, F.lit(True))
        .unionByName(carried, allowMissingColumns=True)
        .withColumn(out, F.sum(_ADDED).over(so_far))
        .filter(F.col(_OWN))
        .drop(_CHUNK, _OWN, _ADDED)
    )


def _with_ranges(rows: DataFrame, entity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` sorted by entity and order into stored ranges of even size, each row with its range, a number that
    counts up within it, what to add to that for its place in the entity, and the sum of ``_added`` in earlier ranges."""
    keys = _ascending([*entity, *order])
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_ID, F.monotonically_increasing_id())
    folder = workspace(rows.sparkSession)
    dealt = write_panel(dealt, f"{folder}/rows").withColumn(_PART, F.shiftright(_ID, _PART_BITS))
    # a row for each range and entity that meet: together no more than both
    parts = dealt.groupBy(*entity, _PART).agg(
        F.min(_ID).alias("_first"), F.count(F.lit(1)).alias("_held"), F.sum(_ADDED).alias("_total")
    )
    earlier = Window.partitionBy(*entity).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, none: F.coalesce(F.sum(c).over(earlier), F.lit(none))
    known = parts.select(
        *entity, _PART, (so_far("_held", 0) - F.col("_first")).alias(_SHIFT), so_far("_total", 0.0).alias(_BEFORE)
    )
    known = write_panel(known, f"{folder}/ranges")
    same = [F.col(f"w.`{c}`").eqNullSafe(F.col(f"a.`{c}`")) for c in [*entity, _PART]]
    both = dealt.alias("w").join(known.alias("a"), reduce(and_, same))
    return both.select("w.*", f"a.{_SHIFT}", f"a.{_BEFORE}")


def _carried(totals: DataFrame, entity: Sequence[str], units: Sequence[str]) -> DataFrame:
    """Per chunk of the last unit, the sum of all earlier chunks of its entity; NULL for the first.

    Within a chunk of the next coarser unit the sum is a window over few rows; what lies before that chunk comes from
    the same question one level up.
    """
    before = lambda *parts: (
        Window.partitionBy(*entity, *parts).orderBy(*_ascending([_CHUNK])).rowsBetween(Window.unboundedPreceding, -1)
    )
    if len(units) == 1:
        return totals.withColumn(_ADDED, F.sum(_ADDED).over(before()))
    within = totals.withColumn(_COARSE, F.date_trunc(units[-2], _CHUNK))
    coarse = within.groupBy(*entity, F.col(_COARSE).alias(_CHUNK)).agg(F.sum(_ADDED).alias(_ADDED))
    above = _carried(coarse, entity, units[:-1]).filter(F.col(_ADDED).isNotNull())
    above = above.select(*entity, F.col(_CHUNK).alias(_COARSE), F.col(_ADDED).alias(_ABOVE))
    inside = within.withColumn(_ADDED, F.sum(_ADDED).over(before(_COARSE)))
    same = [F.col(f"w.`{c}`").eqNullSafe(F.col(f"a.`{c}`")) for c in [*entity, _COARSE]]
    both = inside.alias("w").join(above.alias("a"), reduce(and_, same), "left")
    total = F.when(
        F.coalesce(F.col(f"w.{_ADDED}"), F.col(f"a.{_ABOVE}")).isNotNull(),
        F.coalesce(F.col(f"w.{_ADDED}"), F.lit(0.0)) + F.coalesce(F.col(f"a.{_ABOVE}"), F.lit(0.0)),
    )
    return both.select(*[F.col(f"w.`{c}`").alias(c) for c in [*entity, _CHUNK]], total.alias(_ADDED))


def trailing_mean(
    df: DataFrame,
    values: Sequence[str],
    entity: Sequence[str] = (ENTITY,),
    order: Sequence[str] = (TIME,),
    n: int = TRAILING_ROWS,
    suffix: str | None = None,
    chunk: str | None = None,
    spread: bool = False,
) -> DataFrame:
    """Add, per value, the mean of the last ``n`` rows: NULL before row ``n`` or if any of the ``n`` is missing.

    The frame counts rows, not days. ``entity`` may be empty for a series that is already one row per day.
    """
    suffix = f"_{n}d" if suffix is None else suffix

    def add_means(rows: DataFrame, parts: Sequence[str], by: Sequence[str]) -> DataFrame:
        frame = Window.partitionBy(*parts).orderBy(*_ascending(by)).rowsBetween(1 - n, Window.currentRow)
        return rows.withColumns(
            {f"{v}{suffix}": F.when(F.count(v).over(frame) == n, F.avg(v).over(frame)) for v in values}
        )

    if spread and n > 1:
        rows = _with_ranges(df.withColumn(_ADDED, F.lit(0.0)), entity, order)
        placed = rows.withColumn(_PLACE, F.col(_ID) + F.col(_SHIFT)).drop(_ADDED, _ID, _PART, _SHIFT, _BEFORE)
        size = max(BLOCK_ROWS, n)
        own = F.floor(F.col(_PLACE) / size)
        goes_on = F.col(_PLACE) % size >= size - (n - 1)  # what the next block has to know
        blocks = F.explode(F.when(goes_on, F.array(own, own + 1)).otherwise(F.array(own)))
        means = add_means(placed.withColumn(_BLOCK, blocks), [*entity, _BLOCK], [_PLACE])
        return means.filter(F.col(_BLOCK) == own).drop(_BLOCK, _PLACE)

    if chunk is None or n == 1:
        return add_means(df, entity, order)

    rows = df.withColumn(_CHUNK, F.date_trunc(chunk, order[0]))
    from_end = Window.partitionBy(*entity, _CHUNK).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    needed = list(dict.fromkeys([*order, *values]))
    last_rows = (
        rows.select(*entity, _CHUNK, *needed, F.row_number().over(from_end).alias("_rn"))
        .filter(F.col("_rn") < n)
        .groupBy(*entity, _CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("_place"), *needed))).alias("_rows"))
    )
    # Every chunk holds at least one row, so n-1 earlier chunks always cover the n-1 rows wanted.
    earlier = Window.partitionBy(*entity).orderBy(*_ascending([_CHUNK])).rowsBetween(1 - n, -1)
    before = F.flatten(F.collect_list("_rows").over(earlier))
    leading = (
        last_rows.withColumn("_rows", before)
        .withColumn("_rows", F.slice("_rows", F.greatest(F.size("_rows") - (n - 2), F.lit(1)), n - 1))
        .select(*entity, _CHUNK, F.inline("_rows"), F.lit(False).alias(_OWN))
        .drop("_place")
    )
    joined = rows.withColumn(_OWN, F.lit(True)).unionByName(leading, allowMissingColumns=True)
    return add_means(joined, [*entity, _CHUNK], [_OWN, *order]).filter(F.col(_OWN)).drop(_CHUNK, _OWN)

"""The operators applied to the raw star-schema tables, where entities and rows grow with the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.contract import OUTCOMES_KEYWORD, OUTCOMES_TABLE, PROGRAM_TABLE
from panelytics.functions.measures import pct
from panelytics.functions.parsing import iso_text
from panelytics.operators.clean import clean_panel
from panelytics.operators.corr import corr_pairs
from panelytics.operators.joins import join_panels, joined_peaks
from panelytics.operators.profile import coverage, duplicate_keys, missingness, shape, table_profile
from panelytics.operators.rank import top_k
from panelytics.operators.rollup import entity_peaks, flow_totals
from panelytics.operators.windows import running_total, trailing_mean
from panelytics.plans.questions import matched_peaks, model_table, running_doses
from panelytics.plans.workflow import reports
from panelytics.sources.csv_panels import read_csv_panel
from panelytics.sources.sinks import export
from panelytics.sources.star_schema import cents, load_panels, read_table, supplier_days
from panelytics.sources.tables import register, run_sql, show_sql
from panelytics.sources.workspace import workspace

#: Nested units for events, of which an entity has unboundedly many a day.
EVENT_UNITS = ("day", "hour", "minute")


def round_columns(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in columns})


# --- sources, sinks, cleaning


_DATE_LAYOUTS = (
    "M/d/yyyy",
    "yyyy-MM-dd",
    "M/d/yy",
    "yyyyMMdd",
    "yyyy/MM/dd",
    "MM-dd-yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "d-MMM-yy",
    "MMMM d, yyyy",
    "M/d/yyyy H:mm",
)


def _mixed_layouts(day: str) -> F.Column:
    """The date as text in the layouts a raw file may mix, each read back without ambiguity."""
    return (
        F.when(F.month(day) % 2 == 1, F.date_format(day, "M/d/yyyy"))
        .when(F.dayofmonth(day) > 12, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def _as_raw_text(panel: DataFrame) -> DataFrame:
    """The panel as an untyped file would hold it: padded upper-case headers, mixed dates, NA for missing."""
    texts = []
    for field in panel.schema.fields:
        if isinstance(field.dataType, T.DateType):
            text = _mixed_layouts(field.name)
        else:
            text = F.coalesce(F.col(field.name).cast("string"), F.lit("NA"))
        texts.append(text.alias(f" {field.name.upper()} "))
    return panel.select(*texts)


_csv_folders: dict[tuple[str, str], str] = {}


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the outcomes panel as CSV, written on first use in an application like the panels themselves."""
    key = (spark.conf.get("spark.app.id"), sf_dir)
    if key not in _csv_folders:
        folder = workspace(spark)
        export(_as_raw_text(load_panels(spark, sf_dir).outcomes), f"{folder}/covid_Deaths.csv", "csv")
        _csv_folders[key] = folder
    return _csv_folders[key]


def csv_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes panel as a CSV file, found by keyword, read as text and cleaned."""
    return clean_panel(read_csv_panel(spark, _csv_folder(spark, sf_dir), OUTCOMES_KEYWORD))


_BY_LOCATION = f"""
SELECT location, count(*) AS days, max(total_cases) AS total_cases, sum(new_cases) AS new_cases
FROM {OUTCOMES_TABLE} WHERE continent IS NOT NULL GROUP BY location;
"""


def sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(load_panels(spark, sf_dir).outcomes, OUTCOMES_TABLE)
    return run_sql(spark, _BY_LOCATION)


def shown_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result of a SQL text whose first rows are printed; run once, as it is stored."""
    register(load_panels(spark, sf_dir).outcomes, OUTCOMES_TABLE)
    return show_sql(spark, "Cases by location", _BY_LOCATION, rows=5, store=workspace(spark))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(name: str) -> DataFrame:
        return shape(read_table(spark, sf_dir, name)).select(F.lit(name).alias("table"), "rows", "columns")

    return one("orders").unionByName(one("lineitem")).unionByName(one("events"))


def model_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modelling table, written as Parquet and read back. The export is the point of it, so it writes when called."""
    table = model_table(matched_peaks(*load_panels(spark, sf_dir), unique_keys=True))
    folder = workspace(spark)
    export(table, f"{folder}/model")
    return spark.read.schema(table.schema).parquet(f"{folder}/model")


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw text (mixed dates, unreadable numbers, missing-value tokens), cleaned."""
    orders = read_table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    price = F.col("o_totalprice").cast("string")
    # Texts that are no number: a token, a grouped number, a Java literal, words, blanks.
    unreadable = F.element_at(
        F.array(*[F.lit(text) for text in ("n/a", "1,234", "12.5f", "about 7", " ")]),
        (F.col("o_orderkey") % 25 / 5).cast("int") + 1,
    )
    raw = orders.select(
        F.col("o_orderkey").alias(" O_ORDERKEY"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("not given"))
        .otherwise(_mixed_layouts("day"))
        .alias("Date "),
        F.when(F.col("o_orderstatus") == "P", F.lit("NULL"))
        .when(F.col("o_orderkey") % 5 == 0, unreadable)
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit(" +"), price, F.lit(" ")))
        .otherwise(price)
        .alias("Price"),
        F.when(F.col("o_orderstatus") == "O", F.lit("#N/A")).otherwise(F.col("o_orderpriority")).alias("tests_units"),
    )
    return clean_panel(raw).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def order_date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose dates are texts in all layouts by turns, cleaned; every eleventh is no date, and its text is kept."""
    orders = read_table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    turn = F.col("o_orderkey") % (len(_DATE_LAYOUTS) + 1)
    texts = F.when(turn == len(_DATE_LAYOUTS), F.concat(F.lit("day "), F.col("o_orderkey")))
    for i, layout in enumerate(_DATE_LAYOUTS):
        texts = texts.when(turn == i, F.date_format("day", layout))
    raw = orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), texts.alias("DATE"))
    return clean_panel(raw, unread="unread").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def order_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day"))
    return days.agg(F.count(F.lit(1)).alias("orders")).select("day", iso_text("day").alias("text"), "orders")


# --- profiling


def _typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").withColumns(
        {"l_shipdate": F.col("l_shipdate").cast("date"), "l_returnflag": F.nullif("l_returnflag", F.lit("R"))}
    )


def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_profile(
        _typed_lines(spark, sf_dir),
        "lineitem",
        entity="l_suppkey",
        group="l_returnflag",
        time="l_shipdate",
        keys=["l_partkey", "l_shipdate"],
    )


def duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _typed_lines(spark, sf_dir).withColumn(
        "day", F.when(F.col("l_returnflag").isNotNull(), F.col("l_shipdate"))
    )
    return duplicate_keys(lines, ["l_suppkey", "day"], "duplicate_rows")


def coverage_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderpriority",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    return coverage(orders, code="o_custkey", entity="o_orderpriority", group="status")


def missing_supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missingness(supplier_days(spark, sf_dir))


# --- reductions, joins, windows, correlation


def peaks_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").withColumn("cents", cents("o_totalprice"))
    return entity_peaks(orders, ["o_totalprice", "o_orderdate"], means=["cents"], keys=["o_custkey"])


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", cents("o_totalprice").alias("cents"))
    return top_k(flow_totals(orders, ["cents"], ["o_custkey"]), "cents", 20, ties=["o_custkey"])


def joined_supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and returned quantities as two panels, joined on their key and summed up per supplier."""
    lines = read_table(spark, sf_dir, "lineitem")

    def panel(rows: F.Column, name: str) -> DataFrame:
        days = lines.filter(rows).groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("date"))
        return days.agg(F.sum("l_quantity").alias(name))

    both = join_panels(
        panel(F.col("l_returnflag") != "R", "kept"),
        panel(F.col("l_returnflag") == "R", "returned"),
        keys=["supplier", "date"],
    )
    return both.groupBy("supplier").agg(
        F.max("kept").alias("kept"),
        F.max("returned").alias("returned"),
        F.count(F.lit(1)).alias("days"),
        pct(F.sum("returned"), F.sum("kept")).alias("returned_pct"),
    )


def joined_line_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept against returned lines of the same part on the same day, keys repeating on both sides, per supplier."""
    lines = read_table(spark, sf_dir, "lineitem")
    keys = [F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("date")]
    kept = lines.filter(F.col("l_returnflag") != "R").select(*keys, F.col("l_suppkey").alias("supplier"), "l_quantity")
    returned = lines.filter(F.col("l_returnflag") == "R").select(
        *keys, cents("l_extendedprice").alias("cents"), F.col("l_linenumber").cast("double").alias("line")
    )
    return joined_peaks(
        kept, returned, ["l_quantity"], ["cents"], ["line"], keys=["part", "date"], groups=["supplier"]
    )


def running_quantity_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = supplier_days(spark, sf_dir).select("supplier", "date", "kept_quantity")
    return running_total(days, "kept_quantity", "running_quantity", ["supplier"], ["date"])


def running_doses_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running doses where every key of the outcomes panel occurs twice and joining all its rows is asked for."""
    outcomes, program = load_panels(spark, sf_dir)
    return running_doses(outcomes.unionByName(outcomes), program, repeated_keys="join")


def running_doses_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running doses where keys occur twice in one panel and three times in the other, from one row per key and side."""
    outcomes, program = load_panels(spark, sf_dir)
    thrice = program.unionByName(program).unionByName(program)
    return running_doses(outcomes.unionByName(outcomes), thrice, repeated_keys="fold")


_bucketed: dict[tuple[str, str], tuple[str, str]] = {}


def _bucketed_panels(spark: SparkSession, sf_dir: str, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """Both panels as tables bucketed by their key, saved on first use in an application."""
    key = (spark.conf.get("spark.app.id"), sf_dir)
    if key not in _bucketed:
        folder = workspace(spark)
        names = tuple(f"{table}_{folder.rsplit('-', 1)[-1]}" for table in (OUTCOMES_TABLE, PROGRAM_TABLE))
        for name, panel in zip(names, load_panels(spark, sf_dir)):
            register(panel, name, persistent=True, buckets=buckets, path=f"{folder}/{name}")
        _bucketed[key] = names
    outcomes, program = _bucketed[key]
    return spark.table(outcomes), spark.table(program)


def joined_bucketed_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched days per entity from saved tables whose join moves no row of either."""
    days = join_panels(*_bucketed_panels(spark, sf_dir))
    return days.groupBy("continent", "location").agg(
        F.count(F.lit(1)).alias("days"),
        F.max("total_cases").alias("total_cases"),
        F.max("people_vaccinated").alias("people_vaccinated"),
        F.sum("new_vaccinations").alias("new_vaccinations"),
    )


#: Reports over the two stored summaries, and what each ranks by.
_SHARED_REPORTS = {
    "top_cases": "total_cases",
    "top_infection_rate": "infected_population_pct",
    "top_deaths": "total_deaths",
    "top_coverage": "fully_vaccinated_pct",
    "bottom_coverage": "fully_vaccinated_pct",
    "top_positive_rate": "avg_positive_rate_pct",
}


def shared_summary_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rankings, of which three each read one summary that is worked out and stored once."""
    answers = reports(*load_panels(spark, sf_dir), store=workspace(spark), unique_keys=True)
    parts = [
        answers[name]().select(F.lit(name).alias("report"), "location", F.col(by).cast("double").alias("value"))
        for name, by in _SHARED_REPORTS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _events_in_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", "event_type", "ts", F.round(F.col("value") * 100).alias("cents"))


def running_value_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few entities with very many rows each: a window holds one minute of an event type, and totals are carried from
    minutes to hours to days."""
    events = _events_in_cents(spark, sf_dir)
    return running_total(events, "cents", "running_cents", ["event_type"], ["ts", "event_id"], chunk=EVENT_UNITS)


def trailing_quantity_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = supplier_days(spark, sf_dir).select("supplier", "date", "kept_quantity", "quantity")
    return trailing_mean(days, ["kept_quantity", "quantity"], ["supplier"], ["date"])


def trailing_value_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events_in_cents(spark, sf_dir)
    return trailing_mean(events, ["cents"], ["event_type"], ["ts", "event_id"], chunk=EVENT_UNITS[-1])


def running_value_over_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running totals of ``running_value_by_event_type`` over sorted ranges, whatever the spread of event times."""
    return running_total(
        _events_in_cents(spark, sf_dir), "cents", "running_cents", ["event_type"], ["ts", "event_id"], spread=True
    )


def trailing_value_over_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_mean(_events_in_cents(spark, sf_dir), ["cents"], ["event_type"], ["ts", "event_id"], spread=True)


def correlation_with_infinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line measures of which some are infinite and some NaN; only pairs of finite values count."""
    odd = F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("inf"))).when(F.col("l_orderkey") % 11 == 0, F.lit(float("-inf")))
    lines = read_table(spark, sf_dir, "lineitem").select(
        odd.when(F.col("l_orderkey") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_linenumber") == 2, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount",
    )
    return corr_pairs(lines, ["l_quantity", "l_extendedprice", "l_discount"])


def correlation_line_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return corr_pairs(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])

"""The two panels derived from an order-processing star schema.

Stands in for the real CSV panels, with the same columns. Nations are entities, regions are groups, orders give the
daily outcome flows and shipped line items the daily program flows. Like the real data it holds roll-up rows (per
region, without a group), missing daily values, and zero and missing denominators.

The raw tables are scanned once per session: the panels are written to the workspace and queries read those.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.sources.sinks import write_panel
from panelytics.sources.workspace import workspace


class Panels(NamedTuple):
    outcomes: DataFrame
    program: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _number(value: float | None) -> Column:
    return F.lit(value).cast("double")


def cents(column: str) -> Column:
    """Money as whole cents, so that sums do not depend on the order of addition."""
    return F.round(F.col(column) * 100).cast("bigint")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("nk"), F.col("r_name").alias("continent"), F.col("n_name").alias("location")
    )


def _iso_code(nation_key: Column) -> Column:
    return F.concat(F.lit("ISO_"), nation_key.cast("string"))


def _rollup_code() -> Column:
    return F.concat(F.lit("AGG_"), F.col("continent"))


def _cumulative() -> Window:
    # The input holds one row per nation and day.
    return Window.partitionBy("nk").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def build_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order flows per nation, plus one roll-up row per region and day."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    flows = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").alias("nk"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(
            F.max(F.col("o_orderpriority") != "1-URGENT").alias("ordinary"),
            F.sum(cents("o_totalprice")).alias("cents"),
            F.sum(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("new_deaths"),
        )
        .select(
            "nk",
            "date",
            F.when(F.col("ordinary"), F.floor(F.col("cents") / 100_000))
            .cast("double")
            .alias("new_cases"),
            "new_deaths",
        )
    )
    daily = flows.join(_nations(spark, sf_dir), "nk")
    population = F.when(F.col("nk") == 5, _number(0.0)).when(
        F.col("nk") != 6, F.col("nk") * F.col("nk") * 60000.0 + 300000.0
    )
    nations = (
        daily.withColumns(
            {
                "population": population,
                "total_cases": F.sum("new_cases").over(_cumulative()),
                "total_deaths": F.sum("new_deaths").over(_cumulative()),
            }
        )
        .withColumns(
            {
                f"{total}_per_million": F.col(total) * 1000000.0 / F.nullif("population", F.lit(0.0))
                for total in ("total_cases", "total_deaths")
            }
        )
        .withColumn("iso_code", _iso_code(F.col("nk")))
    )
    rollups = (
        daily.groupBy("continent", "date")
        .agg(F.sum("new_cases").alias("new_cases"), F.sum("new_deaths").alias("new_deaths"))
        .select(
            _rollup_code().alias("iso_code"),
            F.lit(None).cast("string").alias("continent"),
            F.col("continent").alias("location"),
            "date",
            "new_cases",
            "new_deaths",
            _number(50000000.0).alias("population"),
            _number(9000000.0).alias("total_cases"),
            _number(90000.0).alias("total_deaths"),
        )
    )
    columns = [
        "iso_code",
        "continent",
        "location",
        "date",
        "population",
        "new_cases",
        "new_deaths",
        "total_cases",
        "total_deaths",
        "total_cases_per_million",
        "total_deaths_per_million",
    ]
    return nations.select(*columns).unionByName(rollups, allowMissingColumns=True).select(*columns)


def build_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipment flows per supplier nation, plus one roll-up row per region and day."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    supplier = read_table(spark, sf_dir, "supplier")
    attributes = (
        supplier.groupBy(F.col("s_nationkey").alias("nk"))
        .agg(F.sum(cents("s_acctbal")).alias("cents"), F.count(F.lit(1)).alias("n"))
        .join(_nations(spark, sf_dir), "nk")
        .select(
            "nk",
            "continent",
            "location",
            F.floor(F.col("cents") / (F.col("n") * 100)).cast("double").alias("gdp_per_capita"),
            F.col("n").cast("double").alias("hospital_beds_per_thousand"),
        )
    )
    flows = (
        lineitem.join(supplier, lineitem.l_suppkey == supplier.s_suppkey)
        .groupBy(F.col("s_nationkey").alias("nk"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.max("l_linenumber").alias("last_line"),
            F.sum("l_quantity").alias("quantity"),
            F.max(F.when(F.col("l_returnflag") != "R", F.col("l_discount"))).alias("positive_rate"),
        )
        .select(
            "nk", "date", F.when(F.col("last_line") != 1, F.col("quantity")).alias("new_vaccinations"), "positive_rate"
        )
    )
    daily = flows.join(attributes, "nk")
    nk, doses = F.col("nk"), F.col("total_vaccinations")
    nations = daily.withColumn("total_vaccinations", F.sum("new_vaccinations").over(_cumulative())).select(
        _iso_code(nk).alias("iso_code"),
        "continent",
        "location",
        "date",
        "new_vaccinations",
        "positive_rate",
        "total_vaccinations",
        F.floor(doses * 0.6).cast("double").alias("people_vaccinated"),
        F.when(nk != 20, F.floor(doses * 0.5).cast("double")).alias("people_fully_vaccinated"),
        F.floor(doses * 0.1).cast("double").alias("total_boosters"),
        (doses / 8.0).alias("total_tests_per_thousand"),
        "gdp_per_capita",
        F.when(nk % 7 != 3, nk / 32.0).alias("human_development_index"),
        (20.0 + (nk * 7) % 25).alias("median_age"),
        "hospital_beds_per_thousand",
        (60.0 + (nk * 11) % 25).alias("life_expectancy"),
        F.when(nk % 2 == 0, F.lit("tests performed")).alias("tests_units"),
    )
    rollups = (
        daily.groupBy("continent", "date")
        .agg(F.sum("new_vaccinations").alias("new_vaccinations"))
        .select(
            _rollup_code().alias("iso_code"),
            F.lit(None).cast("string").alias("continent"),
            F.col("continent").alias("location"),
            "date",
            "new_vaccinations",
            _number(0.5).alias("positive_rate"),
            _number(8000000.0).alias("total_vaccinations"),
            _number(5000000.0).alias("people_vaccinated"),
            _number(4000000.0).alias("people_fully_vaccinated"),
            _number(500000.0).alias("total_boosters"),
        )
    )
    return nations.unionByName(rollups, allowMissingColumns=True)


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel whose number of entities grows with the data: quantity and revenue per supplier and ship date."""
    return (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("kept_quantity"),
            F.sum("l_quantity").alias("quantity"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


_stored: dict[tuple[str, str], list[tuple[str, T.StructType]]] = {}


def load_panels(spark: SparkSession, sf_dir: str, refresh: bool = False) -> Panels:
    """Both panels, built from the raw tables on first use in an application (or on ``refresh``) and read back from
    then on. The first use writes them to the workspace.
    """
    key = (spark.conf.get("spark.app.id"), sf_dir)
    if refresh or key not in _stored:
        panels = Panels(build_outcomes(spark, sf_dir), build_program(spark, sf_dir))
        folder = workspace(spark)
        for name, panel in panels._asdict().items():
            write_panel(panel, f"{folder}/{name}")
        _stored[key] = [(f"{folder}/{name}", panel.schema) for name, panel in panels._asdict().items()]
    return Panels(*[spark.read.schema(schema).parquet(path) for path, schema in _stored[key]])

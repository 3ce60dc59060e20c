"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Parts that a shuffle starts with unless told otherwise. Adaptive execution merges small parts but splits large ones
#: for joins only, so there have to be enough for the largest aggregation.
INITIAL_PARTITIONS = 4000


def build_session(
    app_name: str = "panelytics",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Get a session with UTC dates, ANSI arithmetic and adaptive execution.

    Expressions don't record where in Python they were built: that costs about a millisecond for each call, which for a
    query of some hundred expressions is longer than it runs.

    Shuffles start with ``shuffle_partitions`` parts (many by default, for large inputs), and adaptive execution merges
    small ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    else:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(INITIAL_PARTITIONS))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""CSV panels found by a keyword in the file name."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.operators.clean import exact_column

_RAW = "_corrupt_record"


def cell_count(row: Column) -> Column:
    """How many cells the text of a CSV row has: one walk over its pieces between commas, whatever they hold.

    A cell that begins with a quote goes on over commas until its quotes are even in number; in other cells quotes mean
    nothing.
    """

    def step(so_far: Column, piece: Column) -> Column:
        odd = (F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))) % 2 == 1
        inside = F.when(so_far["inside"], ~odd).otherwise(piece.startswith('"') & odd)
        return F.struct(inside.alias("inside"), (so_far["cells"] + F.when(inside, 0).otherwise(1)).alias("cells"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("cells"))
    unfinished = lambda x: x["cells"] + F.when(x["inside"], 1).otherwise(0)
    return F.aggregate(F.split(row, ",", -1), start, step, unfinished)


def find_csv(spark: SparkSession, root: str, keyword: str) -> list[str]:
    """Paths of all CSV files below ``root`` whose name contains ``keyword`` in any case, sorted.

    A folder named like a CSV file (as Spark writes one) counts as one such file. Lists, reads nothing.
    """
    below = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root).inputFiles()
    wanted = keyword.lower()
    matches = set()
    for path in map(unquote, below):
        parts = path.split("/")
        depth = next((i for i, part in enumerate(parts) if part.endswith(".csv") and wanted in part.lower()), None)
        if depth is not None:
            matches.add("/".join(parts[: depth + 1]))
    if not matches:
        raise FileNotFoundError(f"no CSV file with '{keyword}' in its name below {root}")
    return sorted(matches)


def read_csv_panel(
    spark: SparkSession,
    root: str,
    keyword: str,
    first_only: bool = False,
    all_matches: bool = False,
    multi_line: bool = False,
    checked: bool = True,
) -> DataFrame:
    """Raw text columns of the matching CSV file; type them with ``clean_panel``.

    A folder of part files counts as one file. Several matches are an error that lists them, unless ``first_only`` asks
    for the alphabetically first or ``all_matches`` for one panel of all (each with the same header). Cells are split as
    in RFC 4180 (doubled quotes). A row with fewer cells than the header is padded; reading one with more is an error.
    To see that, every row is split into all its cells; ``checked=False``, for files that one such reading has passed,
    splits off only the cells that a query asks for and would drop surplus ones. ``multi_line`` allows line breaks inside
    quotes but makes files unsplittable, so leave it off for large files.
    """
    paths = find_csv(spark, root, keyword)
    if first_only:
        paths = paths[:1]
    elif len(paths) > 1 and not all_matches:
        raise ValueError(f"several CSV files with '{keyword}' in their names: {paths}")
    options = {
        "header": True,
        "inferSchema": False,
        "enforceSchema": False,  # a file with other headers is an error, not shifted columns
        "mode": "PERMISSIVE",
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "recursiveFileLookup": True,
        "pathGlobFilter": "*.csv",
    }
    named = spark.read.csv(paths, **options).schema
    if not checked:
        return spark.read.schema(named).csv(paths, **options)
    # the reader keeps the text of rows whose number of cells differs from the header's, if it parses all cells
    with_raw = spark.read.schema(T.StructType([*named, T.StructField(_RAW, T.StringType())]))
    rows = with_raw.option("columnPruning", False).csv(paths, columnNameOfCorruptRecord=_RAW, **options)
    surplus = cell_count(F.col(_RAW)) > len(named)
    refused = F.raise_error(F.concat(F.lit(f"a row has more than {len(named)} cells: "), F.col(_RAW))).cast("boolean")
    # Spark refuses to read the kept text alone, so the filter names a column of the file as well
    always = F.coalesce(F.length(exact_column(named[0].name)), F.lit(0)) >= 0
    return rows.filter(F.when(F.col(_RAW).isNotNull() & surplus, refused).otherwise(always)).drop(_RAW)

"""Tables that several later steps read, written once to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark remove a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where that is unset and Spark runs inside this one process, as in tests, a temporary folder; on a cluster without
    the setting an error, because no executor would see another's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.conf.get("spark.app.id")
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="panelytics-llm-")
            atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
        folder = _own_folders[app]
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: its plan is cut, and lost executors only cost their current tasks.

    The shuffles behind it are no longer needed and go at once. The files are marked for removal when the session's JVM
    ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def free(table: DataFrame) -> None:
    """Remove the files of a ``stored`` table. All that was read from it has to be stored by then."""
    spark = table.sparkSession
    for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """A number for each row of documents that any pass over them finds again without storing the texts.

    Rows whose ids repeat or are null are told apart by their texts, by 64 bits; those equal in both share a key.
    """
    return F.xxhash64(doc_id, text)

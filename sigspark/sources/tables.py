"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: About the most bytes of a batch of rows that goes to Python.
BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset and all runs on this machine (tests), a local one is made
    and set. On a cluster executors couldn't see that one, so there the setting is needed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sigspark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _store(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in a folder of this session's own in the shared one, which goes when the session's JVM ends."""
    top = shared_dir(spark)
    key = f"{spark.sparkContext.applicationId} {top}"
    if key not in _FOLDERS:
        own = f"{top}/sigspark-{uuid.uuid4().hex}"
        store, path = _store(spark, own)
        store.mkdirs(path)
        store.deleteOnExit(path)
        _FOLDERS[key] = own
    return f"{_FOLDERS[key]}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and outlives executors."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, what))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() made and nothing reads any more."""
    for t in tables:
        store, path = _store(t.sparkSession, t.stored_at)
        store.delete(path, True)


def bounded(df: DataFrame) -> DataFrame:
    """df; batches of its session go to Python with about BATCH bytes. Spark alone counts rows, 10,000 of them, so a task's memory, in the
    JVM and in Python, would grow with the length of the texts. A limit that is set stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH))
    return df

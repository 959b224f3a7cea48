"""Intermediate tables in the shared folder: they cut lineage and survive lost executors.

A table lives as long as some DataFrame can reach it. Spark's relation of a written table is held by every plan
that reads it, so a weak reference to it tells when the last one has gone; the files are deleted then, at
the next ``written`` or ``tidy``, or when Python exits. So results that are alive together never delete each
other's tables, and long sessions don't fill the disk. An RDD made from such a table doesn't hold it: keep the
DataFrame as long as the RDD.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
_alive: dict[str, tuple[SparkSession, object]] = {}
_lock = threading.Lock()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the shared ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a local temporary folder serves a local master (tests,
    a laptop); on a cluster that is an error, since executors could not see each other's files. The folder is deleted
    when Python exits.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not top and not (master.split("[")[0] == "local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        top = top or "file://" + tempfile.mkdtemp(prefix="pointloom-")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/tables-{app}")
        _scratch[app] = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file in any store that Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _remove(spark: SparkSession, *paths: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended: nothing is left to delete with
        pass


def _sweep(spark: SparkSession) -> None:
    """Deletes the tables whose relation the JVM has collected."""
    with _lock:
        gone = [path for path, (owner, held) in _alive.items() if owner is spark and held.refersTo(None)]
        for path in gone:
            del _alive[path]
    _remove(spark, *gone)


def tidy(spark: SparkSession) -> None:
    """Deletes the tables that no DataFrame reaches any more, now."""
    for _ in range(2):  # what the first round lets go may have held the shuffles of the plan before
        spark.range(0).collect()  # in place of the plan that ran last, which Spark remembers
        gc.collect()  # JVM objects are let go by Python's collector
        for _ in range(2):
            spark.sparkContext._jvm.java.lang.System.gc()
            time.sleep(0.2)  # references are cleared beside the program
    _sweep(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    spark = df.sparkSession
    _sweep(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    relation = out._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    with _lock:
        _alive[path] = (spark, spark.sparkContext._jvm.java.lang.ref.WeakReference(relation))
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again, without waiting for the JVM."""
    for t in tables:
        path = t.__dict__.pop("_written_to", None)
        if path:
            with _lock:
                _alive.pop(path, None)
            _remove(t.sparkSession, path)

"""Session helpers shared by the library: shared-folder tables that cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder takes its place, but only on a local master.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = getattr(sc, "_marlstone_shared", None)
    if known is None:
        known = sc._marlstone_shared = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return known


class Tables(list):
    """Paths of tables that one query has written, within those of the query that it is part of."""

    def __init__(self, outer: Tables | None):
        super().__init__()
        self.outer = outer


#: Of the query that this thread is building; queries of other threads have their own.
_tables: ContextVar[Tables | None] = ContextVar("tables", default=None)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    The written table outlives lost executors, is computed once however often
    it is used, and gives the optimizer true sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = _tables.get()
    if own is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete the tables that ``materialize`` wrote for ``df``, which nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "marlstone-" in parent:
            _delete(df.sparkSession, parent)


def clear_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go now. They stay until the driver collects the garbage that refers to them,
    which with much memory it seldom does, while the executors' disks fill. What Python lets go of is let go of in the JVM
    a second later, or more on a busy machine, and listeners hold the last job's plan a while, so this is asked for three times.
    """
    gc.collect()
    for _ in range(3):
        time.sleep(1.1)
        spark.sparkContext._jvm.System.gc()


def mark(spark: SparkSession) -> Tables:
    """Begin a list of the tables that ``materialize`` writes from now on in this thread."""
    own = Tables(_tables.get())
    _tables.set(own)
    return own


def sweep(result: DataFrame, since: Tables) -> DataFrame:
    """End a list that ``mark`` began: delete its tables that ``result`` doesn't read, and leave the others to
    the list around it; returns ``result``."""
    spark = result.sparkSession
    read = {f.rsplit("/", 2)[1] for f in result.inputFiles()}
    for path in since:
        if path.rsplit("/", 1)[1] not in read:
            _delete(spark, path)
        elif since.outer is not None:
            since.outer.append(path)
    since.clear()
    _tables.set(since.outer)
    return result


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the landed parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="marlstone-"), "marlstone.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._marlstone_shipped = True

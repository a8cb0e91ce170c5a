"""Tables written to the folder that all executors share.

Cutting lineage with a written table keeps a job restartable when executors
are lost: a lost task rereads the table instead of recomputing its parents.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Where each table of materialise lies, as long as its DataFrame lives.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset a temporary folder if driver and executors are one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="barlight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/barlight/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    Rows of megabytes need row groups of few rows: a reader holds one group.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    options = {"parquet.block.size": 1 << 22, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16} if large_rows else {}
    with short_shuffles(spark):
        df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote; no plan that is still to run may read them."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(table))
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files that no live plan refers to; they would stay until its next collection."""
    spark.sparkContext._jvm.System.gc()


def return_memory(spark: SparkSession) -> bool:
    """Let the driver's JVM give freed native memory back to the system; False where it has no such command.

    Plans and their compilation are allocated by hundreds of short-lived
    threads, and glibc keeps for each of its arenas what these have freed.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    name = jvm.java.lang.Class.forName
    kinds = array(jvm.java.lang.Class, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = name(kind)
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # The server's class is not public, the interface's method is.
        name("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Tables in the folder that all executors share: lineage is cut there, and nothing is computed again."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Paths stored inside each open ``passing``.
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset in local mode."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        from tempfile import gettempdir

        root = f"file://{gettempdir()}/quire-checkpoints"
    return root.rstrip("/")


#: Whether the shuffle files of a query go when it ends, rather than when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has taken half of what it may.

    The plan of a stored table is garbage when the table is written, tens of MB a table, while little stays alive. Left to
    itself the heap grows to its limit before it is collected, and does not shrink again; a full collection hands memory back.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 2:
        spark._jvm.java.lang.System.gc()


def _hand_back(spark: SparkSession) -> bool:
    """Whether the driver's C library gave back what the JVM's compilers and codecs have freed.

    It keeps such memory for each thread otherwise, over 50 MB for each round of a safe pass. The command is there from Java
    17.0.9 on Linux; it goes by way of the interface, for the server's own class is closed to reflection.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, given)
    except Py4JJavaError:
        return False
    return True


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: a short plan, column pruning for its several readers,
    and nothing to compute again when an executor is lost. Its shuffle files go once it is written, its plan too.

    It is always joined by shuffles. Spark takes a table for as large as its files; ids and places pack to a sixtieth in
    them, so tables of millions of rows would be joined by broadcast: collected and hashed on the driver. The hint passes
    through whatever is selected, filtered or aggregated from the table; what is joined from such tables gets its own. Outside a join Spark warns that it has no use for it.
    """
    path = f"{shared_folder(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    with _shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    _tidy(df.sparkSession)
    _hand_back(df.sparkSession)
    if _open:
        _open[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
    out.__dict__["_quire_path"] = path
    return out


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing(spark: SparkSession):
    """What is stored inside goes at the end, but for the tables put on the list it gives: what later plans still read."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        own, stay = _open.pop(), {df.__dict__.get("_quire_path") for df in kept}
        drop(spark, [p for p in own if p not in stay])
        if _open:
            _open[-1].extend(p for p in own if p in stay)

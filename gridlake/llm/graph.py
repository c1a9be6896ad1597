"""Connected components by alternating large-star and small-star steps, as plain joins and aggregates."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import trim


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where none is named (tests on one machine), a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gridlake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, so that lost executors cost nothing."""
    shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


#: Bytes of an Arrow batch that a worker is given, where the session names no limit: executor and worker hold several each.
BATCH_BYTES = "4m"


@contextmanager
def small_batches(spark: SparkSession):
    """What runs meanwhile gives workers batches of about BATCH_BYTES; a session that has a limit of its own keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    if own is None:
        spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)


def table(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read back. Unlike a checkpoint, which carries on the product of the sizes of all that was joined
    before it, the table has the size of its files: for results that go from one round of joins to the next."""
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trim_driver(spark: SparkSession) -> str | None:
    """Give the driver's free memory outside its heap back to the system: Spark plans and broadcasts on hundreds of threads, whose
    memory the C library otherwise keeps for each of them. What the JVM says of it; None from one without that command."""
    trim()
    jvm, array, server = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array, "javax.management.MBeanServer"
    call = array(jvm.java.lang.Object, 4)
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    call[2], call[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    # by its interface, as Py4J may not look into the class behind it
    invoke = next(x for x in jvm.java.lang.Class.forName(server).getMethods() if x.getName() == "invoke")
    try:
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JJavaError:
        return None


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more; it does so after a collection of the
    driver's garbage, which may otherwise be half an hour away. Then free memory goes back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def apart(df: DataFrame, key: str, *aggregates) -> DataFrame:
    """df grouped by a LONG key under another form of it, so that a join on the key deals both of its sides anew: Spark
    can then split a hot key's rows among tasks, which it can't where one side arrives as the groups were dealt."""
    return df.groupBy(F.bitwise_not(key).alias("gridlake_not")).agg(*aggregates).withColumn(key, F.bitwise_not("gridlake_not")).drop("gridlake_not")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (u, v).

    Edges may repeat, point either way or lead back to their own node; no edges give no rows. Each round moves
    every edge once or twice; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    stars = table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/0")
    state = None
    for r in range(rounds):
        both = stars.union(stars.select("v", "u").toDF("u", "v"))
        low = apart(both, "u", F.min("v").alias("least")).select("u", F.least("least", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = apart(large, "u", F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        stars = table(small.where("u != v").distinct(), f"{folder}/{r + 1}")
        discard(spark, f"{folder}/{r}")
        release(spark)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    top = stars.select(F.col("v").alias("node")).distinct()
    return stars.toDF("node", "component").union(top.select("node", F.col("node").alias("component")))

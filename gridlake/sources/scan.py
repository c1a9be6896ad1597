"""Scans of managed tables. The manifest picks the files, so a range reads only the partitions it meets."""

from __future__ import annotations

from contextlib import contextmanager, nullcontext
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.plans.registry import Lake, Manifest, Part

#: How many tasks Spark lists folders in.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTING = Lock()


def read(lake: Lake, m: Manifest, parts: list[Part]) -> DataFrame:
    """All rows of these parts; no files make an empty frame of the table's schema."""
    return of_files(lake, m, (f for p in parts for f in p.files))


@contextmanager
def few_listings(spark: SparkSession):
    """Spark lists each of many folders in a task of its own, which takes longer to start than to list one: deal them over a few tasks a core."""
    with _LISTING:
        was = spark.conf.get(LISTING)
        spark.conf.set(LISTING, min(int(was), 4 * spark.sparkContext.defaultParallelism))
        try:
            yield
        finally:
            spark.conf.set(LISTING, was)


def of_files(lake: Lake, m: Manifest, files) -> DataFrame:
    """All rows of these files and folders, each read once."""
    files = dict.fromkeys(f if f.startswith(("/", "file:", "hdfs:", "viewfs:", "s3a:")) else f"{lake.root}/{f}" for f in files)
    if not files:
        return lake.spark.createDataFrame([], lake.schema(m))
    with few_listings(lake.spark) if len(files) > 32 else nullcontext():
        return lake.spark.read.schema(lake.schema(m)).parquet(*files)


def table(lake: Lake, m: Manifest | None = None) -> DataFrame:
    m = m or lake.manifest()
    return read(lake, m, m.attached)


def child(lake: Lake, name: str, m: Manifest | None = None) -> DataFrame:
    m = m or lake.manifest()
    p = m.part(name)
    return read(lake, m, [p]).where(m.config.grid.within_col(F.col(m.config.control), p.lo, p.hi))


def pruned(m: Manifest, lo=None, hi=None) -> list[Part]:
    """The attached parts that [lo, hi) meets."""
    return [p for p in m.attached if (hi is None or p.lo < hi) and (lo is None or p.hi > lo)]


def between(lake: Lake, lo=None, hi=None, m: Manifest | None = None) -> DataFrame:
    """Rows with lo <= control < hi: files from the manifest, and a filter on the raw column that Parquet can use."""
    m = m or lake.manifest()
    return read(lake, m, pruned(m, lo, hi)).where(m.config.grid.within_col(F.col(m.config.control), lo, hi))


def chunks(df: DataFrame, grid, control: str) -> list[tuple]:
    """(lo, hi) of the grid cells from the least to the largest key of a source, in order."""
    r = df.agg(F.min(control).alias("lo"), F.max(control).alias("hi")).first()
    if r["lo"] is None:
        return []
    lo, last = grid.floor(grid.decode(r["lo"])), grid.decode(r["hi"])
    return list(grid.cells(lo, grid.next(grid.floor(last))))


def partitions_view(lake: Lake, name: str) -> DataFrame:
    """A temporary view of the registry's parts, in order."""
    m = lake.manifest()
    kind = "bigint" if m.config.grid.kind == "id" else "timestamp_ntz"
    rows = [(m.config.table, p.child, p.lo, p.hi, p.attached, p.read_only, len(p.files)) for p in sorted(m.parts, key=lambda p: p.lo)]
    df = lake.spark.createDataFrame(rows, f"parent string, child string, lo {kind}, hi {kind}, attached boolean, read_only boolean, n_files int")
    df.createOrReplaceTempView(name)
    return df

"""Health and statistics of managed tables and of their keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.grid import MAX_MS, ntz, uuid_ms_col
from gridlake.plans import planner
from gridlake.plans.registry import Lake, Manifest

PLAUSIBLE_SINCE = dt.datetime(2015, 1, 1)
FAILURES = ("fail_retain_drop", "fail_retain_crossing", "fail_retain_detach")
LOG_SCHEMA = "id long, action string, lo string, hi string, method string, rows long, at timestamp_ntz"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 4), F.lit(0.0))


def check_uuidv7(df: DataFrame, control: str, as_of: dt.datetime, sample: int | None = 1000) -> DataFrame:
    """(sampled, plausible, fraction, oldest_ms, newest_ms) of the times in UUIDs: from 2015 to a day after as_of."""
    rows = df.select(uuid_ms_col(F.col(control)).alias("ms")).where("ms is not null")
    rows = rows if sample is None else rows.limit(sample)
    least, most = ((d - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1) for d in (PLAUSIBLE_SINCE, as_of + dt.timedelta(days=1)))
    ok = F.count_if(F.col("ms").between(least, most))
    return rows.agg(F.count("*").alias("sampled"), ok.alias("plausible"), _ratio(ok, F.count("*")).alias("fraction"), F.min("ms").alias("oldest_ms"), F.max("ms").alias("newest_ms"))


def check_time_monotonic(df: DataFrame, id_col: str, time_col: str, sample: int | None = 10_000) -> DataFrame:
    """(sampled, monotonic, fraction): of neighbours by id, how many do not go back in time. A sample is bounded, so one
    ordered window does; over whole tables (sample=None) ranges of ids are compared first and their ends then."""
    rows = df.select(F.col(id_col).alias("i"), F.col(time_col).alias("t"))
    if sample is not None:
        rows = rows.orderBy(F.rand(7)).limit(sample)
        before = F.lag("t").over(Window.orderBy("i"))
        pairs = rows.withColumn("p", before)
    else:
        parts = ranged(rows, "i")
        w = Window.partitionBy("part").orderBy("i")
        inner = parts.withColumn("p", F.lag("t").over(w)).withColumn("k", F.row_number().over(w))
        ends = parts.groupBy("part").agg(F.max_by("t", "i").alias("last"))  # a row for each range
        ends = ends.withColumn("p0", F.lag("last").over(Window.orderBy("part"))).withColumn("next", F.col("part"))
        ends = ends.select("next", F.lag("last").over(Window.orderBy("next")).alias("p0"))
        pairs = inner.join(ends, inner["part"] == ends["next"], "left").withColumn("p", F.when(F.col("k") == 1, F.col("p0")).otherwise(F.col("p")))
    seen, ok = F.count("p"), F.count_if(F.col("p").isNotNull() & (F.col("t") >= F.col("p")))
    return pairs.agg(seen.alias("sampled"), ok.alias("monotonic"), _ratio(ok, seen).alias("fraction"))


def observe_window(log: DataFrame, parent: str, since: dt.timedelta, as_of: dt.datetime) -> DataFrame:
    """What the log says of a span of time, always one row."""
    w = log.where(F.col("at") >= ntz(as_of - since))
    copied = F.coalesce(F.sum(F.when(F.col("action") == "regrain_copy", F.col("rows"))), F.lit(0)).cast("long")
    return w.agg(F.lit(parent).alias("parent_table"), F.min("at").alias("window_start"), F.max("at").alias("window_end"), F.timestamp_diff("SECOND", F.min("at"), F.max("at")).alias("duration_s"), F.count("*").alias("log_rows"), copied.alias("rows_copied"), F.count_if(F.col("action") == "regrain").alias("regrains"), F.count_if(F.col("action") == "retain_drop").alias("retains"))


def log_frame(lake: Lake, m: Manifest | None = None) -> DataFrame:
    m = m or lake.manifest()
    text = lambda v: None if v is None else str(v)
    rows = [(e["id"], e["action"], text(e["lo"]), text(e["hi"]), text(e["method"]), e["rows"], e["at"]) for e in m.log]
    return lake.spark.createDataFrame(rows, LOG_SCHEMA)


def status(lake: Lake, as_of: dt.datetime, front, missing: bool = False) -> dict:
    """The health of one table. With its data gone (missing) the backlog is unknown, not zero."""
    m = lake.manifest()
    c, a = m.config, m.attached
    coarse = sum(planner.is_coarse(c.grid, p) for p in a)
    last = max([e["id"] for e in m.log if e["action"] == "retain_drop"], default=0)
    boundary = None if missing else planner.horizon(c, front, as_of)
    return {
        "parent": c.table, "control_kind": c.grid.kind, "partition_step": str(c.grid.step), "obtain": c.obtain, "retain": None if c.retain is None else str(c.retain), "paused": c.paused,
        "n_partitions": len(a), "coarse_partitions": coarse, "inflight_partitions": len(m.parts) - len(a), "newest_bound": max((p.hi for p in a), default=None),
        "fks_suspended": sum(f.state == "suspended" for f in m.fks), "fks_unvalidated": sum(f.state == "restored" for f in m.fks), "history_unregrained": coarse > 0,
        "retain_drop_failures": sum(e["action"] in FAILURES and e["id"] > last for e in m.log), "retain_backlog": None if missing else len(planner.expired(m, boundary)), "retain_detaching": 0, "parent_missing": missing,
    }


def impact_report(lake: Lake, since: dt.timedelta, as_of: dt.datetime, latency: DataFrame | None) -> str:
    """A few lines about a span of time; latency: (at, ms) measured by the caller."""
    if latency is None:
        raise ValueError("a report needs measured latencies")
    w = observe_window(log_frame(lake), lake.manifest().config.table, since, as_of).first()
    p = percentiles(latency.where(F.col("at").between(ntz(as_of - since), ntz(as_of))), "ms").first()
    return f"{w['parent_table']}: {w['log_rows']} actions, {w['rows_copied']} rows copied, {w['regrains']} splits, {w['retains']} drops; latency ms p50 {p['p50']} p95 {p['p95']} p99 {p['p99']} max {p['max']}"


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by range, with the number of its range in ``part``. Written once where the session has a checkpoint folder: whatever
    reads it several times must see the same ranges, also after an executor is lost."""
    parts = df.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    return parts.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else parts


def nearest_rank(c: str, p: float) -> Column:
    """The element at floor(p * n) of the sorted values, or the last: no interpolation. For groups that fit in memory."""
    a = F.sort_array(F.collect_list(c))
    return F.get(a, F.least(F.floor(F.lit(p) * F.size(a)).cast("int"), F.size(a) - 1))


def percentiles(df: DataFrame, column: str, by: list[str] | None = None, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles and the maximum, exact at any size: values are counted first, ranks taken over the counts.

    The running count goes by range of values: each range's total first, then the place within the range."""
    by = by or []
    values = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    parts = ranged(values, *by, column)
    totals = parts.groupBy(*by, "part").agg(F.sum("c").alias("c"))  # a row for each range and group
    w = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    inner = F.sum("c").over(Window.partitionBy(*by, "part").orderBy(column)).alias("upto")
    ranked = parts.select(*by, "part", column, "c", inner).join(totals, [*by, "part"])
    end = F.col("before") + F.col("upto")
    out = [F.min(F.when(end > F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1), F.col(column))).alias(f"p{round(p * 100)}") for p in at]
    return ranked.groupBy(*by).agg(*out, F.max(column).alias("max"))


def throughput(df: DataFrame, at: str, ms: str) -> DataFrame:
    """(n, per_second, mean) over the span from the first event to the last."""
    span = F.timestamp_diff("MICROSECOND", F.min(at), F.max(at)) / 1_000_000
    return df.agg(F.count("*").alias("n"), (F.count("*") / F.nullif(span, F.lit(0))).alias("per_second"), F.avg(ms).alias("mean"))


__all__ = ["MAX_MS", "check_time_monotonic", "check_uuidv7", "impact_report", "log_frame", "nearest_rank", "observe_window", "percentiles", "status", "throughput"]

"""Moving a chunked time-series dataset under management: copy, catch up, cut over."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.grid import Grid
from gridlake.operators.changes import append_batch, delta_watermark, reconcile
from gridlake.operators.convert import manage
from gridlake.plans.registry import Lake, Manifest, Refused

#: MiB a second of a copy from cache and from disk.
CACHED_MIBPS, DISK_MIBPS = 40.0, 16.0


@dataclass(frozen=True)
class Source:
    """What is to be moved, and what is declared about it."""

    df: DataFrame
    control: str
    key: tuple[str, ...] = ()
    dimensions: int = 1
    continuous_aggregates: bool = False
    unvalidated_references: tuple[str, ...] = ()
    generated: tuple[tuple[str, str], ...] = ()


def preflight(s: Source, track: bool = False) -> None:
    """Refuse what can't be moved faithfully."""
    if s.control not in s.df.columns:
        raise Refused(f"there is no column {s.control}")
    if s.continuous_aggregates:
        raise Refused("the source has continuous aggregates")
    if s.dimensions != 1:
        raise Refused("the source has more than one partitioning dimension")
    if s.unvalidated_references:
        raise Refused(f"references are not validated: {', '.join(s.unvalidated_references)}")
    if track:
        if not s.key:
            raise Refused("changes can't be tracked without a key")
        if not s.df.where(" or ".join(f"`{k}` is null" for k in s.key)).isEmpty():
            raise Refused("changes can't be tracked with nulls in the key")


def estimate(n_bytes: int, mibps: float | None = None) -> dict:
    """(bytes, seconds) of a copy; a rate of 0 or less counts as the disk's."""
    rate = CACHED_MIBPS if mibps is None else mibps if mibps > 0 else DISK_MIBPS
    return {"bytes": n_bytes, "mibps": rate, "seconds": n_bytes / (rate * 1024 * 1024)}


def copy(s: Source, path: str, grid: Grid) -> DataFrame:
    """All rows, dealt by range of the control column and filed by cell, in one job; generated columns are left out."""
    out = s.df.drop(*(g for g, _ in s.generated)).withColumn("gridlake_cell", grid.floor_col(grid.native_col(F.col(s.control))))
    out.repartitionByRange(s.control).sortWithinPartitions(s.control).write.partitionBy("gridlake_cell").parquet(path)
    return s.df.sparkSession.read.parquet(path).drop("gridlake_cell")


def drain_delta_step(target: DataFrame, source: DataFrame, delta: DataFrame, key: list[str], control: str, batch: int) -> tuple[DataFrame, DataFrame, int]:
    """(target, delta that is left, keys reconciled) after the first ``batch`` changes. Where the key holds the control
    column, source is read only between the least and the largest of the keys' values."""
    last = delta_watermark(delta, F.lit(True), batch)
    if last is None:
        return target, delta, 0
    keys = delta.where(F.col("seq") <= last).select(*key).distinct()
    if control in key:
        r = keys.agg(F.min(control).alias("a"), F.max(control).alias("b")).first()
        source = source.where(F.col(control).between(F.lit(r["a"]), F.lit(r["b"])))
    return reconcile(target, source, keys, key), delta.where(F.col("seq") > last), keys.count()


def drain_delta(target: DataFrame, source: DataFrame, delta: DataFrame, key: list[str], control: str, batch: int, threshold: int = 0, max_steps: int = 100, best_effort: bool = False) -> tuple[DataFrame, DataFrame]:
    """Steps until no more than ``threshold`` changes are left."""
    for _ in range(max_steps):
        if delta.offset(threshold).isEmpty():
            return target, delta
        target, delta, _ = drain_delta_step(target, source, delta, key, control, batch)
    if not delta.offset(threshold).isEmpty() and not best_effort:
        raise Refused("the changes do not come to an end")
    return target, delta


def drain_appends_step(target: DataFrame, source: DataFrame, control: str, batch: int, mark) -> tuple[DataFrame, object]:
    """(target, watermark) with the next rows beyond the watermark, ties included; unchanged where there are none."""
    new = append_batch(source, control, mark, batch)
    top = new.agg(F.max(control)).first()[0]
    return (target, mark) if top is None else (target.unionByName(new.select(target.columns)), top)


def drain_appends(target: DataFrame, source: DataFrame, control: str, batch: int, mark, max_steps: int = 100) -> tuple[DataFrame, object]:
    for _ in range(max_steps):
        if source.where(F.col(control) > F.lit(mark)).isEmpty() if mark is not None else source.isEmpty():
            return target, mark
        target, mark = drain_appends_step(target, source, control, batch, mark)
    raise Refused("the rows do not come to an end")


def from_chunks(lake: Lake, s: Source, table: str, grid: Grid, as_of: dt.datetime, delta: DataFrame | None = None, **options) -> Manifest:
    """Copy, last catch-up, and management in one go. Without changes to catch up with, the copy's files are taken as they are."""
    preflight(s, delta is not None)
    folder = lake.folder()
    target = copy(s, f"{lake.root}/{folder}", grid)
    if delta is not None:
        target, _ = drain_delta(target, s.df.drop(*(g for g, _ in s.generated)), delta, list(s.key), s.control, 1 << 30)
    files = tuple(f"{folder}/{n}" for n in lake.store.names(folder) if n.startswith("gridlake_cell=")) if delta is None else ()
    return manage(lake, target, table, s.control, grid.step, as_of, grid.kind, grid.anchor, s.key, files=files or None, **options)

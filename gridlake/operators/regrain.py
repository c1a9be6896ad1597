"""Splitting a coarse partition on a finer grid, in steps that can stop anywhere and go on later."""

from __future__ import annotations

import datetime as dt
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.grid import Grid, literal
from gridlake.operators.changes import reconcile
from gridlake.plans import planner
from gridlake.plans.registry import Lake, Manifest, Part, Refused, replace
from gridlake.sources import scan

#: What tiles are filed by; no managed table has such a column.
TILE = "gridlake_tile"


def _grid(m: Manifest, step) -> Grid:
    return Grid(m.config.grid.kind, step or m.config.regrain_to or m.config.grid.step, m.config.grid.anchor)


def tiled(df: DataFrame, control: str, grid: Grid, lo, hi) -> DataFrame:
    """df with the lower bound of its tile of [lo, hi): the cell's, but not under lo."""
    v = grid.native_col(F.col(control))
    low = literal(lo)
    return df.where(grid.within_col(F.col(control), lo, hi)).withColumn(TILE, F.greatest(grid.floor_col(v), low))


def regrain_step(lake: Lake, child: str, as_of: dt.datetime, step=None, front=None) -> str:
    """One step of a split; its status: nokey, active, nosubdiv, prepared, copied:N, reconciled:N or swapped:K.

    prepared: the tiles are planned. copied: the next tiles of the source are written in one job, all of them, or as many as hold
    the regrain_batch rows that are configured (one at least); a split that breaks off goes on with the tile after them.
    reconciled: the tiles that hold keys changed since then are written anew, with those keys as the source has them now.
    swapped: the tiles replace the source.
    """
    m = lake.manifest()
    p, grid = m.part(child), _grid(m, step)
    if not p.attached:
        raise Refused(f"{child} is not attached")
    if not m.config.key:
        return "nokey"
    if m.staging and m.staging["child"] != child:
        raise Refused(f"{m.staging['child']} is being split")
    if m.staging is None:
        front = front if front is not None else planner.frontier(scan.table(lake, m), m.config.grid, m.config.control, as_of)
        if not planner.is_frozen(m.config.grid, p, front):
            return "active"
        boundary = planner.horizon(m.config, front, as_of)
        cells = planner.tiles(grid, p.lo, p.hi, boundary, m.config.archive is not None)
        if len(list(grid.cells(p.lo, p.hi))) < 2:
            return "nosubdiv"
        lake.publish(replace(m, staging={"child": child, "tiles": tuple(cells), "copied": 0, "held": (), "rows": 0}, delta=()))
        return "prepared"
    s = m.staging
    if s["copied"] < len(s["tiles"]):
        return _copy(lake, m, p, grid)
    if m.delta:
        return _reconciled(lake, m, p, grid)
    return _swap(lake, m, p, dict(s["held"]), as_of)


def _written(lake: Lake, rows: DataFrame, control: str, grid: Grid) -> tuple:
    """((lower bound, folder), ...) of tiled rows, one folder a tile that has any."""
    folder = lake.folder()
    rows.repartitionByRange(control).sortWithinPartitions(control).write.partitionBy(TILE).parquet(f"{lake.root}/{folder}")
    return tuple(_tile_folders(lake, folder, grid).items())


def _staged(lake: Lake, m: Manifest) -> DataFrame:
    return scan.of_files(lake, m, (f for _, f in m.staging["held"]))


def _copy(lake: Lake, m: Manifest, p: Part, grid: Grid) -> str:
    s, control, batch = m.staging, m.config.control, m.config.regrain_batch
    rest = s["tiles"][s["copied"] :]
    rows = tiled(scan.read(lake, m, [p]), control, grid, rest[0][0], rest[-1][1])
    if batch is not None:
        sizes = {r[TILE]: r["n"] for r in rows.groupBy(TILE).agg(F.count("*").alias("n")).collect()}  # a row for each tile
        total = list(accumulate(sizes.get(lo, 0) for lo, _ in rest))
        rest = rest[: next((k for k, n in enumerate(total) if n >= batch), len(rest)) + 1]
        rows = rows.where(grid.within_col(F.col(control), rest[0][0], rest[-1][1]))
    held = _written(lake, rows, control, grid)
    n = scan.of_files(lake, m, (f for _, f in held)).count()
    lake.publish(replace(m, staging=s | {"copied": s["copied"] + len(rest), "held": (*s["held"], *held), "rows": s["rows"] + n}))
    return f"copied:{n}"


def _reconciled(lake: Lake, m: Manifest, p: Part, grid: Grid) -> str:
    s, c, key = m.staging, m.config, list(m.config.key)
    lo, hi = s["tiles"][0][0], s["tiles"][-1][1]
    keys = lake.spark.read.parquet(*(f"{lake.root}/{d}" for d in m.delta)).distinct()
    source, staged = (tiled(df, c.control, grid, lo, hi) for df in (scan.read(lake, m, [p]), _staged(lake, m)))
    touched = source.join(keys, key, "left_semi").select(TILE).union(staged.join(keys, key, "left_semi").select(TILE)).distinct()
    tiles = {r[TILE] for r in touched.collect()}  # a row for each tile
    if tiles:
        some = F.broadcast(lake.spark.createDataFrame([(x,) for x in sorted(tiles)], f"{TILE} {source.schema[TILE].dataType.simpleString()}"))  # a bound for each tile, which the manifest holds too
        anew = _written(lake, reconcile(*(df.join(some, TILE, "left_semi").select(df.columns) for df in (staged, source)), keys, key), c.control, grid)
        s = s | {"held": (*(x for x in s["held"] if x[0] not in tiles), *anew)}
    n = keys.count()
    lake.publish(replace(m, staging=s, delta=()))
    return f"reconciled:{n}"


def _tile_folders(lake: Lake, folder: str, grid: Grid) -> dict:
    """Lower bound of a tile: its folder, as Spark has named it."""
    from urllib.parse import unquote

    out = {}
    for n in lake.store.names(folder):
        if n.startswith(f"{TILE}="):
            v = unquote(n[len(TILE) + 1 :])
            out[int(v) if grid.kind == "id" else dt.datetime.fromisoformat(v)] = f"{folder}/{n}"
    return out


def _swap(lake: Lake, m: Manifest, p: Part, held: dict, as_of: dt.datetime) -> str:
    c = m.config
    new = tuple(Part(c.grid.name(c.table, lo, hi), lo, hi, (held[lo],) if lo in held else (), created_at=as_of) for lo, hi in m.staging["tiles"])
    rows = m.staging["rows"]
    m2 = replace(m, parts=tuple(x for x in m.parts if x.child != p.child) + new, staging=None, delta=())
    m2 = m2.logged("regrain_copy", as_of, lo=p.lo, hi=p.hi, rows=rows).logged("regrain", as_of, lo=p.lo, hi=p.hi, rows=rows, method=f"{len(new)} parts")
    lake.publish(m2)
    return f"swapped:{len(new)}"


def regrain(lake: Lake, child: str, as_of: dt.datetime, step=None, front=None) -> int:
    """Split to the end; the number of new partitions."""
    while True:
        status = regrain_step(lake, child, as_of, step, front)
        if status in ("nokey", "active", "nosubdiv"):
            raise Refused(f"{child} can't be split: {status}")
        if status.startswith("swapped:"):
            return int(status[8:])


def regrain_history(lake: Lake, as_of: dt.datetime, step=None, front=None) -> int:
    """Split the oldest coarse and frozen partition; 0 without one."""
    m = lake.manifest()
    front = front if front is not None else planner.frontier(scan.table(lake, m), m.config.grid, m.config.control, as_of)
    p = planner.regrain_target(m, front)
    return regrain(lake, p.child, as_of, step, front) if p else 0


def cancel(lake: Lake) -> int:
    """Drop what is staged; the source is as it was."""
    m = lake.manifest()
    if m.staging is None:
        return 0
    folders = sorted({f.rsplit("/", 1)[0] for _, f in m.staging["held"]} | set(m.delta))
    lake.publish(replace(m, staging=None, delta=()))
    for f in folders:
        lake.store.delete(f)
    return len(folders)

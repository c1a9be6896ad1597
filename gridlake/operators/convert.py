"""Taking a table under management and letting it go again. No rows move: one coarse partition points at its files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.grid import Grid, Step
from gridlake.operators import observe
from gridlake.plans import planner
from gridlake.plans.registry import Config, ForeignKey, Lake, Manifest, Part, Refused, replace


def check_key(df: DataFrame, control: str, key: list[str]) -> None:
    """A key must hold the control column, be unique and have no nulls; so must the control column itself."""
    for c in {control, *key}:
        if c not in df.columns:
            raise Refused(f"there is no column {c}")
    if not df.where(F.col(control).isNull()).isEmpty():
        raise Refused(f"{control} has nulls")
    if not key:
        return
    if control not in key:
        raise Refused("the key does not hold the control column")
    if not df.where(" or ".join(f"`{k}` is null" for k in key)).isEmpty():
        raise Refused("the key has nulls")
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise Refused("the key is not unique")


def manage(lake: Lake, df: DataFrame, table: str, control: str, step: Step | int, as_of: dt.datetime, kind: str | None = None, anchor=None, key: tuple[str, ...] = (), obtain: int = 30, retain=None, headroom: int = 0, fks: tuple[ForeignKey, ...] = (), incoming_fks: str = "error", force_uuidv7: bool = False, files: tuple[str, ...] | None = None, paused: bool = True, **more) -> Manifest:
    """Put a dataset under management. With ``files`` (its Parquet paths) nothing is copied; else df is written once.

    Refused for: a managed folder, a wrong key type, nulls or repeats in the key, incoming references without
    incoming_fks='preserve', references not on the key, and UUIDs that are no times (unless forced) or too late.
    """
    if lake.managed:
        raise Refused(f"{lake.root} is already managed")
    if incoming_fks not in ("error", "preserve"):
        raise Refused("incoming_fks is 'error' or 'preserve'")
    kind = kind or ("id" if isinstance(step, int) else "uuidv7" if df.schema[control].dataType.typeName() == "string" else "time")
    grid = Grid(kind, step, anchor)
    if control not in df.columns:
        raise Refused(f"there is no column {control}")
    if own := [c for c in df.columns if c.lower().startswith("gridlake_")]:
        raise Refused(f"names that begin with gridlake_ are the library's own: {', '.join(own)}")
    grid.check_type(df.schema[control].dataType)
    check_key(df, control, list(key))
    if fks and incoming_fks == "error":
        raise Refused("other tables refer to this one")
    if any(set(f.referenced) != set(key) for f in fks):
        raise Refused("a reference is not on the key")
    if kind == "uuidv7":
        sane = observe.check_uuidv7(df, control, as_of).first()
        if sane["sampled"] and sane["fraction"] < 0.5 and not force_uuidv7:
            raise Refused(f"only {sane['fraction']} of the UUIDs are plausible times")
    least = df.agg(F.min(control)).first()[0]
    front = planner.frontier(df, grid, control, as_of)
    lo, hi = planner.monolith(grid, grid.decode(least), front, headroom)
    held = files if files is not None else lake.write(df)
    config = Config(table, control, grid, tuple(key), obtain, retain, paused=paused, **more)
    m = Manifest(config, df.schema.json(), (Part(grid.name(table, lo, hi), lo, hi, tuple(held), created_at=as_of),), fks=tuple(fks)).logged("transmute", as_of, lo=lo, hi=hi)
    m = lake.publish(m)
    return obtain_parts(lake, m, front, as_of)


def obtain_parts(lake: Lake, m: Manifest, front, as_of: dt.datetime) -> Manifest:
    """The forward grid: empty parts for the cells ahead that nothing covers."""
    cells = planner.obtain_cells(m.config.grid, front, m.config.obtain, list(m.parts))
    if not cells:
        return m
    new = tuple(Part(m.config.grid.name(m.config.table, lo, hi), lo, hi, created_at=as_of) for lo, hi in cells)
    m = replace(m, parts=m.parts + new)
    for p in new:
        m = m.logged("obtain", as_of, lo=p.lo, hi=p.hi)
    return lake.publish(m)


def unmanage(lake: Lake) -> DataFrame:
    """Back to a plain dataset; only while every row still lies in the first, coarse partition."""
    m = lake.manifest()
    if not m.attached:
        raise Refused("there is no partition")
    if any(p.files for p in m.attached[1:]):
        raise Refused("rows lie outside the first partition")
    from gridlake.sources import scan

    out = scan.table(lake, m)
    lake.uninstall()
    return out


def abort(lake: Lake) -> int:
    """Throw away what an unfinished split has staged; returns how many folders went."""
    from gridlake.operators.regrain import cancel

    return cancel(lake)


def configure(lake: Lake, **settings) -> Manifest:
    """Set any of the configuration's fields: paused, retain, archive, regrain_to, ..."""
    m = lake.manifest()
    unknown = set(settings) - set(m.config.__dataclass_fields__)
    if unknown:
        raise Refused(f"no such setting: {', '.join(sorted(unknown))}")
    return lake.publish(replace(m, config=replace(m.config, **settings)))

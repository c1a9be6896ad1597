"""Managed tables: immutable Parquet files and a manifest that says which of them make up which partition.

A manifest version is one JSON file, published under the next free number. One version is one consistent view, so
planning, moving data and swapping partitions need no locks: write files, then publish.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridlake.functions.grid import Grid, Step

from .store import Store


class Refused(ValueError):
    """The operation's conditions are not met; nothing has changed."""


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Part:
    """One partition [lo, hi) and the files that hold its rows."""

    child: str
    lo: object
    hi: object
    files: tuple[str, ...] = ()
    attached: bool = True
    read_only: bool = False
    created_at: dt.datetime | None = None


@dataclass(frozen=True)
class ForeignKey:
    """A declared reference of another table to this one, and where it stands."""

    name: str
    referencing: str
    columns: tuple[str, ...]
    referenced: tuple[str, ...]
    action: str = "restrict"
    state: str = "validated"  # suspended, restored, validated
    retry_after: dt.datetime | None = None


@dataclass(frozen=True)
class Config:
    """How a table is managed. retain: an amount of the key (int) or of time (Step); None keeps everything.
    regrain_batch: rows that a step of a split copies, rounded up to whole tiles; None copies all of them in one."""

    table: str
    control: str
    grid: Grid
    key: tuple[str, ...] = ()
    obtain: int = 30
    retain: object = None
    retain_batch: int | None = None
    regrain_batch: int | None = None
    regrain_to: object = None
    archive: str | None = None
    archive_byte_budget: int = 8 << 20
    archive_probe_sample: int = 1000
    paused: bool = True
    generated: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Manifest:
    config: Config
    schema: str
    parts: tuple[Part, ...] = ()
    log: tuple[dict, ...] = ()
    ledger: tuple[dict, ...] = ()
    fks: tuple[ForeignKey, ...] = ()
    staging: dict | None = None
    delta: tuple[str, ...] = ()
    version: int = 0

    @property
    def attached(self) -> list[Part]:
        return sorted((p for p in self.parts if p.attached), key=lambda p: p.lo)

    def part(self, child: str) -> Part:
        for p in self.parts:
            if p.child == child:
                return p
        raise Refused(f"{self.config.table} has no partition {child}")

    def covering(self, v) -> Part | None:
        return next((p for p in self.attached if p.lo <= v < p.hi), None)

    def logged(self, action: str, at: dt.datetime, **fields) -> Manifest:
        return self.logged_all([{"action": action, "at": at} | fields])

    def logged_all(self, entries: list[dict]) -> Manifest:
        """Many entries at once: the log is copied once."""
        empty = {"lo": None, "hi": None, "method": None, "rows": None}
        return replace(self, log=(*self.log, *({"id": len(self.log) + 1 + i, "action": e["action"], "at": e["at"]} | empty | e for i, e in enumerate(entries))))

    def checked(self) -> Manifest:
        """Attached partitions never overlap."""
        a = self.attached
        for x, y in zip(a, a[1:], strict=False):
            if y.lo < x.hi:
                raise Refused(f"{x.child} and {y.child} overlap")
        return self


def _plain(v):
    if isinstance(v, dt.datetime):
        return {"$t": v.isoformat()}
    if isinstance(v, Step):
        return {"$step": [v.months, v.micros]}
    if isinstance(v, Decimal):
        return {"$d": str(v)}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def _rich(v):
    if isinstance(v, dict):
        if "$t" in v:
            return dt.datetime.fromisoformat(v["$t"])
        if "$step" in v:
            return Step(*v["$step"])
        if "$d" in v:
            return Decimal(v["$d"])
        return {k: _rich(x) for k, x in v.items()}
    return tuple(_rich(x) for x in v) if isinstance(v, list) else v


def dumps(m: Manifest) -> str:
    c = m.config
    body = {f: getattr(c, f) for f in c.__dataclass_fields__ if f != "grid"} | {"kind": c.grid.kind, "step": c.grid.step, "anchor": c.grid.anchor}
    flat = lambda rows: [{f: getattr(r, f) for f in r.__dataclass_fields__} for r in rows]
    return json.dumps(_plain({"config": body, "schema": m.schema, "parts": flat(m.parts), "log": m.log, "ledger": m.ledger, "fks": flat(m.fks), "staging": m.staging, "delta": m.delta}))


def loads(text: str, version: int) -> Manifest:
    d = _rich(json.loads(text))
    c = dict(d["config"])
    grid = Grid(c.pop("kind"), c.pop("step"), c.pop("anchor"))
    return Manifest(Config(grid=grid, **c), d["schema"], tuple(Part(**p) for p in d["parts"]), d["log"], d["ledger"], tuple(ForeignKey(**f) for f in d["fks"]), d["staging"], d["delta"], version)


class Lake:
    """A folder that holds one managed table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.store.names("_manifest") if n.startswith("v") and n.endswith(".json"))

    @property
    def managed(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known:
            raise Refused(f"{self.root} is not managed")
        v = known[-1] if version is None else version
        return loads(self.store.read(f"_manifest/v{v:012d}.json"), v)

    def publish(self, m: Manifest) -> Manifest:
        """Make m the next version of the one it was read from."""
        new = replace(m.checked(), version=m.version + 1)
        if not self.store.create(f"_manifest/v{new.version:012d}.json", dumps(new)):
            raise Conflict(f"version {new.version} of {self.root} has been published by another writer")
        return new

    def folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> tuple[str, ...]:
        """Rows into a new folder, which nothing refers to until a manifest does."""
        name = self.folder()
        df.write.parquet(f"{self.root}/{name}")
        return (name,)

    def schema(self, m: Manifest) -> T.StructType:
        return T.StructType.fromJson(json.loads(m.schema))

    def uninstall(self) -> None:
        """Forget the table; its data files stay."""
        self.store.delete("_manifest")


__all__ = ["Config", "Conflict", "ForeignKey", "Lake", "Manifest", "Part", "Refused", "replace"]

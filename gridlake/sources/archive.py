"""Sinks for expired ranges: counting, NDJSON and Parquet; and the ledger of what has been archived."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.plans import planner
from gridlake.plans.registry import Lake, Manifest, Part, Refused, replace
from gridlake.plans.store import Store
from gridlake.sources import scan

#: Chunks that are written, or objects that get their names, at the same time.
AT_ONCE = 8
#: What rows of many chunks are filed by; no managed table has such a column.
CHUNK = "gridlake_chunk"


@dataclass(frozen=True)
class Archived:
    """What a strategy has done: it may cover less than it was asked to."""

    covered_hi: object
    rows: int | None
    key: str | None = None
    etag: str | None = None


#: Parquet types that an archive may hold, by Spark type.
PARQUET_TYPES = {T.IntegerType: "INT32", T.LongType: "INT64", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN", T.StringType: "BYTE_ARRAY", T.TimestampType: "INT64", T.TimestampNTZType: "INT64", T.DecimalType: "FIXED_LEN_BYTE_ARRAY"}


def check_types(schema: T.StructType) -> None:
    for f in schema:
        if type(f.dataType) not in PARQUET_TYPES:
            raise Refused(f"column {f.name}: {f.dataType.simpleString()} can't be archived as Parquet")


def ndjson_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """One line of JSON for each row, in order, nulls included."""
    return _lines(df.orderBy(*order))


def object_name(table: str, lo, hi, suffix: str) -> str:
    """Unlike digits alone, this keeps signs, fractions and the end apart."""
    clean = lambda v: v.strftime("%Y%m%dT%H%M%S%f") if isinstance(v, dt.datetime) else str(v).replace("-", "m")
    return f"{table}_{clean(lo)}_{clean(hi)}{suffix}"


def noop(lake: Lake, m: Manifest, p: Part, lo, hi) -> Archived:
    return Archived(hi, _rows(lake, m, p, lo, hi).count())


def _noop_many(lake: Lake, m: Manifest, chunks: list[Part]) -> list[Archived]:
    rows = {r[CHUNK]: r["n"] for r in _chunked(lake, m, chunks).groupBy(CHUNK).agg(F.count("*").alias("n")).collect()}  # a row for each chunk
    return [Archived(p.hi, rows.get(str(i), 0)) for i, p in enumerate(chunks)]


noop.many = _noop_many


def _rows(lake: Lake, m: Manifest, p: Part, lo, hi) -> DataFrame:
    return scan.read(lake, m, [p]).where(m.config.grid.within_col(F.col(m.config.control), lo, hi))


def _chunked(lake: Lake, m: Manifest, chunks: list[Part]) -> DataFrame:
    """The rows of all chunks (parts cut to what is left of them) with the chunk's number."""
    c = m.config
    numbered = [replace(p, child=str(i)) for i, p in enumerate(chunks)]
    return planner.route(scan.read(lake, m, chunks), c.control, planner.parts_frame(lake.spark, numbered, c.grid), c.grid, name=CHUNK)


def _order(m: Manifest) -> list[str]:
    return [m.config.control, *(k for k in m.config.key if k != m.config.control)]


def _lines(df: DataFrame, *more: str) -> DataFrame:
    """Rows as JSON, nulls included, with the columns ``more`` beside them."""
    return df.select(*more, F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in more)), {"ignoreNullFields": "false"}).alias("value"))


def _put_many(lake: Lake, m: Manifest, chunks: list[Part], prefix: str, suffix: str, write: Callable, read: Callable, lines: bool) -> list[Archived]:
    """All chunks in one job, each in a folder of its own that then gets the object's name; its parts are in the order of control and key."""
    out, draft, order = Store(lake.spark, prefix), f"_gridlake_{uuid.uuid4().hex}", _order(m)
    rows = _chunked(lake, m, chunks).repartitionByRange(*order).sortWithinPartitions(CHUNK, *order)
    write((_lines(rows, CHUNK) if lines else rows).write.partitionBy(CHUNK), f"{out.root}/{draft}/rows")
    held = {n.removeprefix(f"{CHUNK}=") for n in out.names(f"{draft}/rows") if n.startswith(f"{CHUNK}=")}
    count = {}
    if held:
        with scan.few_listings(lake.spark):
            there = read(lake.spark.read, f"{out.root}/{draft}/rows")
        count = {str(r[CHUNK]): r["n"] for r in there.groupBy(CHUNK).agg(F.count("*").alias("n")).collect()}  # a row for each chunk
    if len(held) < len(chunks):  # the object of a chunk without rows
        none = lake.spark.createDataFrame([], lake.schema(m))
        write((_lines(none) if lines else none).write, f"{out.root}/{draft}/none")

    def name_it(i: int) -> Archived:
        p = chunks[i]
        name = object_name(m.config.table, p.lo, p.hi, suffix)
        if str(i) in held:
            out.move(f"{draft}/rows/{CHUNK}={i}", name)
        else:
            out.copy(f"{draft}/none", name)
        return Archived(p.hi, count.get(str(i), 0), f"{prefix}/{name}")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(name_it, range(len(chunks))))
    out.delete(draft)
    return done


def to_ndjson(prefix: str, compress: bool = True) -> Callable:
    """Each chunk one folder of NDJSON parts, in the order of control and key across the parts."""
    codec = "gzip" if compress else "none"

    def strategy(lake: Lake, m: Manifest, p: Part, lo, hi) -> Archived:
        rows, name = _rows(lake, m, p, lo, hi), f"{prefix}/{object_name(m.config.table, lo, hi, '.ndjson')}"
        ndjson_lines(rows, _order(m)).write.mode("overwrite").text(name, compression=codec)
        return Archived(hi, lake.spark.read.text(name).count(), name)

    def many(lake: Lake, m: Manifest, chunks: list[Part]) -> list[Archived]:
        return _put_many(lake, m, chunks, prefix, ".ndjson", lambda w, at: w.text(at, compression=codec), lambda r, at: r.text(at), True)

    strategy.many = many
    return strategy


def to_parquet(prefix: str, compress: bool = True) -> Callable:
    """Each chunk one folder of Parquet parts in the order of control and key. Refused without a key or for odd types."""
    codec = "gzip" if compress else "none"

    def check(lake: Lake, m: Manifest) -> None:
        if not m.config.key:
            raise Refused(f"{m.config.table} has no key: the order of an archive would not be fixed")
        check_types(lake.schema(m))

    def strategy(lake: Lake, m: Manifest, p: Part, lo, hi) -> Archived:
        check(lake, m)
        name = f"{prefix}/{object_name(m.config.table, lo, hi, '.parquet')}"
        _rows(lake, m, p, lo, hi).orderBy(*_order(m)).write.mode("overwrite").parquet(name, compression=codec)
        return Archived(hi, lake.spark.read.parquet(name).count(), name)

    def many(lake: Lake, m: Manifest, chunks: list[Part]) -> list[Archived]:
        check(lake, m)
        return _put_many(lake, m, chunks, prefix, ".parquet", lambda w, at: w.parquet(at, compression=codec), lambda r, at: r.schema(lake.schema(m)).parquet(at), False)

    strategy.many = many
    return strategy


STRATEGIES: dict[str, Callable] = {"noop": noop}


def configure(lake: Lake, kind: str, prefix: str, compress: bool = True) -> Manifest:
    """Archive the table's expired ranges under prefix from now on; kind is ndjson or parquet."""
    make = {"ndjson": to_ndjson, "parquet": to_parquet}.get(kind)
    if make is None:
        raise Refused(f"no archive format {kind}")
    m = lake.manifest()
    name = f"{kind}:{prefix}:{'gzip' if compress else 'none'}"
    STRATEGIES[name] = make(prefix, compress)
    return lake.publish(replace(m, config=replace(m.config, archive=name)))


def unconfigure(lake: Lake) -> Manifest:
    """Archive nothing any more."""
    m = lake.manifest()
    return lake.publish(replace(m, config=replace(m.config, archive=None)))


def strategy_of(name: str) -> Callable:
    """A registered strategy, or one that its own name describes (another session has configured it)."""
    if name not in STRATEGIES and name.count(":") >= 2:
        kind, rest = name.split(":", 1)
        prefix, codec = rest.rsplit(":", 1)
        if kind in ("ndjson", "parquet"):
            STRATEGIES[name] = {"ndjson": to_ndjson, "parquet": to_parquet}[kind](prefix, codec == "gzip")
    if name not in STRATEGIES:
        raise Refused(f"no archive strategy {name}")
    return STRATEGIES[name]


def archive_step(lake: Lake, as_of: dt.datetime) -> int:
    """One chunk of every read-only partition that the ledger does not cover yet, oldest first; chunks done.

    What is left of a partition is one chunk where all of it fits the budget; one job finds that out for all partitions, and a strategy
    that has ``many`` takes all of those in one job, however many there are. Only larger ones are read in order, AT_ONCE at a time.
    A strategy that makes no progress leaves no ledger row, so that the same chunk is tried again."""
    m = lake.manifest()
    c = m.config
    if c.archive is None:
        return 0
    strategy, ends = strategy_of(c.archive), planner.archived_to(m)
    due = [replace(p, lo=planner.resume_at(m, p, ends)) for p in m.attached if p.read_only and not planner.covered(m, p, ends)]
    if not due:
        return 0
    rows = scan.read(lake, m, due)
    rows = planner.route(rows.withColumn("gridlake_bytes", planner.width_col(rows)), c.control, planner.parts_frame(lake.spark, due, c.grid), c.grid, name="gridlake_child")
    large = {r["gridlake_child"] for r in rows.groupBy("gridlake_child").agg(F.sum("gridlake_bytes").alias("b")).where(F.col("b") > c.archive_byte_budget).collect()}  # a row for each partition at most

    def one(p: Part):
        chunk = (p.lo, p.hi) if p.child not in large else planner.next_chunk(scan.read(lake, m, [p]), c.grid, c.control, p.lo, p.hi, c.archive_byte_budget, c.archive_probe_sample)
        return chunk, chunk and strategy(lake, m, p, *chunk)

    whole = [p for p in due if p.child not in large] if hasattr(strategy, "many") else []
    results = {p.child: ((p.lo, p.hi), r) for p, r in zip(whole, strategy.many(lake, m, whole) if whole else [], strict=True)}
    rest = [p for p in due if p.child not in results]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        results |= zip((p.child for p in rest), pool.map(one, rest), strict=True)
    took = [(p, *results[p.child]) for p in due]
    took = [(p, chunk, r) for p, chunk, r in took if r and r.covered_hi > chunk[0]]
    if took:
        m = replace(m, ledger=(*m.ledger, *({"lo": chunk[0], "hi": r.covered_hi, "child": p.child, "key": r.key, "etag": r.etag, "rows": r.rows, "at": as_of} for p, chunk, r in took)))
        lake.publish(m.logged_all([{"action": "archive", "at": as_of, "lo": chunk[0], "hi": r.covered_hi, "rows": r.rows} for _, chunk, r in took]))
    return len(took)

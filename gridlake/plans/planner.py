"""Plans over the registry: which partitions to make, drop, split or archive. Bounds only; no rows move here."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions.grid import Grid, Step, add_months, ntz

from .registry import Config, Manifest, Part, Refused


def obtain_cells(grid: Grid, frontier, count: int, parts: list[Part]) -> list[tuple]:
    """Cells 0 to count from the frontier's on that no attached part overlaps. A UUID grid ends where UUIDs do."""
    out, lo = [], grid.floor(frontier)
    for _ in range(count + 1):
        hi = grid.next(lo)
        try:
            grid.encode(hi)
        except ValueError:
            break
        if not any(p.attached and p.hi > lo and hi > p.lo for p in parts):
            out.append((lo, hi))
        lo = hi
    return out


def horizon(config: Config, frontier, as_of: dt.datetime):
    """The boundary below which partitions may go: from the frontier for ids, from the clock for times and UUIDs."""
    if config.retain is None:
        return None
    if config.grid.kind == "id":
        return config.grid.floor(frontier - config.retain)
    r: Step = config.retain
    return config.grid.floor(add_months(as_of, -r.months) if r.months else as_of - dt.timedelta(microseconds=r.micros))


def expired(m: Manifest, boundary, batch: int | None = None) -> list[Part]:
    """Attached parts that end at or before the boundary, oldest first."""
    out = [] if boundary is None else [p for p in m.attached if p.hi <= boundary]
    return out if batch is None else out[:batch]


def is_coarse(grid: Grid, p: Part) -> bool:
    return p.hi > grid.next(p.lo)


def is_frozen(grid: Grid, p: Part, frontier) -> bool:
    return p.hi <= grid.floor(frontier)


def tiles(grid: Grid, lo, hi, boundary=None, archived: bool = False) -> list[tuple]:
    """Sub-ranges of [lo, hi) on the grid, cut at both ends; aged ones are left out unless they can be archived."""
    return [t for t in grid.cells(lo, hi) if archived or boundary is None or t[1] > boundary]


def regrain_target(m: Manifest, frontier) -> Part | None:
    """The oldest attached part that is coarse and frozen."""
    return next((p for p in m.attached if is_coarse(m.config.grid, p) and is_frozen(m.config.grid, p, frontier)), None)


def monolith(grid: Grid, least, frontier, headroom: int = 0) -> tuple:
    """Bounds of one part around everything there is."""
    hi = grid.next(grid.next(grid.floor(frontier)), headroom) if headroom else grid.next(grid.floor(frontier))
    lo = grid.floor(least if least is not None else frontier)
    grid.encode(hi)
    return lo, hi


def width_col(df: DataFrame):
    """Bytes of a row: fixed sizes by type, and the bytes of strings and binaries."""
    size = F.lit(0)
    for f in df.schema:
        c, kind = F.col(f.name), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 4
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}.get(kind.simpleString(), 8)
    return size


def at_rank(keys: DataFrame, k: int, sort: int = 100_000, pivots: int = 10_000):
    """The k-th least of a column "c" without nulls, or the largest where there are fewer; exact, ties counted each.

    Two pivots from a sample enclose it, and one pass counts the rows before and between them; that goes on between the pivots until
    few enough to sort are left. The sample decides how many passes it takes, never the result."""
    c, n = F.col("c"), None
    lit = ntz if isinstance(keys.schema["c"].dataType, T.TimestampNTZType) else F.lit
    while True:
        if n is None:
            n = keys.count()
            k = min(k, n)
        if n <= sort or k < 1:
            return keys.orderBy("c").limit(k).agg(F.max("c")).first()[0]
        some = sorted(r["c"] for r in keys.sample(min(1.0, pivots / n), 7).limit(4 * pivots).collect())
        if not some:
            some = [keys.first()["c"]]
        at, room = k * len(some) // n, 1 + int(4 * len(some) ** 0.5) // 2
        a, b = (some[min(max(i, 0), len(some) - 1)] for i in (at - room, at + room))
        r = keys.agg(F.count_if(c < lit(a)).alias("under"), F.count_if(c == lit(a)).alias("a"), F.count_if((c > lit(a)) & (c < lit(b))).alias("mid"), F.count_if(c == lit(b)).alias("b")).first()
        upto = r["under"]
        if k <= upto:
            keys, n = keys.where(c < lit(a)), upto
        elif k <= upto + r["a"]:
            return a
        elif k <= (inner := upto + r["a"] + r["mid"]):
            keys, n, k = keys.where((c > lit(a)) & (c < lit(b))), r["mid"], k - upto - r["a"]
        elif a != b and k <= inner + r["b"]:
            return b
        else:
            keys, n, k = keys.where(c > lit(b)), n - inner - (r["b"] if a != b else 0), k - inner - (r["b"] if a != b else 0)


def next_chunk(rows: DataFrame, grid: Grid, control: str, lo, hi, budget: int, sample: int):
    """(lo, end) of the next archive chunk of [lo, hi): as many rows as fit the budget at the width of the first ones,
    with all rows of the last key value. A small ordered read, then the last key by its rank; None where lo has reached hi."""
    if lo >= hi:
        return None
    c = F.col(control)
    left = rows.where(grid.within_col(c, lo, hi))
    width = left.orderBy(c).limit(sample).select(width_col(rows).alias("w")).agg(F.avg("w")).first()[0]
    if width is None:
        return lo, hi
    count = max(1, int(budget // max(width, 1)))
    last = at_rank(left.select(c.alias("c")), count)
    after = left.where(c > F.lit(last)).agg(F.min(c)).first()[0]
    if after is None:
        return lo, hi
    end = grid.decode(after)
    if grid.kind == "uuidv7" and end <= lo:  # all within one millisecond, which a bound can't divide
        end = lo + dt.timedelta(milliseconds=1)
    return lo, min(end, hi)


def archived_to(m: Manifest) -> dict:
    """How far the ledger reaches in each part that it names."""
    out = {}
    for e in m.ledger:
        out[e["child"]] = max(out.get(e["child"], e["hi"]), e["hi"])
    return out


def covered(m: Manifest, p: Part, ends: dict | None = None) -> bool:
    """Whether the ledger reaches the part's end, or nothing needs archiving. ends: archived_to(m), for many parts."""
    if m.config.archive is None:
        return True
    end = (archived_to(m) if ends is None else ends).get(p.child)
    return end is not None and end >= p.hi


def resume_at(m: Manifest, p: Part, ends: dict | None = None):
    return max(p.lo, (archived_to(m) if ends is None else ends).get(p.child, p.lo))


def contained(parts: DataFrame) -> DataFrame:
    """Parts that are not attached and lie wholly inside an attached one: leftovers that nothing refers to."""
    a = parts.where("attached").select(F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    return parts.where("not attached").join(a, (F.col("lo") >= F.col("a_lo")) & (F.col("hi") <= F.col("a_hi")), "left_semi")


def ledger_gaps(ledger: DataFrame) -> DataFrame:
    """Entries (child, lo, hi) that do not begin where the entry before them ends."""
    before = F.lag("hi").over(Window.partitionBy("child").orderBy("lo"))
    return ledger.withColumn("before", before).where("before is not null and not (before <=> lo)")


def write_blocks(m: Manifest, boundary) -> Manifest:
    """Parts past the horizon become read-only; those that a looser policy brings back become writable."""
    return replace(m, parts=tuple(replace(p, read_only=boundary is not None and p.attached and p.hi <= boundary) for p in m.parts))


def parts_frame(spark, parts, grid: Grid) -> DataFrame:
    """(child, lo, hi) of parts, typed by the grid. Built from constants: as long as the registry, not the data."""
    kind = "bigint" if grid.kind == "id" else "timestamp_ntz"
    if not parts:
        return spark.createDataFrame([], f"child string, lo {kind}, hi {kind}")
    return spark.createDataFrame([(p.child, p.lo, p.hi) for p in parts], f"child string, lo {kind}, hi {kind}")


def route(df: DataFrame, control: str, parts: DataFrame, grid: Grid, how: str = "inner", name: str = "child") -> DataFrame:
    """df with the child that covers each row in the column ``name``, which df must not have. Both sides meet on the grid cell, so that this is an equi-join however
    many parts there are, and coarse and fine parts mix: a part stands once for each cell it touches."""
    spread = parts.select(F.col("child").alias(name), F.col("lo").alias("gridlake_lo"), F.col("hi").alias("gridlake_hi"), F.explode(cells_col(grid, F.col("lo"), F.col("hi"))).alias("gridlake_of"))
    v = grid.native_col(F.col(control))
    rows = df.withColumn("gridlake_v", v).withColumn("gridlake_cell", grid.floor_col(F.col("gridlake_v")))
    on = (F.col("gridlake_cell") == F.col("gridlake_of")) & (F.col("gridlake_v") >= F.col("gridlake_lo")) & (F.col("gridlake_v") < F.col("gridlake_hi"))
    return rows.join(spread, on, how).drop("gridlake_v", "gridlake_cell", "gridlake_of", "gridlake_lo", "gridlake_hi")


def cells_col(grid: Grid, lo, hi):
    """Array of the lower bounds of the cells that [lo, hi) touches."""
    first = grid.floor_col(lo)
    if grid.kind == "id":
        return F.sequence(first, hi - F.lit(1), F.lit(grid.step).cast("long"))
    step = F.make_interval(months=F.lit(grid.step.months)) if grid.step.months else F.make_dt_interval(secs=F.lit(grid.step.micros) / 1_000_000)
    return F.filter(F.sequence(first, hi, step), lambda x: x < hi)


def check_covered(v, m: Manifest) -> Part:
    p = m.covering(v)
    if p is None:
        raise Refused(f"no partition of {m.config.table} covers {v}")
    if p.read_only:
        raise Refused(f"{p.child} is past the retention horizon and takes no writes")
    return p


def frontier(rows: DataFrame, grid: Grid, control: str, as_of: dt.datetime):
    """The newest point: the clock for times, the largest key otherwise; the anchor or the clock where there is none."""
    if grid.kind == "time":
        return as_of
    top = rows.agg(F.max(control)).first()[0]
    return grid.decode(top) if top is not None else grid.anchor if grid.kind == "id" else as_of

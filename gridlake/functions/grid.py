"""Grid algebra: exact range-partition grids over timestamps, integers and time-ordered UUIDs.

Each rule comes twice: as a scalar for planning on the driver and as a Column for work on rows. Timestamps are naive
UTC on the driver and TIMESTAMP_NTZ in Spark, so no session time zone can move a boundary.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("time", "id", "uuidv7")
EPOCH = dt.datetime(1970, 1, 1)
DEFAULT_ANCHOR = {"time": dt.datetime(2000, 1, 1), "uuidv7": dt.datetime(2000, 1, 1), "id": 0}
MAX_MS = (1 << 48) - 1
_US = dt.timedelta(microseconds=1)
_ALLOWED = {"time": (T.TimestampType, T.TimestampNTZType, T.DateType), "id": (T.ShortType, T.IntegerType, T.LongType, T.DecimalType), "uuidv7": (T.StringType,)}


class GridError(ValueError):
    """A value or definition that no grid can take."""


@dataclass(frozen=True)
class Step:
    """A step in time: whole months, or a fixed duration in microseconds, not both."""

    months: int = 0
    micros: int = 0

    def __post_init__(self):
        if self.months and self.micros:
            raise GridError("a step is whole months or a fixed duration, not both")
        if self.months < 0 or self.micros < 0 or not (self.months or self.micros):
            raise GridError("a step has to be positive")

    @classmethod
    def of(cls, months: int = 0, **duration) -> Step:
        """Step.of(months=3), Step.of(days=7), Step.of(hours=1) ..."""
        return cls(months, dt.timedelta(**duration) // _US)


def ntz(value: dt.datetime) -> Column:
    return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")


def micros(value: dt.datetime) -> int:
    return (value - EPOCH) // _US


def micros_col(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz(EPOCH), c.cast("timestamp_ntz"))


def from_micros_col(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", c, ntz(EPOCH))


def uuid_of(value: dt.datetime) -> str:
    """The smallest UUID of that millisecond: 48 bits of time, the rest zero."""
    ms = micros(value) // 1000
    if not 0 <= ms <= MAX_MS:
        raise GridError("a UUID holds times from 0 to 2**48 - 1 milliseconds only")
    h = f"{ms:012x}" + "0" * 20
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def uuid_ms_col(c: Column) -> Column:
    """Milliseconds of a UUID's first 48 bits, as LONG: years over 9999 stay representable."""
    return F.conv(F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def uuid_of_col(c: Column) -> Column:
    us = micros_col(c)
    ms = F.call_function("div", us - F.pmod(us, F.lit(1000)), F.lit(1000))
    ok = (ms >= 0) & (ms <= F.lit(MAX_MS))
    h = F.when(c.isNull(), F.lit(None)).when(ok, F.lower(F.lpad(F.hex(ms), 12, "0"))).otherwise(F.raise_error(F.lit("a UUID holds times from 0 to 2**48 - 1 milliseconds only")))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-0000-0000-000000000000"))


@dataclass(frozen=True)
class Grid:
    """A grid over one kind of key. step: Step for time and uuidv7, a positive int for id."""

    kind: str
    step: Step | int
    anchor: dt.datetime | int | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise GridError(f"unknown kind {self.kind!r}")
        if (self.kind == "id") != isinstance(self.step, int):
            raise GridError("an id grid has an integer step, any other a Step")
        if self.kind == "id" and self.step <= 0:
            raise GridError("a step has to be positive")
        if self.anchor is None:
            object.__setattr__(self, "anchor", DEFAULT_ANCHOR[self.kind])

    # ---- scalars ------------------------------------------------------------------------------------------------

    def floor(self, v):
        """The lower bound of the cell that holds v. Month steps count from the anchor's month."""
        if self.kind == "id":
            return (int(v) - self.anchor) // self.step * self.step + self.anchor
        if self.step.months:
            k = (v.year - self.anchor.year) * 12 + v.month - self.anchor.month
            return add_months(self.anchor.replace(day=1, hour=0, minute=0, second=0, microsecond=0), k // self.step.months * self.step.months)
        return self.anchor + (v - self.anchor) // _US // self.step.micros * self.step.micros * _US

    def next(self, lo, cells: int = 1):
        if self.kind == "id":
            return lo + self.step * cells
        if self.step.months:
            return add_months(lo, self.step.months * cells)
        return lo + self.step.micros * cells * _US

    def cells(self, lo, hi):
        """(lo, hi) of the cells that cover [lo, hi), the outer ones cut to it."""
        at = self.floor(lo)
        while at < hi:
            end = self.next(at)
            yield max(at, lo), min(end, hi)
            at = end

    def encode(self, v):
        """Grid value to column value."""
        return uuid_of(v) if self.kind == "uuidv7" else v

    def decode(self, x):
        """Column value to grid value; None stays None."""
        if x is None:
            return None
        if self.kind == "uuidv7":
            return EPOCH + int(x.replace("-", "")[:12], 16) * 1000 * _US
        if self.kind == "id":
            return int(x)
        return x if isinstance(x, dt.datetime) else dt.datetime(x.year, x.month, x.day)

    def _format(self) -> tuple[str, str]:
        s = self.step
        for months, us, py, sql in ((12, 0, "%Y", "yyyy"), (1, 0, "%Y_%m", "yyyy_MM"), (0, 86_400_000_000, "%Y_%m_%d", "yyyy_MM_dd"), (0, 3_600_000_000, "%Y_%m_%d_%H", "yyyy_MM_dd_HH")):
            if (months and s.months and s.months % months == 0) or (us and s.micros and s.micros % us == 0):
                return py, sql
        return "%Y_%m_%d_%H%M", "yyyy_MM_dd_HHmm"

    def label(self, v) -> str:
        return f"{v:019d}" if self.kind == "id" else v.strftime(self._format()[0])

    def name(self, table: str, lo, hi=None) -> str:
        """A child's label; one wider than a cell says where it ends. Identity is (lo, hi), never this."""
        wide = hi is not None and hi != self.next(lo)
        return f"{table}_p{self.label(lo)}" + (f"_to_{self.label(hi)}" if wide else "")

    # ---- columns ------------------------------------------------------------------------------------------------

    def native_col(self, c: Column) -> Column:
        """Column value to grid value: LONG or DECIMAL, or TIMESTAMP_NTZ."""
        if self.kind == "uuidv7":
            return F.timestamp_add("MILLISECOND", uuid_ms_col(c), ntz(EPOCH))
        return c if self.kind == "id" else c.cast("timestamp_ntz")

    def floor_col(self, v: Column) -> Column:
        """Of grid values. Whole numbers throughout, so large ids lose nothing."""
        if self.kind == "id":
            return v - F.pmod(v - F.lit(self.anchor), F.lit(self.step))
        if self.step.months:
            first = self.anchor.date().replace(day=1)
            k = (F.year(v) - first.year) * 12 + F.month(v) - first.month
            return F.add_months(F.lit(first), (k - F.pmod(k, F.lit(self.step.months))).cast("int")).cast("timestamp_ntz")
        since = micros_col(v) - F.lit(micros(self.anchor))
        return from_micros_col(micros_col(v) - F.pmod(since, F.lit(self.step.micros)))

    def next_col(self, lo: Column) -> Column:
        if self.kind == "id":
            return lo + F.lit(self.step)
        if self.step.months:
            return F.add_months(lo.cast("date"), self.step.months).cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", F.lit(self.step.micros), lo)

    def encode_col(self, v: Column) -> Column:
        return uuid_of_col(v) if self.kind == "uuidv7" else v

    def label_col(self, v: Column) -> Column:
        return F.lpad(v.cast("string"), 19, "0") if self.kind == "id" else F.date_format(v, self._format()[1])

    def name_col(self, table: str, lo: Column, hi: Column | None = None) -> Column:
        fine = F.concat(F.lit(f"{table}_p"), self.label_col(lo))
        return fine if hi is None else F.when(hi == self.next_col(lo), fine).otherwise(F.concat(fine, F.lit("_to_"), self.label_col(hi)))

    def within_col(self, c: Column, lo=None, hi=None) -> Column:
        """lo <= column < hi on the raw column, so that the scan can push it down."""
        lit = (lambda v: F.lit(self.encode(v))) if self.kind != "time" else ntz
        out = F.lit(True)
        if lo is not None:
            out = c >= lit(lo)
        if hi is not None:
            out = out & (c < lit(hi)) if lo is not None else c < lit(hi)
        return out

    def check_type(self, kind: T.DataType) -> None:
        """Refuse a column that can't be this grid's key."""
        if self.kind == "id" and isinstance(kind, (T.FloatType, T.DoubleType)):
            raise GridError("floating-point numbers can't be a partition key: bounds would not be exact")
        if not isinstance(kind, _ALLOWED[self.kind]) or isinstance(kind, T.DecimalType) and kind.scale:
            raise GridError(f"a column of type {kind.simpleString()} can't be a key of kind {self.kind}")


def add_months(v: dt.datetime, months: int) -> dt.datetime:
    k = v.year * 12 + v.month - 1 + months
    year, month = divmod(k, 12)
    last = (dt.date(year + month // 11, (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return v.replace(year=year, month=month + 1, day=min(v.day, last))


def literal(v) -> Column:
    """A grid value as a Column."""
    return ntz(v) if isinstance(v, dt.datetime) else F.lit(int(v) if isinstance(v, Decimal) else v)

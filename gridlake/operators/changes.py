"""Changes by key: copy without repeats, reconcile, upsert, delete. Joins only; a source's current row always wins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.plans import planner
from gridlake.plans.registry import Lake, Manifest, Refused, replace
from gridlake.sources import scan

#: What rows are filed by; no managed table has such a column.
CHILD = "gridlake_child"


def copy_missing(source: DataFrame, target: DataFrame, key: list[str], control: str | None = None, after=None, batch: int | None = None) -> DataFrame:
    """Rows of source whose key target has not, beyond a watermark, the first ``batch`` of them by control."""
    rows = source if after is None else source.where(F.col(control) >= F.lit(after))
    rows = rows.join(target.select(*key), key, "left_anti").select(source.columns)
    return rows if batch is None else rows.orderBy(control, *[k for k in key if k != control]).limit(batch)


def reconcile(target: DataFrame, source: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """target with the given keys as source has them now: gone where it has none. In any order, any number of times."""
    k = keys.select(*key).distinct()
    return target.join(k, key, "left_anti").select(target.columns).unionByName(source.join(k, key, "left_semi").select(target.columns))


def require_unique(rows: DataFrame, key: list[str]) -> None:
    """Refuse rows of which two have the same key: neither is the one to keep. latest() picks one by an order."""
    if not rows.groupBy(*key).agg(F.count("*").alias("gridlake_n")).where("gridlake_n > 1").isEmpty():
        raise Refused("two of the rows have the same key")


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """target with rows put in the place of those with their keys; refused where rows repeat a key."""
    require_unique(rows, key)
    return target.join(rows.select(*key), key, "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in order: a partial aggregate, no sort of the rows."""
    rest = [c for c in rows.columns if c not in key]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return top.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(rows.columns)


def delta_watermark(delta: DataFrame, where, batch: int):
    """The sequence number that ends the first batch of matching changes; None without any."""
    return delta.where(where).orderBy("seq").limit(batch).agg(F.max("seq").alias("seq")).first()["seq"]


def delta_purge(delta: DataFrame, inside) -> DataFrame:
    """Changes whose key lies in the range; the rest can't concern it."""
    return delta.where(inside)


def append_batch(source: DataFrame, control: str, after, batch: int) -> DataFrame:
    """Rows beyond the watermark up to the batch's last value, that value's ties included."""
    left = source if after is None else source.where(F.col(control) > F.lit(after))
    last = left.select(F.col(control).alias("c")).orderBy("c").limit(batch).agg(F.max("c").alias("last"))
    return left.join(F.broadcast(last), F.col(control) <= F.col("last")).drop("last")  # one row is broadcast


def with_generated(df: DataFrame, generated) -> DataFrame:
    """Generated columns worked out anew from the others."""
    for name, expression in generated:
        df = df.withColumn(name, F.expr(expression))
    return df


def rowset_equal(a: DataFrame, b: DataFrame, bag: bool = True) -> bool:
    """Whether two frames hold the same rows, as bags or as sets."""
    b = b.select(a.columns)
    less = (lambda x, y: x.exceptAll(y)) if bag else (lambda x, y: x.subtract(y))
    return less(a, b).isEmpty() and less(b, a).isEmpty()


def require_key(m: Manifest) -> list[str]:
    if not m.config.key:
        raise Refused(f"{m.config.table} has no key")
    return list(m.config.key)


def apply_changes(lake: Lake, upserts: DataFrame | None = None, deletes: DataFrame | None = None, as_of: dt.datetime | None = None) -> Manifest:
    """Upsert and delete by key, in one new version of the partitions touched.

    Refused where a row has no partition, its partition takes no writes, a key is null, or two rows have the same key. Keys that change while
    their partition is being split are recorded, so that the split takes them up.
    """
    m = lake.manifest()
    c, key = m.config, require_key(m)
    rows = with_generated(upserts, c.generated).select([f.name for f in lake.schema(m)]) if upserts is not None else lake.spark.createDataFrame([], lake.schema(m))
    gone = (deletes.select(*key) if deletes is not None else rows.select(*key).limit(0)).unionByName(rows.select(*key)).distinct()
    if not gone.where(" or ".join(f"`{k}` is null" for k in key)).isEmpty():
        raise Refused("a key can't be null")
    require_unique(rows, key)
    parts = planner.parts_frame(lake.spark, m.attached, c.grid)
    routed = planner.route(rows, c.control, parts, c.grid, "left", CHILD)
    if not routed.where(f"{CHILD} is null").isEmpty():
        raise Refused(f"no partition of {c.table} covers some of the rows")
    # a key may have moved between partitions: where the key holds the control column it names its partition
    if c.control in key:
        touched = [r[CHILD] for r in planner.route(gone, c.control, parts, c.grid, name=CHILD).select(CHILD).distinct().collect()]
    else:
        touched = [p.child for p in m.attached]
    old = [m.part(x) for x in touched]
    for p in old:
        if p.read_only:
            raise Refused(f"{p.child} is past the retention horizon and takes no writes")
    kept = scan.read(lake, m, old).join(gone, key, "left_anti").select(rows.columns)
    new = planner.route(kept.unionByName(rows), c.control, parts, c.grid, name=CHILD)
    folder = lake.folder()
    new.repartitionByRange(CHILD, c.control).write.partitionBy(CHILD).parquet(f"{lake.root}/{folder}")
    held = set(lake.store.names(folder))
    files = {x: ((f"{folder}/{CHILD}={x}",) if f"{CHILD}={x}" in held else ()) for x in touched}
    m2 = replace(m, parts=tuple(replace(p, files=files[p.child]) if p.child in files else p for p in m.parts))
    if m.staging and m.staging["child"] in files:
        d = lake.folder()
        gone.write.parquet(f"{lake.root}/{d}")
        m2 = replace(m2, delta=(*m2.delta, d))
    return lake.publish(m2)


def newest(df: DataFrame, by: str, order: str, count: int) -> DataFrame:
    """The last ``count`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return df.withColumn("gridlake_rank", rank).where(F.col("gridlake_rank") <= count).drop("gridlake_rank")

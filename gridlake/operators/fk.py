"""References across partition drops: orphans, keys that a doomed range still owes, and what happens to their rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.plans.registry import Lake, Manifest, Refused, replace

#: How long a failed validation waits before the next try.
BACKOFF = dt.timedelta(minutes=5)


def _renamed(referenced: DataFrame, pk: list[str]) -> DataFrame:
    return referenced.select(*(F.col(c).alias(f"gridlake_{i}") for i, c in enumerate(pk))).distinct()


def orphans(referencing: DataFrame, referenced: DataFrame, fk: list[str], pk: list[str]) -> DataFrame:
    """Rows whose whole reference is set and met by no row; a reference with a null in it counts as met."""
    p = _renamed(referenced, pk)
    on = [F.col(c) == F.col(f"gridlake_{i}") for i, c in enumerate(fk)]
    return referencing.where(" and ".join(f"`{c}` is not null" for c in fk)).join(p, on, "left_anti")


def crossing_keys(referencing: DataFrame, doomed: DataFrame, fk: list[str], pk: list[str]) -> DataFrame:
    """Keys of a doomed range that rows still refer to, each once, under the names of pk."""
    keys = referencing.select(*(F.col(c).alias(p) for c, p in zip(fk, pk, strict=True))).dropna().distinct()
    return doomed.select(*pk).distinct().join(keys, pk, "left_semi")


def act(referencing: DataFrame, keys: DataFrame, fk: list[str], pk: list[str], action: str, default=None) -> DataFrame:
    """The referencing table once the keys are gone: cascade, set null, set default; restrict refuses where any row refers."""
    k = keys.select(*(F.col(p).alias(f"gridlake_{i}") for i, p in enumerate(pk)))
    on = [F.col(c) == F.col(f"gridlake_{i}") for i, c in enumerate(fk)]
    if action == "cascade":
        return referencing.join(k, on, "left_anti")
    if action == "restrict":
        if not referencing.join(k, on, "left_semi").isEmpty():
            raise Refused("rows still refer to these keys")
        return referencing
    if action not in ("set null", "set default"):
        raise Refused(f"no such action: {action}")
    hit = referencing.join(k.withColumn("gridlake_hit", F.lit(True)), on, "left")
    for c in fk:
        new = F.lit(default if action == "set default" else None).cast(referencing.schema[c].dataType)
        hit = hit.withColumn(c, F.when(F.col("gridlake_hit"), new).otherwise(F.col(c)))
    return hit.select(referencing.columns)


def orphan_counts(lake: Lake, referenced: DataFrame, tables: dict[str, DataFrame], m: Manifest | None = None) -> DataFrame:
    """(referencing_table, constraint_name, orphan_rows) of the references that are restored but not validated."""
    m, out = m or lake.manifest(), None
    for f in m.fks:
        if f.state != "restored":
            continue
        n = orphans(tables[f.referencing], referenced, list(f.columns), list(f.referenced)).agg(F.count("*").alias("orphan_rows"))
        row = n.select(F.lit(f.referencing).alias("referencing_table"), F.lit(f.name).alias("constraint_name"), "orphan_rows")
        out = row if out is None else out.unionAll(row)
    return out if out is not None else lake.spark.createDataFrame([], "referencing_table string, constraint_name string, orphan_rows long")


def suspend(lake: Lake, as_of: dt.datetime) -> int:
    """Stop enforcing all references to the table; how many there were."""
    m = lake.manifest()
    live = [f for f in m.fks if f.state != "suspended"]
    if live:
        lake.publish(replace(m, fks=tuple(replace(f, state="suspended") for f in m.fks)).logged("suspend_fk", as_of, rows=len(live)))
    return len(live)


def restore(lake: Lake, as_of: dt.datetime) -> int:
    """Take up suspended references for new rows; old ones are validated later."""
    m = lake.manifest()
    some = [f for f in m.fks if f.state == "suspended"]
    if some:
        lake.publish(replace(m, fks=tuple(replace(f, state="restored") if f.state == "suspended" else f for f in m.fks)).logged("restore_fk", as_of, rows=len(some)))
    return len(some)


def validate(lake: Lake, referenced: DataFrame, tables: dict[str, DataFrame], as_of: dt.datetime, respect_backoff: bool = True) -> int:
    """Validate restored references whose rows all find their key; one that has orphans waits BACKOFF."""
    m, done, fks = lake.manifest(), 0, []
    for f in m.fks:
        if f.state == "restored" and not (respect_backoff and f.retry_after and f.retry_after > as_of):
            if orphans(tables[f.referencing], referenced, list(f.columns), list(f.referenced)).isEmpty():
                f, done = replace(f, state="validated", retry_after=None), done + 1
            else:
                f = replace(f, retry_after=as_of + BACKOFF)
                m = m.logged("fail_validate_fk", as_of, method=f.name)
        fks.append(f)
    if tuple(fks) != m.fks:
        lake.publish(replace(m, fks=tuple(fks)))
    return done

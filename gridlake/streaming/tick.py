"""The maintenance tick, and streaming front ends for changes and appends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridlake.operators import changes, convert, fk, regrain, retain
from gridlake.plans import planner
from gridlake.plans.registry import Conflict, Lake, Refused
from gridlake.sources import archive, scan


def tick(lake: Lake, as_of: dt.datetime, tables: dict[str, DataFrame] | None = None) -> str:
    """One round: obtain, block writes, archive, drop, split one step, restore and validate references.

    The order matters: what is archived has been closed to writes, what is dropped has been archived. A step that fails is
    logged as skip_... and the next one goes on; each step publishes its own version.
    """
    m = lake.manifest()
    if m.config.paused:
        return "paused"
    front = planner.frontier(scan.table(lake, m), m.config.grid, m.config.control, as_of)
    boundary = planner.horizon(m.config, front, as_of)
    done, notes = {}, []

    def obtain():
        return len(convert.obtain_parts(lake, m := lake.manifest(), front, as_of).parts) - len(m.parts)

    def block():
        new = planner.write_blocks(m := lake.manifest(), boundary)
        if new != m:
            lake.publish(new)
        return sum(p.read_only for p in new.parts)

    def split():
        m = lake.manifest()
        p = planner.regrain_target(m, front)
        name = m.staging["child"] if m.staging else p.child if p and m.config.regrain_to is not None else None
        return regrain.regrain_step(lake, name, as_of, None, front) if name else "none"

    def validated():
        return fk.validate(lake, scan.table(lake), tables or {}, as_of) if tables else 0

    steps = (("obtained", "skip_obtain", obtain), ("blocked", "skip_write_block", block), ("archived", "skip_archive", lambda: archive.archive_step(lake, as_of)), ("dropped", "skip_retain", lambda: retain.retain(lake, as_of, front, tables)), ("regrain", "skip_regrain", split), ("restored_fk", "skip_restore_fk", lambda: fk.restore(lake, as_of)), ("validated_fk", "skip_validate_fk", validated))
    for name, skip, step in steps:
        try:
            done[name] = step()
        except (Refused, Conflict, ValueError) as e:
            lake.publish(lake.manifest().logged(skip, as_of, method=str(e)[:200]))
            done[name] = 0
            notes.append(skip)
    return " ".join([f"{k}={v}" for k, v in done.items() if k not in ("blocked", "validated_fk")] + notes)


def tick_all(lakes: list[Lake], as_of: dt.datetime) -> dict[str, str]:
    """A tick for each table; one that fails does not hold up the others."""
    out = {}
    for lake in lakes:
        try:
            out[lake.root] = tick(lake, as_of)
        except (Refused, Conflict) as e:
            out[lake.root] = f"failed: {e}"
    return out


def schedule(spark, lakes: list[Lake], seconds: int, checkpoint: str) -> StreamingQuery:
    """A tick every so many seconds, driven by a rate stream; stop the query to end it."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda df, epoch: tick_all(lakes, dt.datetime.now(dt.UTC).replace(tzinfo=None))
    return clock.writeStream.foreachBatch(run).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()


def stream_changes(lake: Lake, changed: DataFrame, checkpoint: str, key: list[str], op: str = "op") -> StreamingQuery:
    """Apply a stream of rows with an operation, 'upsert' or 'delete', and a column seq; in each batch the last
    change of a key counts. Applying a batch twice changes nothing, so a restart is safe."""

    def apply(batch: DataFrame, epoch: int) -> None:
        last = changes.latest(batch, key, ["seq"])
        up, gone = last.where(f"{op} = 'upsert'").drop(op, "seq"), last.where(f"{op} = 'delete'").select(*key)
        if not last.isEmpty():
            changes.apply_changes(lake, up, gone)

    return changed.writeStream.foreachBatch(apply).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def stream_appends(appended: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of rows to a folder: the checkpoint is the high-water mark."""
    return appended.writeStream.format("parquet").trigger(availableNow=True).option("path", path).option("checkpointLocation", checkpoint).start()

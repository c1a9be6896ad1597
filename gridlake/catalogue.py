"""Queries over the driver's tables, one or more for each operator, each with its DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import predicates, text
from gridlake.functions.grid import Grid, Step, uuid_ms_col
from gridlake.operators import changes, convert, fk, migrate, observe, regrain, retain
from gridlake.plans import planner
from gridlake.plans.registry import Config, ForeignKey, Lake, Manifest, Part, Refused
from gridlake.sources import archive, generate, scan
from gridlake.streaming import tick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = dt.datetime(2024, 2, 15)
WEEK, MONTH, QUARTER = Grid("time", Step.of(days=7)), Grid("time", Step(1)), Grid("time", Step(3))


def query(oracle: str | None = None):
    """Register a function under its name, with its SQL if it has any."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fresh_lake(spark) -> Lake:
    """A lake in the session's shared folder; a temporary one where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return Lake(spark, f"{top}/gridlake-{uuid.uuid4().hex}")


def events_lake(spark, sf, step=1000, retain=None, coarse=True) -> Lake:
    lake = fresh_lake(spark)
    e = table(spark, sf, "events")
    convert.manage(lake, e, "events", "event_id", step, AS_OF, key=("event_id",), obtain=2, retain=retain, files=(f"{sf}/events.parquet",))
    return lake


# ---- grid algebra ---------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2000-01-01') AS lo, count(*) AS n FROM events GROUP BY 1")
def q01_fixed_grid_counts(spark, sf):
    return table(spark, sf, "events").groupBy(WEEK.floor_col(F.col("ts")).alias("lo")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT (year(o_orderdate) - 2000) * 12 + month(o_orderdate) - 1 AS k FROM orders)
SELECT (DATE '2000-01-01' + to_months((floor(k / 3.0) * 3)::INT))::TIMESTAMP AS lo, count(*) AS n FROM k GROUP BY 1""")
def q02_month_grid_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(QUARTER.floor_col(F.col("o_orderdate")).alias("lo")).agg(F.count("*").alias("n"))


@query("""SELECT (floor((l_orderkey - 7) / 1000.0) * 1000 + 7)::BIGINT AS lo, (floor((l_orderkey - 7) / 1000.0) * 1000 + 1007)::BIGINT AS hi,
count(*) AS n FROM lineitem GROUP BY 1, 2""")
def q03_id_grid_bounds(spark, sf):
    g = Grid("id", 1000, 7)
    lo = g.floor_col(F.col("l_orderkey"))
    return table(spark, sf, "lineitem").groupBy(lo.alias("lo"), g.next_col(lo).alias("hi")).agg(F.count("*").alias("n"))


UUID = "substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-0000-0000-000000000000'"


@query(f"SELECT event_id, {UUID} AS u FROM (SELECT event_id, lpad(printf('%x', epoch_us(ts) // 1000), 12, '0') AS x FROM events)")
def q04_uuid_encode(spark, sf):
    g = Grid("uuidv7", Step.of(days=1))
    return table(spark, sf, "events").select("event_id", g.encode_col(F.col("ts")).alias("u"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events UNION ALL SELECT -1, 281474976710655")
def q05_uuid_decode(spark, sf):
    g = Grid("uuidv7", Step.of(days=1))
    e = table(spark, sf, "events").select("event_id", uuid_ms_col(g.encode_col(F.col("ts"))).alias("ms"))
    return e.unionAll(spark.range(1).select(F.lit(-1).cast("long"), uuid_ms_col(F.lit("ffffffff-ffff-7fff-bfff-ffffffffffff"))))


@query("SELECT 'orders_p' || strftime(o_orderdate, '%Y_%m') AS label, count(*) AS n FROM orders GROUP BY 1")
def q06_fine_labels(spark, sf):
    lo = MONTH.floor_col(F.col("o_orderdate"))
    return table(spark, sf, "orders").groupBy(MONTH.name_col("orders", lo).alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT 'lineitem_p' || lpad(lo::VARCHAR, 19, '0') || CASE WHEN w > 1 THEN '_to_' || lpad((lo + w * 1000)::VARCHAR, 19, '0') ELSE '' END AS label
FROM (SELECT (l_orderkey // 1000 * 1000)::BIGINT AS lo, 1 + l_linenumber % 2 AS w FROM lineitem)""")
def q07_coarse_labels(spark, sf):
    g = Grid("id", 1000)
    lo = g.floor_col(F.col("l_orderkey"))
    return table(spark, sf, "lineitem").select(g.name_col("lineitem", lo, lo + (1 + F.col("l_linenumber") % 2) * 1000).alias("label")).distinct()


@query("""SELECT 'events' AS name, min(event_id) // 1000 * 1000 AS lo, max(event_id) // 1000 * 1000 + 1000 AS hi, max(event_id) AS frontier FROM events
UNION ALL SELECT 'orders', min(o_orderkey) // 1000 * 1000, max(o_orderkey) // 1000 * 1000 + 1000, max(o_orderkey) FROM orders""")
def q08_monolith_bounds(spark, sf):
    g, out = Grid("id", 1000), None
    for name, c in (("events", "event_id"), ("orders", "o_orderkey")):
        one = table(spark, sf, name).agg(F.min(c).alias("a"), F.max(c).alias("b"))
        one = one.select(F.lit(name).alias("name"), g.floor_col(F.col("a")).alias("lo"), g.next_col(g.floor_col(F.col("b"))).alias("hi"), F.col("b").alias("frontier"))
        out = one if out is None else out.unionAll(one)
    return out


# ---- planning -------------------------------------------------------------------------------------------------------


@query("""SELECT lo, lo + 500 AS hi FROM (SELECT (floor(m / 500.0)::BIGINT + i) * 500 AS lo FROM (SELECT max(event_id) - 1500 AS m FROM events), range(0, 9) t(i))
WHERE NOT EXISTS (SELECT 1 FROM (SELECT max(event_id) // 1000 * 1000 + 1000 AS b FROM events) WHERE b > lo AND lo + 500 > 0)""")
def q09_obtain_plan(spark, sf):
    top = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    g = Grid("id", 500)
    cells = planner.obtain_cells(g, top - 1500, 8, [Part("coarse", 0, Grid("id", 1000).next(Grid("id", 1000).floor(top)))])
    return spark.createDataFrame(cells, "lo bigint, hi bigint")


def order_parts(spark, sf) -> list[Part]:
    r = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    cells = MONTH.cells(MONTH.floor(r["a"]), MONTH.next(MONTH.floor(r["b"])))
    return [Part(MONTH.name("orders", lo), lo, hi) for lo, hi in cells]


def order_manifest(spark, sf) -> Manifest:
    c = Config("orders", "o_orderdate", MONTH, ("o_orderkey", "o_orderdate"), retain=Step(24), retain_batch=5)
    return Manifest(c, "", tuple(order_parts(spark, sf)))


@query("""SELECT 'orders_p' || strftime(lo, '%Y_%m') AS child, lo, hi FROM (SELECT unnest(range(date_trunc('month', min(o_orderdate))::TIMESTAMP,
max(o_orderdate) + INTERVAL 1 MICROSECOND, INTERVAL 1 MONTH)) AS lo FROM orders), LATERAL (SELECT lo + INTERVAL 1 MONTH AS hi)
WHERE hi <= TIMESTAMP '1999-08-01' ORDER BY lo LIMIT 5""")
def q10_retain_plan(spark, sf):
    m = order_manifest(spark, sf)
    due = planner.expired(m, planner.horizon(m.config, None, dt.datetime(2001, 8, 1)), m.config.retain_batch)
    return planner.parts_frame(spark, due, MONTH)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1999-08-01'")
def q11_retained_rows(spark, sf):
    boundary = planner.horizon(order_manifest(spark, sf).config, None, dt.datetime(2001, 8, 1))
    return table(spark, sf, "orders").where(MONTH.within_col(F.col("o_orderdate"), boundary)).select("o_orderkey", "o_orderdate")


@query("""SELECT greatest(c, TIMESTAMP '2024-01-01') AS lo, least(c + INTERVAL 7 DAY, TIMESTAMP '2024-02-01') AS hi
FROM (SELECT unnest(range(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-01', INTERVAL 7 DAY)) AS c)""")
def q12_clipped_tiles(spark, sf):
    return spark.createDataFrame(planner.tiles(WEEK, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)), "lo timestamp_ntz, hi timestamp_ntz")


MIXED = [Part("coarse", 0, 3000), Part("fine_3", 3000, 4000), Part("fine_4", 4000, 5000), Part("wide", 5000, 8000)]
MIXED_SQL = "(VALUES ('coarse', 0, 3000), ('fine_3', 3000, 4000), ('fine_4', 4000, 5000), ('wide', 5000, 8000)) p(child, lo, hi)"


@query(f"SELECT child, hi > lo + 1000 AS coarse, hi <= (SELECT max(event_id) // 2000 * 1000 FROM events) AS frozen FROM {MIXED_SQL}")
def q13_coarse_frozen(spark, sf):
    front = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2
    g = Grid("id", 1000)
    return spark.createDataFrame([(p.child, planner.is_coarse(g, p), planner.is_frozen(g, p, front)) for p in MIXED], "child string, coarse boolean, frozen boolean")


@query(f"SELECT child, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events JOIN {MIXED_SQL} ON event_id >= lo AND event_id < hi GROUP BY 1")
def q14_route_mixed(spark, sf):
    g = Grid("id", 1000)
    routed = planner.route(table(spark, sf, "events"), "event_id", planner.parts_frame(spark, MIXED, g), g)
    return routed.groupBy("child").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# ---- scans and movement ---------------------------------------------------------------------------------------------


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_id >= 1500 AND event_id < 4200")
def q15_pruned_scan(spark, sf):
    return scan.between(events_lake(spark, sf), 1500, 4200).select("event_id", "ts", "user_id", "event_type")


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2000-01-01') AS cell, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def q16_chunk_copy(spark, sf):
    g, lake = Grid("time", Step.of(days=1)), fresh_lake(spark)
    moved = migrate.copy(migrate.Source(table(spark, sf, "events"), "ts"), f"{lake.root}/copy", g)
    return moved.groupBy(g.floor_col(F.col("ts")).alias("cell")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events
WHERE event_id >= (SELECT max(event_id) // 2 FROM events)) WHERE r <= 20""")
def q17_newest_20(spark, sf):
    e = table(spark, sf, "events")
    since = e.agg(F.max("event_id")).first()[0] // 2
    return changes.newest(e.where(F.col("event_id") >= since), "user_id", "event_id", 20).select("user_id", "event_id", "event_type")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def q18_window_counts(spark, sf):
    e = table(spark, sf, "events").where(WEEK.within_col(F.col("ts"), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("SELECT event_id, user_id FROM events e WHERE event_id >= 1000 AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id = e.event_id AND d.event_id % 3 = 0) ORDER BY event_id LIMIT 500")
def q19_copy_microbatch(spark, sf):
    e = table(spark, sf, "events")
    return changes.copy_missing(e, e.where("event_id % 3 = 0"), ["event_id"], "event_id", 1000, 500).select("event_id", "user_id")


def split_events(spark, sf, retain=None) -> Lake:
    lake = events_lake(spark, sf, retain=retain)
    top = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    regrain.regrain(lake, lake.manifest().attached[0].child, AS_OF, step=500, front=top + 5000)
    return lake


def counted_parts(lake: Lake) -> DataFrame:
    m = lake.manifest()
    routed = planner.route(scan.table(lake, m), "event_id", planner.parts_frame(lake.spark, m.attached, Grid("id", 500)), Grid("id", 500))
    return routed.groupBy("child").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("last"))


@query("SELECT 'events_p' || lpad(lo::VARCHAR, 19, '0') || '_to_' || lpad((lo + 500)::VARCHAR, 19, '0') AS child, count(*) AS n, min(event_id) AS lo, max(event_id) AS last FROM (SELECT event_id, event_id // 500 * 500 AS lo FROM events) t GROUP BY t.lo")
def q20_regrain(spark, sf):
    return counted_parts(split_events(spark, sf))


@query("""SELECT 'events_p' || lpad(lo::VARCHAR, 19, '0') || '_to_' || lpad((lo + 500)::VARCHAR, 19, '0') AS child, count(*) AS n, min(event_id) AS lo, max(event_id) AS last
FROM (SELECT event_id, event_id // 500 * 500 AS lo, (max(event_id) OVER () + 5000 - 8000) // 1000 * 1000 AS b FROM events) t WHERE t.lo + 500 > b GROUP BY t.lo""")
def q21_regrain_aged(spark, sf):
    return counted_parts(split_events(spark, sf, retain=8000))


@query("""SELECT event_id, value, 'new' AS origin FROM events WHERE event_id % 10 = 3 AND event_id % 20 <> 3
UNION ALL SELECT event_id, value - 1, 'old' FROM events WHERE event_id % 10 NOT IN (3, 7)""")
def q22_reconcile(spark, sf):
    e = table(spark, sf, "events")
    source = e.where("event_id % 20 <> 3 and event_id % 10 <> 7").select("event_id", "value", F.lit("new").alias("origin"))
    target = e.where("event_id % 10 <> 3").select("event_id", (F.col("value") - 1).alias("value"), F.lit("old").alias("origin"))
    keys = e.where("event_id % 10 in (3, 7)").select("event_id")
    return changes.reconcile(target, source, keys.union(keys), ["event_id"])


@query("SELECT count(*) AS backlog, min(event_id) AS first_key, max(event_id) AS last_key FROM events WHERE event_id % 5 = 0 AND event_id >= 2000 AND event_id < 6000")
def q23_delta_purge(spark, sf):
    delta = table(spark, sf, "events").where("event_id % 5 = 0").select("event_id", F.col("event_id").alias("seq"))
    kept = changes.delta_purge(delta, Grid("id", 1000).within_col(F.col("event_id"), 2000, 6000))
    return kept.agg(F.count("*").alias("backlog"), F.min("event_id").alias("first_key"), F.max("event_id").alias("last_key"))


@query("""SELECT count(*) AS n, max(l_shipdate) AS mark FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate <=
(SELECT l_shipdate FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01' ORDER BY l_shipdate LIMIT 1 OFFSET 499)""")
def q24_append_batch_ties(spark, sf):
    b = changes.append_batch(table(spark, sf, "lineitem"), "l_shipdate", dt.datetime(1996, 1, 1), 500)
    return b.agg(F.count("*").alias("n"), F.max("l_shipdate").alias("mark"))


@query("SELECT max(event_id) AS mark FROM (SELECT event_id FROM events WHERE event_id % 7 = 1 AND user_id % 2 = 0 ORDER BY event_id LIMIT 200)")
def q24b_delta_watermark(spark, sf):
    delta = table(spark, sf, "events").where("event_id % 7 = 1").select("event_id", "user_id", F.col("event_id").alias("seq"))
    return spark.createDataFrame([(changes.delta_watermark(delta, F.col("user_id") % 2 == 0, 200),)], "mark bigint")


@query("SELECT count(*) AS row_sum, 0::BIGINT AS gaps, min(l_orderkey) // 1000 * 1000 AS first_lo, max(l_orderkey) // 1000 * 1000 + 1000 AS last_hi, 0::BIGINT AS ties_split, true AS several FROM lineitem")
def q25_archive_chunks(spark, sf):
    g, li = Grid("id", 1000), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    r = li.agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b"), F.count("*").alias("n")).first()
    lo, end = g.floor(r["a"]), g.next(g.floor(r["b"]))
    first, found = lo, []
    while chunk := planner.next_chunk(li, g, "l_orderkey", lo, end, r["n"] * 28 // 5, 1000):
        found.append((*chunk, len(found)))
        lo = chunk[1]
    plan = spark.createDataFrame(found, "lo bigint, hi bigint, chunk int")
    held = li.join(F.broadcast(plan), (F.col("l_orderkey") >= F.col("lo")) & (F.col("l_orderkey") < F.col("hi")))  # a chunk is a fifth of the table: a handful of rows
    keys = held.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("chunk").alias("k"))
    both = keys.agg(F.sum("n").alias("row_sum"), F.count_if(F.col("k") > 1).alias("ties_split"))
    gaps = sum(a[1] != b[0] for a, b in zip(found, found[1:], strict=False))
    return both.select("row_sum", F.lit(gaps).cast("long").alias("gaps"), F.lit(first).cast("long").alias("first_lo"), F.lit(found[-1][1]).cast("long").alias("last_hi"), "ties_split", F.lit(len(found) > 1).alias("several"))


# ---- references -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey <> 3)")
def q27_orphans(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey <> 3")
    return fk.orphans(table(spark, sf, "orders"), c, ["o_custkey"], ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("""WITH k AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
SELECT 'keys' AS action, count(*) AS n FROM k UNION ALL SELECT 'cascade', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM k)
UNION ALL SELECT 'set null', count(*) FILTER (WHERE l_orderkey IN (FROM k)) FROM lineitem UNION ALL SELECT 'restrict', count(*) FROM lineitem""")
def q28_crossing_keys(spark, sf):
    li, doomed = table(spark, sf, "lineitem"), table(spark, sf, "orders").where(MONTH.within_col(F.col("o_orderdate"), None, dt.datetime(1995, 3, 1)))
    keys = fk.crossing_keys(li, doomed, ["l_orderkey"], ["o_orderkey"])
    count = lambda df, name: df.agg(F.lit(name).alias("action"), F.count("*").alias("n"))
    nulled = fk.act(li, keys, ["l_orderkey"], ["o_orderkey"], "set null").where("l_orderkey is null")
    free = fk.act(li, keys.limit(0), ["l_orderkey"], ["o_orderkey"], "restrict")
    return count(keys, "keys").unionAll(count(fk.act(li, keys, ["l_orderkey"], ["o_orderkey"], "cascade"), "cascade")).unionAll(count(nulled, "set null")).unionAll(count(free, "restrict"))


@query("SELECT 'lineitem' AS referencing_table, 'lineitem_orders' AS constraint_name, count(*) AS orphan_rows FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 10 <> 0)")
def q28b_orphan_counts(spark, sf):
    lake, o = fresh_lake(spark), table(spark, sf, "orders").where("o_orderkey % 10 <> 0")
    refs = (ForeignKey("lineitem_orders", "lineitem", ("l_orderkey",), ("o_orderkey",), state="restored"),)
    m = Manifest(Config("orders", "o_orderkey", Grid("id", 1000), ("o_orderkey",)), o.schema.json(), fks=refs)
    return fk.orphan_counts(lake, o, {"lineitem": table(spark, sf, "lineitem")}, m)


# ---- diagnostics ----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS sampled, count(*) AS plausible, 1.0::DOUBLE AS fraction, min(epoch_us(ts) // 1000) AS oldest_ms, max(epoch_us(ts) // 1000) AS newest_ms FROM events")
def q29_uuid_plausible(spark, sf):
    e = table(spark, sf, "events").select(Grid("uuidv7", Step.of(days=1)).encode_col(F.col("ts")).alias("u"))
    return observe.check_uuidv7(e, "u", AS_OF, None)


@query("""WITH t AS (SELECT concat('0x', substr(md5(event_id::VARCHAR), 1, 12))::BIGINT AS ms FROM events), s AS (SELECT count(*) AS sampled,
count(*) FILTER (WHERE ms BETWEEN 1420070400000 AND 1708041600000) AS plausible, min(ms) AS oldest_ms, max(ms) AS newest_ms FROM t)
SELECT sampled, plausible, round(plausible / sampled, 4)::DOUBLE AS fraction, oldest_ms, newest_ms FROM s""")
def q29b_uuid_random(spark, sf):
    e = table(spark, sf, "events").select(F.regexp_replace(F.md5(F.col("event_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-").alias("u"))
    return observe.check_uuidv7(e, "u", AS_OF, None)


def _monotonic_sql(i, t, name):
    return f"""SELECT count(p) AS sampled, count(*) FILTER (WHERE t >= p) AS monotonic, round(count(*) FILTER (WHERE t >= p) / count(p), 4)::DOUBLE AS fraction
FROM (SELECT {t} AS t, lag({t}) OVER (ORDER BY {i}) AS p FROM {name})"""


@query(_monotonic_sql("event_id", "ts", "events"))
def q30_monotonic(spark, sf):
    return observe.check_time_monotonic(table(spark, sf, "events"), "event_id", "ts", None)


@query(_monotonic_sql("o_orderkey", "o_orderdate", "orders"))
def q31_decorrelated(spark, sf):
    return observe.check_time_monotonic(table(spark, sf, "orders"), "o_orderkey", "o_orderdate", None)


@query("""SELECT name AS parent_table, min(ts) AS window_start, max(ts) AS window_end, (date_diff('microsecond', min(ts), max(ts)) // 1000000)::DOUBLE AS duration_s, count(ts) AS log_rows,
coalesce(sum(event_id) FILTER (WHERE event_id % 4 = 0), 0)::BIGINT AS rows_copied, count(*) FILTER (WHERE event_id % 4 = 1) AS regrains, count(*) FILTER (WHERE event_id % 4 = 2) AS retains
FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-08') RIGHT JOIN (VALUES ('seen')) v(name) ON true GROUP BY 1
UNION ALL SELECT 'empty', NULL, NULL, NULL, 0, 0, 0, 0""")
def q32_observe_window(spark, sf):
    action = F.get(F.array(*map(F.lit, ("regrain_copy", "regrain", "retain_drop", "obtain"))), (F.col("event_id") % 4).cast("int"))
    log = table(spark, sf, "events").select(F.col("event_id").alias("id"), action.alias("action"), F.col("event_id").alias("rows"), F.col("ts").alias("at"))
    seen = observe.observe_window(log, "seen", dt.timedelta(days=7), dt.datetime(2024, 1, 15))
    both = seen.unionAll(observe.observe_window(log.where("false"), "empty", dt.timedelta(days=7), AS_OF))
    return both.withColumn("duration_s", F.col("duration_s").cast("double"))


@query("""SELECT 'events' AS parent, count(*) AS n_partitions, count(*) FILTER (WHERE hi > lo + 1000) AS coarse_partitions, max(hi) AS newest_bound,
count(*) FILTER (WHERE hi <= (m - 3000) // 1000 * 1000) AS retain_backlog FROM (SELECT (lo)::BIGINT AS lo, (hi)::BIGINT AS hi, m FROM
(SELECT 0 AS lo, max(event_id) // 1000 * 1000 + 1000 AS hi, max(event_id) AS m FROM events UNION ALL
SELECT (m // 1000 + i) * 1000, (m // 1000 + i + 1) * 1000, m FROM (SELECT max(event_id) AS m FROM events), (VALUES (1), (2)) t(i)))""")
def q33_status(spark, sf):
    lake = events_lake(spark, sf, retain=3000)
    top = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    s = observe.status(lake, AS_OF, top)
    names = ("parent", "n_partitions", "coarse_partitions", "newest_bound", "retain_backlog")
    return spark.createDataFrame([tuple(s[k] for k in names)], "parent string, n_partitions bigint, coarse_partitions bigint, newest_bound bigint, retain_backlog bigint")


def _rank(p):
    return f"l[least(floor({p} * n)::BIGINT + 1, n)]"


@query(f"SELECT {_rank(0.5)} AS p50, {_rank(0.95)} AS p95, {_rank(0.99)} AS p99, l[n] AS max FROM (SELECT list(value ORDER BY value) AS l, count(value) AS n FROM events)")
def q34_percentiles(spark, sf):
    return observe.percentiles(table(spark, sf, "events"), "value")


@query(f"SELECT bin, n, {_rank(0.5)} AS p50, {_rank(0.95)} AS p95 FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS bin, list(value ORDER BY value) AS l, count(value) AS n FROM events GROUP BY 1)")
def q35_binned_percentiles(spark, sf):
    e = table(spark, sf, "events").select(Grid("time", Step.of(days=1)).floor_col(F.col("ts")).alias("bin"), "value")
    n = e.groupBy("bin").agg(F.count("value").alias("n"))
    return n.join(observe.percentiles(e, "value", ["bin"], (0.5, 0.95)).drop("max"), "bin", "left")


# ---- changes and migration ------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, max(ts) AS seen_at FROM events GROUP BY 1")
def q36_upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("last_event"), F.col("ts").alias("seen_at"))
    old = changes.latest(e.where("last_event < 4000"), ["user_id"], ["seen_at", "last_event"])
    return changes.upsert(old, changes.latest(e, ["user_id"], ["seen_at", "last_event"]), ["user_id"])


@query("SELECT count(*) AS n, max(event_id) AS mark FROM events WHERE event_id % 2 = 0 OR event_id > 2000")
def q37_append_catch_up(spark, sf):
    e = table(spark, sf, "events")
    top = e.agg(F.max("event_id")).first()[0]
    done, _ = migrate.drain_appends(e.where("event_id % 2 = 0 and event_id <= 2000"), e.where("event_id > 2000 or event_id % 2 = 0"), "event_id", max(1000, top // 3), 2000)
    return done.agg(F.count("*").alias("n"), F.max("event_id").alias("mark"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE event_id % 6 <> 3")
def q38_delta_drain(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    source = e.where("event_id % 6 <> 3").withColumn("value", F.when(F.col("event_id") % 6 == 0, F.col("value") * 2).otherwise(F.col("value")))
    delta = e.where("event_id % 3 = 0").select("event_id", F.col("event_id").alias("seq"))
    top = e.agg(F.max("event_id")).first()[0]
    return migrate.drain_delta(e, source, delta, ["event_id"], "event_id", top // 6)[0]


@query("SELECT true AS same_bag, false AS other_bag, true AS other_set")
def q39_rowset_equal(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    twice = e.union(e.where("event_id = 1"))
    out = (changes.rowset_equal(e, e.orderBy(F.desc("event_id"))), changes.rowset_equal(e, twice), changes.rowset_equal(e, twice, bag=False))
    return spark.createDataFrame([out], "same_bag boolean, other_bag boolean, other_set boolean")


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id >= 1000 AND event_id < 3000")
def q40_parquet_round_trip(spark, sf):
    lake = events_lake(spark, sf)
    m = lake.manifest()
    r = archive.to_parquet(f"{lake.root}/archive")(lake, m, m.attached[0], 1000, 3000)
    return spark.read.parquet(r.key).select("event_id", "ts", "user_id", "event_type", "value")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id = -1) AS changed FROM (SELECT event_type, CASE WHEN event_id % 100 = 1 THEN -1 ELSE user_id END AS user_id
FROM events WHERE event_id % 100 <> 2) GROUP BY 1""")
def q41_update_delete(spark, sf):
    lake = events_lake(spark, sf)
    e = table(spark, sf, "events")
    changes.apply_changes(lake, e.where("event_id % 100 = 1").withColumn("user_id", F.lit(-1).cast("long")), e.where("event_id % 100 = 2").select("event_id"))
    return scan.table(lake).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("user_id") == -1).alias("changed"))


@query("""SELECT name, sum(rows * 40)::BIGINT AS bytes, sum(rows * 40) / (40.0 * 1048576) AS cached_s, sum(rows * 40) / (16.0 * 1048576) AS disk_s
FROM (SELECT 'events' AS name, count(*) AS rows FROM events) GROUP BY 1""")
def q42_estimates(spark, sf):
    n = table(spark, sf, "events").count() * 40
    return spark.createDataFrame([("events", n, migrate.estimate(n)["seconds"], migrate.estimate(n, 0)["seconds"])], "name string, bytes bigint, cached_s double, disk_s double")


@query("SELECT child, lo, hi FROM (SELECT 'orders_p' || strftime(o_orderdate, '%Y_%m') AS child, date_trunc('month', o_orderdate)::TIMESTAMP AS lo, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS hi FROM orders) WHERE month(lo) = 2 GROUP BY ALL")
def q43_missing_children(spark, sf):
    parts = planner.parts_frame(spark, order_parts(spark, sf), MONTH)
    there = table(spark, sf, "orders").where(F.month("o_orderdate") != 2).select(MONTH.name_col("orders", MONTH.floor_col(F.col("o_orderdate"))).alias("child")).distinct()
    return parts.join(there, "child", "left_anti")


@query("SELECT i AS id, i * 2654435761 % 1000000 AS h, (i * 2654435761 % 1000000) % 5 AS tenant, TIMESTAMP '2024-01-01' + to_microseconds(i * 2654435761 % 1000000 * 15552000) AS created_at FROM range(1, 2001) t(i)")
def q44_generated_messages(spark, sf):
    return generate.messages(spark, 2000)


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list_sort(list(DISTINCT length(n_name)))::VARCHAR AS sizes FROM nation GROUP BY 1")
def q45_ordered_lists(spark, sf):
    sizes = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set(F.length("n_name"))).cast("array<string>"), ", "), F.lit("]"))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ',') within group (order by n_name)").alias("names"), sizes.alias("sizes"))


@query("SELECT count(*) AS n, round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1000000.0), 9)::DOUBLE AS per_second FROM events")
def q46_throughput(spark, sf):
    return observe.throughput(table(spark, sf, "events"), "ts", "value").select("n", F.round("per_second", 9).alias("per_second"))


@query("SELECT o_orderpriority, i::INT AS pos, part FROM (SELECT DISTINCT o_orderpriority, string_split(o_orderpriority, '-') AS parts FROM orders), LATERAL (SELECT unnest(parts) AS part, generate_subscripts(parts, 1) AS i)")
def q47_unnest_ordinality(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority").distinct()
    return o.select("o_orderpriority", F.posexplode(F.split("o_orderpriority", "-")).alias("pos", "part")).withColumn("pos", (F.col("pos") + 1).cast("int"))


@query("SELECT event_id, value FROM events WHERE event_id % 4 = 0 AND event_id > 800 ORDER BY event_id LIMIT 300")
def q48_keyset_page(spark, sf):
    return table(spark, sf, "events").where("event_id % 4 = 0 and event_id > 800").orderBy("event_id").limit(300).select("event_id", "value")


@query("SELECT DISTINCT replace(replace(replace(url_encode(p_name || ' ~*/+' || p_type), '+', '%20'), '*', '%2A'), '%7E', '~') AS u, regexp_replace(p_brand, '[^0-9]', '', 'g') AS d FROM part")
def q50_url_encode(spark, sf):
    p = table(spark, sf, "part")
    return p.select(text.url_encode(F.concat("p_name", F.lit(" ~*/+"), "p_type")).alias("u"), text.digits_only(F.col("p_brand")).alias("d")).distinct()


@query(f"SELECT c.child FROM (SELECT 'copy_' || s_suppkey AS child, s_suppkey * 90 AS lo, s_suppkey * 90 + 700 AS hi FROM supplier) c WHERE EXISTS (SELECT 1 FROM {MIXED_SQL} WHERE c.lo >= p.lo AND c.hi <= p.hi)")
def q51_contained_copies(spark, sf):
    copies = table(spark, sf, "supplier").select(F.concat(F.lit("copy_"), "s_suppkey").alias("child"), (F.col("s_suppkey") * 90).alias("lo"), (F.col("s_suppkey") * 90 + 700).alias("hi"), F.lit(False).alias("attached"))
    parts = planner.parts_frame(spark, MIXED, Grid("id", 1000)).withColumn("attached", F.lit(True))
    return planner.contained(copies.unionByName(parts)).select("child")


@query("""SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'changed' ELSE event_type END AS event_type FROM events WHERE event_id % 50 <> 1""")
def q52_split_under_changes(spark, sf):
    lake, e = events_lake(spark, sf), table(spark, sf, "events")
    coarse, front = lake.manifest().attached[0].child, e.agg(F.max("event_id")).first()[0] + 5000
    step = lambda: regrain.regrain_step(lake, coarse, AS_OF, 500, front)
    while not step().startswith("copied"):
        pass
    changes.apply_changes(lake, e.where("event_id % 50 = 0").withColumn("event_type", F.lit("changed")), e.where("event_id % 50 = 1").select("event_id"))
    while not step().startswith("swapped"):
        pass
    return scan.table(lake).select("event_id", "event_type")


@query("SELECT event_id // 1000 * 1000 AS lo, count(*) AS n FROM events WHERE event_id // 1000 * 1000 + 1000 > (SELECT (max(event_id) - 4000) // 1000 * 1000 FROM events) GROUP BY 1")
def q53_archive_and_drop(spark, sf):
    lake = events_lake(spark, sf, retain=4000)
    top = table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    archive.configure(lake, "parquet", f"{lake.root}/archive")  # before the split, which leaves out aged ranges that nothing archives
    regrain.regrain_history(lake, AS_OF, front=top + 5000)
    lake.publish(planner.write_blocks(lake.manifest(), planner.horizon(lake.manifest().config, top, AS_OF)))
    while archive.archive_step(lake, AS_OF):
        pass
    retain.retain(lake, AS_OF, top)
    lo = Grid("id", 1000).floor_col(F.col("event_id"))
    return scan.table(lake).groupBy(lo.alias("lo")).agg(F.count("*").alias("n"))


# ---- whole tables through sinks, ledgers, conversions and the tick ---------------------------------------------------------


@query("SELECT json_object('event_id', event_id, 'event_type', event_type, 'user_id', user_id)::VARCHAR AS value FROM events")
def q54_ndjson_sink(spark, sf):
    lake = fresh_lake(spark)
    m = convert.manage(lake, table(spark, sf, "events").select("event_id", "event_type", "user_id"), "events", "event_id", 1000, AS_OF, key=("event_id",), obtain=0)
    p = m.attached[0]
    return spark.read.text(archive.to_ndjson(f"{lake.root}/archive")(lake, m, p, p.lo, p.hi).key)


@query("SELECT part, lo, hi FROM (SELECT *, lag(hi) OVER (PARTITION BY part ORDER BY lo) AS p FROM (SELECT DISTINCT l_linenumber AS part, l_orderkey // 100 AS lo, l_orderkey // 100 + 1 AS hi FROM lineitem WHERE l_orderkey // 100 % 7 <> 3)) WHERE p <> lo")
def q55_gaps_of_a_ledger(spark, sf):
    li = table(spark, sf, "lineitem").where("l_orderkey div 100 % 7 <> 3")  # the gaps that are looked for
    lo = Grid("id", 100).floor_col(F.col("l_orderkey"))
    ledger = li.select(F.col("l_linenumber").alias("child"), (lo / 100).cast("long").alias("lo"), (lo / 100 + 1).cast("long").alias("hi")).distinct()
    return planner.ledger_gaps(ledger).select(F.col("child").alias("part"), "lo", "hi")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE user_id END AS tile, user_id + 1 AS cell, user_id + 2 AS lo, user_id + 3 AS hi, event_type AS child FROM events WHERE event_id % 10 <> 1")
def q56_clashing_columns(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("tile"), (F.col("user_id") + 1).alias("cell"), (F.col("user_id") + 2).alias("lo"), (F.col("user_id") + 3).alias("hi"), F.col("event_type").alias("child"))
    lake = fresh_lake(spark)
    convert.manage(lake, e, "events", "event_id", 1000, AS_OF, key=("event_id",), obtain=1)
    front = e.agg(F.max("event_id")).first()[0] + 5000
    regrain.regrain_history(lake, AS_OF, front=front)
    changes.apply_changes(lake, e.where("event_id % 10 = 0").withColumn("tile", F.lit(-1).cast("long")), e.where("event_id % 10 = 1").select("event_id"))
    return migrate.copy(migrate.Source(scan.table(lake), "event_id"), f"{lake.root}/copied", Grid("id", 1000))


@query("SELECT true AS refused, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS changed FROM events")
def q57_repeated_keys(spark, sf):
    lake = events_lake(spark, sf)
    e = table(spark, sf, "events").where("event_id % 3 = 0")
    twice = e.withColumn("user_id", F.lit(-2).cast("long")).union(e.withColumn("user_id", F.lit(-1).cast("long")))
    try:
        changes.apply_changes(lake, twice)
        refused = False
    except Refused:
        refused = True
    changes.apply_changes(lake, changes.latest(twice, ["event_id"], ["user_id"]))
    return scan.table(lake).agg(F.lit(refused).alias("refused"), F.count("*").alias("n"), F.count_if(F.col("user_id") == -1).alias("changed"))


@query("SELECT true AS refused, count(*) AS n FROM events")
def q58_write_block(spark, sf):
    lake, e = events_lake(spark, sf), table(spark, sf, "events")
    lake.publish(planner.write_blocks(lake.manifest(), lake.manifest().attached[0].hi))
    try:
        changes.apply_changes(lake, e.where("event_id % 2 = 0"))
        refused = False
    except Refused:
        refused = True
    lake.publish(planner.write_blocks(lake.manifest(), None))
    changes.apply_changes(lake, e)
    return scan.table(lake).agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("SELECT (epoch_us(TIMESTAMP '2024-01-01') + i * (6 * 2592000000000 // 2000)) // 1000 AS ms FROM range(1, 2001) t(i)")
def q59_uuid_events(spark, sf):
    return generate.uuid_events(spark, 2000).select(uuid_ms_col(F.col("id")).alias("ms"))


@query("SELECT i AS id, TIMESTAMP '2024-01-01' + to_microseconds(i * (6 * 2592000000000 // 2000)) AS created_at, i * 2654435761 % 50000 AS user_id, i % 8 AS kind, repeat(md5(i::VARCHAR), 11) AS payload FROM range(1, 2001) t(i)")
def q60_generated_events(spark, sf):
    return generate.events(spark, 2000)


@query("SELECT event_id // 500 * 500 AS lo, count(*) AS n FROM events GROUP BY 1")
def q61_child_scans(spark, sf):
    lake, e = events_lake(spark, sf), table(spark, sf, "events")
    regrain.regrain(lake, lake.manifest().attached[0].child, AS_OF, 500, e.agg(F.max("event_id")).first()[0] + 5000)
    m, out = lake.manifest(), None
    for p in m.attached[:40]:  # at most 40 children one by one, the rest of them in one scan
        one = scan.child(lake, p.child, m).select("event_id")
        out = one if out is None else out.unionAll(one)
    rest = scan.read(lake, m, m.attached[40:]).select("event_id")
    return out.unionAll(rest).groupBy(Grid("id", 500).floor_col(F.col("event_id")).alias("lo")).agg(F.count("*").alias("n"))


@query("SELECT unnest(range(min(l_orderkey) // 1000 * 1000, max(l_orderkey) // 1000 * 1000 + 1, 1000)) AS lo FROM lineitem")
def q62_chunk_scan(spark, sf):
    found = scan.chunks(table(spark, sf, "lineitem"), Grid("id", 1000), "l_orderkey")
    return spark.createDataFrame(found, "lo bigint, hi bigint").select("lo")


@query("""WITH b AS (SELECT min(event_id) // 1000 * 1000 AS a, max(event_id) // 1000 * 1000 + 1000 AS z FROM events)
SELECT 'events' AS parent, a AS lo, z AS hi, true AS attached, 1::INT AS n_files FROM b UNION ALL SELECT 'events', z + k * 1000, z + k * 1000 + 1000, true, 0 FROM b, range(2) t(k)""")
def q63_partitions_view(spark, sf):
    return scan.partitions_view(events_lake(spark, sf), f"parts_{uuid.uuid4().hex}").select("parent", "lo", "hi", "attached", "n_files")


@query("SELECT max(event_id) // 1000 * 1000 + 1000 AS covered_hi, count(*) AS n FROM events")
def q64_noop_sink(spark, sf):
    lake = events_lake(spark, sf)
    m = lake.manifest()
    r = archive.noop(lake, m, m.attached[0], m.attached[0].lo, m.attached[0].hi)
    return spark.createDataFrame([(r.covered_hi, r.rows)], "covered_hi bigint, n bigint")


@query("SELECT event_id, user_id, user_id * 2 AS twice, event_type || '!' AS loud FROM events")
def q65_generated_columns(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.lit(0).alias("twice"), "event_type", F.lit("").alias("loud"))
    return changes.with_generated(e, (("twice", "user_id * 2"), ("loud", "event_type || '!'"))).drop("event_type")


@query("SELECT least(count(*), 50) - 1 AS neighbours, least(count(*), 70) AS uuids FROM events")
def q66_samples(spark, sf):
    e = table(spark, sf, "events")
    a = observe.check_time_monotonic(e, "event_id", "ts", 50).select(F.col("sampled").alias("neighbours"))
    n = e.count()
    b = observe.check_uuidv7(generate.uuid_events(spark, n), "id", AS_OF, 70).select(F.col("sampled").alias("uuids"))
    return a.join(F.broadcast(b))  # a row each


@query("SELECT CASE WHEN k = 1 THEN 0 ELSE k END AS parts, n FROM (SELECT max(event_id) // 1000 - min(event_id) // 1000 + 1 AS k, count(*) AS n FROM events)")
def q67_regrain_history(spark, sf):
    lake = events_lake(spark, sf)
    k = regrain.regrain_history(lake, AS_OF, front=table(spark, sf, "events").agg(F.max("event_id")).first()[0] + 5000)
    return scan.table(lake).agg(F.lit(k).cast("long").alias("parts"), F.count("*").alias("n"))


@query("SELECT 1::BIGINT AS folders, 0::BIGINT AS left_over, count(*) AS n FROM events")
def q68_cancelled_split(spark, sf):
    lake = events_lake(spark, sf)
    child, front = lake.manifest().attached[0].child, table(spark, sf, "events").agg(F.max("event_id")).first()[0] + 5000
    while not regrain.regrain_step(lake, child, AS_OF, 500, front).startswith("copied"):
        pass
    gone = convert.abort(lake)
    return scan.table(lake).agg(F.lit(gone).cast("long").alias("folders"), F.lit(convert.abort(lake)).cast("long").alias("left_over"), F.count("*").alias("n"))


@query("SELECT event_id, ts, value FROM events")
def q69_cutover_with_changes(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    delta = e.where("event_id % 3 = 0").select("event_id", F.col("event_id").alias("seq"))
    lake = fresh_lake(spark)
    migrate.from_chunks(lake, migrate.Source(e, "event_id", ("event_id",)), "events", Grid("id", 1000), AS_OF, delta)
    return scan.table(lake)


@query("SELECT event_id, ts, value FROM events")
def q70_cutover(spark, sf):
    lake = fresh_lake(spark)
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    migrate.from_chunks(lake, migrate.Source(e, "event_id", ("event_id",)), "events", Grid("id", 1000), AS_OF)
    return scan.table(lake)


@query("SELECT 5::BIGINT AS refused")
def q71_preflight(spark, sf):
    e, refused = table(spark, sf, "events"), 0
    for bad, track in (({"control": "nope"}, False), ({"dimensions": 2}, False), ({"continuous_aggregates": True}, False), ({"unvalidated_references": ("f",)}, False), ({}, True)):
        try:
            migrate.preflight(migrate.Source(**({"df": e, "control": "ts"} | bad)), track)
        except Refused:
            refused += 1
    return spark.createDataFrame([(refused,)], "refused bigint")


@query("SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP AS lo, TIMESTAMP '2024-03-01' AS hi, count(*) AS n FROM orders")
def q72_manage_by_time(spark, sf):
    lake = fresh_lake(spark)
    p = convert.manage(lake, table(spark, sf, "orders"), "orders", "o_orderdate", Step(1), AS_OF, obtain=0).attached[0]
    return scan.table(lake).agg(F.lit(p.lo).cast("timestamp_ntz").alias("lo"), F.lit(p.hi).cast("timestamp_ntz").alias("hi"), F.count("*").alias("n"))


@query("SELECT event_id, ts, user_id, event_type, value, true AS was_managed, false AS is_managed FROM events")
def q73_unmanage(spark, sf):
    lake = events_lake(spark, sf)
    was = lake.managed
    return convert.unmanage(lake).select("event_id", "ts", "user_id", "event_type", "value", F.lit(was).alias("was_managed"), F.lit(lake.managed).alias("is_managed"))


@query("SELECT false AS paused, 7::INT AS obtain, true AS refused")
def q74_settings(spark, sf):
    lake = events_lake(spark, sf)
    convert.configure(lake, paused=False, obtain=7)
    try:
        convert.configure(lake, colour="red")
        refused = False
    except Refused:
        refused = True
    c = lake.manifest().config
    return spark.createDataFrame([(c.paused, c.obtain, refused)], "paused boolean, obtain int, refused boolean")


@query("""SELECT event_id // 1000 * 1000 AS lo, count(*) AS n FROM (SELECT event_id FROM events UNION ALL SELECT max(event_id) // 1000 * 1000 + 1500 FROM events)
WHERE event_id >= (SELECT max(event_id) // 1000 * 1000 - 3000 FROM events) GROUP BY 1""")
def q75_tick(spark, sf):
    lake, e = events_lake(spark, sf, retain=4000), table(spark, sf, "events")
    hi = lake.manifest().attached[0].hi
    changes.apply_changes(lake, e.limit(1).withColumn("event_id", F.lit(hi + 500).cast("long")))
    convert.configure(lake, archive="noop", paused=False, regrain_to=1000)
    for _ in range(4):
        tick.tick_all([lake], AS_OF)
    return scan.table(lake).groupBy(Grid("id", 1000).floor_col(F.col("event_id")).alias("lo")).agg(F.count("*").alias("n"))


@query("SELECT 1::BIGINT AS suspended, 1::BIGINT AS restored, 1::BIGINT AS validated, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def q76_references(spark, sf):
    o, li, lake = table(spark, sf, "orders"), table(spark, sf, "lineitem"), fresh_lake(spark)
    ref = ForeignKey("of_order", "lineitem", ("l_orderkey",), ("o_orderkey",))
    convert.manage(lake, o, "orders", "o_orderkey", 1000, AS_OF, key=("o_orderkey",), obtain=0, fks=(ref,), incoming_fks="preserve")
    out, there = fk.suspend(lake, AS_OF), fk.restore(lake, AS_OF)
    n = fk.orphan_counts(lake, o, {"lineitem": li}).first()["orphan_rows"]
    done = fk.validate(lake, o, {"lineitem": li.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")}, AS_OF)
    return spark.createDataFrame([(out, there, done, n)], "suspended bigint, restored bigint, validated bigint, orphans bigint")


@query("SELECT event_id FROM events WHERE event_id % 7 = ANY([1, 3, 5])")
def q77_any_of(spark, sf):
    return table(spark, sf, "events").where(predicates.any_of(F.col("event_id") % 7, F.array(F.lit(1), F.lit(3), F.lit(5)))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM nullif(o_orderpriority, '1-URGENT')")
def q78_distinct_from(spark, sf):
    a, b = F.nullif(F.col("o_orderstatus"), F.lit("F")), F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    return table(spark, sf, "orders").where(predicates.distinct_from(a, b)).select("o_orderkey")


@query("SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS part, unnest(range(len(string_split(n_name, 'A')))) AS pos FROM nation")
def q79_zipped_unnest(spark, sf):
    parts = F.split("n_name", "A")
    both = predicates.zipped(part=parts, pos=F.sequence(F.lit(0).cast("long"), F.size(parts).cast("long") - 1))
    return table(spark, sf, "nation").select("n_nationkey", F.inline(both).alias("part", "pos"))


@query("""SELECT event_id, CASE WHEN event_id % 90 = 7 THEN 'changed' ELSE event_type END AS event_type FROM events WHERE event_id % 90 <> 8""")
def q80_split_in_batches(spark, sf):
    lake, e = events_lake(spark, sf), table(spark, sf, "events")
    r = e.agg(F.max("event_id").alias("top"), F.count("*").alias("n")).first()
    convert.configure(lake, regrain_batch=max(1, r["n"] // 3))
    child, said, changed = lake.manifest().attached[0].child, "", False
    while not said.startswith("swapped"):
        said = regrain.regrain_step(lake, child, AS_OF, 100 if r["n"] < 5000 else 500, r["top"] + 5000)
        if said.startswith("copied") and not changed:  # while some tiles are copied and others are not
            changed = True
            changes.apply_changes(lake, e.where("event_id % 90 = 7").withColumn("event_type", F.lit("changed")), e.where("event_id % 90 = 8").select("event_id"))
    return scan.table(lake).select("event_id", "event_type")

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlake.functions.grid import Grid, Step
from gridlake.operators import changes, convert, fk, migrate, observe, regrain, retain
from gridlake.plans import planner
from gridlake.plans.registry import Conflict, ForeignKey, Lake, Part, Refused, replace
from gridlake.sources import archive, scan
from gridlake.streaming import tick

NOW = dt.datetime(2024, 2, 15)


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, f"file://{tmp_path}/lake")


def rows(spark, n, start=1, step=1):
    return spark.range(start, start + n * step, step).select("id", F.concat(F.lit("p"), "id").alias("payload"))


def managed(lake, spark, n=50_000, frontier=65_000, step=10_000, **more):
    df = rows(spark, n).union(rows(spark, 1, frontier))
    convert.manage(lake, df, "t", "id", 100_000, NOW, key=("id",), obtain=1, **more)
    m = lake.manifest()  # one part [0, 60000) and one at the frontier, on the step to come
    parts = (Part("t_mono", 0, 60_000, m.attached[0].files), Part("t_front", 60_000, 70_000, m.attached[0].files))
    return lake.publish(replace(m, config=replace(m.config, grid=Grid("id", step)), parts=parts))


def read_parts(lake):
    m = lake.manifest()
    return [(p, scan.child(lake, p.child, m)) for p in m.attached]


def test_regrain_keeps_every_row(lake, spark):
    managed(lake, spark)
    assert regrain.regrain(lake, "t_mono", NOW, front=65_000) == 6
    total = sum(df.count() for _, df in read_parts(lake))
    assert total == 50_001 and len(lake.manifest().attached) == 7


def test_regrain_leaves_aged_ranges_out(lake, spark):
    managed(lake, spark, retain=30_000)
    assert regrain.regrain(lake, "t_mono", NOW, front=65_000) == 3
    assert min(p.lo for p in lake.manifest().attached) == 30_000


def test_obtain_skips_what_a_coarse_part_covers():
    cells = planner.obtain_cells(Grid("id", 1000), 4999, 2, [Part("c", 0, 5000)])
    assert cells == [(5000, 6000), (6000, 7000)]


def test_interleaved_changes_survive_a_split(lake, spark):
    df = rows(spark, 250, 10, 10).union(rows(spark, 1, 20_000))
    convert.manage(lake, df, "t", "id", 30_000, NOW, key=("id",), obtain=0)
    m = lake.manifest()
    files = m.attached[0].files
    lake.publish(replace(m, config=replace(m.config, grid=Grid("id", 100)), parts=(Part("c", 0, 3000, files), Part("f", 20_000, 20_100, files))))
    m = lake.manifest()
    one = lake.write(scan.child(lake, "c", m)), lake.write(scan.child(lake, "f", m))
    lake.publish(replace(m, parts=(replace(m.part("c"), files=one[0]), replace(m.part("f"), files=one[1]))))
    step = lambda: regrain.regrain_step(lake, "c", NOW, None, 20_000)
    assert step() == "prepared"
    changes.apply_changes(lake, spark.createDataFrame([(60, "first")], "id long, payload string"))
    assert step() == "copied:250"
    changes.apply_changes(lake, spark.createDataFrame([(60, "last"), (61, "new"), (2999, "new")], "id long, payload string"), spark.createDataFrame([(70,)], "id long"))
    assert step().startswith("reconciled:")
    assert step() == "swapped:30"
    got = {r["id"]: r["payload"] for r in scan.table(lake).collect()}
    assert len(got) == 252 and got[60] == "last" and got[61] == "new" and 70 not in got


def test_cancelled_split_leaves_the_source(lake, spark):
    managed(lake, spark)
    regrain.regrain_step(lake, "t_mono", NOW, None, 65_000)
    regrain.regrain_step(lake, "t_mono", NOW, None, 65_000)
    assert regrain.cancel(lake) == 1 and regrain.cancel(lake) == 0
    assert scan.child(lake, "t_mono").count() == 50_000


def test_split_refusals(lake, spark):
    managed(lake, spark)
    assert regrain.regrain_step(lake, "t_mono", NOW, None, 55_000) == "active"
    assert regrain.regrain_step(lake, "t_front", NOW, None, 99_000) == "nosubdiv"
    with pytest.raises(Refused):
        regrain.regrain(lake, "t_front", NOW, front=99_000)
    convert.configure(lake, key=())
    assert regrain.regrain_step(lake, "t_mono", NOW, None, 65_000) == "nokey"


def test_pruned_scan_reads_few_files(lake, spark):
    managed(lake, spark)
    regrain.regrain(lake, "t_mono", NOW, front=65_000)
    m = lake.manifest()
    assert len(scan.pruned(m, 12_000, 19_000)) == 1
    df = scan.between(lake, 12_000, 19_000, m)
    assert df.count() == 7000 and len(df.inputFiles()) < len(scan.table(lake, m).inputFiles())
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,12000), LessThan(id,19000)]" in df._jdf.queryExecution().toString()


def test_writes_need_a_partition(lake, spark):
    managed(lake, spark)
    with pytest.raises(Refused, match="covers"):
        changes.apply_changes(lake, spark.createDataFrame([(900_000, "x")], "id long, payload string"))
    m = lake.manifest()
    lake.publish(planner.write_blocks(m, 60_000))
    with pytest.raises(Refused, match="retention"):
        changes.apply_changes(lake, spark.createDataFrame([(5, "x")], "id long, payload string"))
    lake.publish(planner.write_blocks(lake.manifest(), None))
    changes.apply_changes(lake, spark.createDataFrame([(5, "x")], "id long, payload string"))
    assert scan.table(lake).where("id = 5").first()["payload"] == "x"


def test_two_writers_of_a_version(lake, spark):
    managed(lake, spark)
    m = lake.manifest()
    lake.publish(m)
    with pytest.raises(Conflict):
        lake.publish(m)


def test_overlaps_are_refused(lake, spark):
    m = managed(lake, spark)
    with pytest.raises(Refused, match="overlap"):
        lake.publish(replace(m, parts=(*m.parts, Part("x", 5, 10))))


def test_archive_before_drop(lake, spark, tmp_path):
    managed(lake, spark, n=100, frontier=3000, step=1000, retain=1000, archive="noop", archive_byte_budget=600)
    m = lake.manifest()
    lake.publish(replace(m, parts=(Part("old", 0, 1000, m.attached[0].files), Part("front", 3000, 4000, m.attached[0].files))))
    lake.publish(planner.write_blocks(lake.manifest(), 1000))
    assert retain.retire(lake, "old", NOW, 3000) is False
    steps = 0
    while not planner.covered(m := lake.manifest(), m.part("old")):
        assert archive.archive_step(lake, NOW) == 1
        steps += 1
    ledger = sorted(m.ledger, key=lambda e: e["lo"])
    assert steps > 2 and ledger[0]["lo"] == 0 and ledger[-1]["hi"] == 1000 and sum(e["rows"] for e in ledger) == 100
    assert all(a["hi"] == b["lo"] for a, b in zip(ledger, ledger[1:], strict=False))
    assert retain.retire(lake, "old", NOW, 3000) is True


def test_sinks_read_back_elsewhere(lake, spark, tmp_path):
    import duckdb

    managed(lake, spark, n=100)
    m = lake.manifest()
    p = archive.to_parquet(f"file://{tmp_path}/pq")(lake, m, m.part("t_mono"), 10, 50)
    j = archive.to_ndjson(f"file://{tmp_path}/nd")(lake, m, m.part("t_mono"), 10, 50)
    assert p.rows == j.rows == 40
    assert duckdb.sql(f"SELECT count(*), min(id), max(id) FROM '{p.key[7:]}/*.parquet'").fetchall() == [(40, 10, 49)]
    assert spark.read.json(j.key).count() == 40
    with pytest.raises(Refused, match="Parquet"):
        archive.check_types(spark.range(1).select(F.array("id").alias("a")).schema)
    assert archive.object_name("t", -1000, 5, ".x") != archive.object_name("t", 1000, 5, ".x")


def test_reconcile_is_idempotent(spark):
    target, source = rows(spark, 10), rows(spark, 12).withColumn("payload", F.lit("new")).where("id <> 3")
    keys = spark.createDataFrame([(3,), (4,), (11,), (99,)], "id long")
    once = changes.reconcile(target, source, keys, ["id"])
    assert changes.rowset_equal(once, changes.reconcile(once, source, keys, ["id"]))
    got = {r["id"]: r["payload"] for r in once.collect()}
    assert 3 not in got and got[4] == "new" and got[11] == "new" and got[5] == "p5"


def test_references(lake, spark):
    orders = rows(spark, 10)
    items = spark.createDataFrame([(1, 1), (2, 99), (3, None)], "item long, order_id long")
    assert [r["item"] for r in fk.orphans(items, orders, ["order_id"], ["id"]).collect()] == [2]
    keys = fk.crossing_keys(items, orders.where("id < 5"), ["order_id"], ["id"])
    assert [r["id"] for r in keys.collect()] == [1]
    assert fk.act(items, keys, ["order_id"], ["id"], "cascade").count() == 2
    assert fk.act(items, keys, ["order_id"], ["id"], "set null").where("order_id is null").count() == 2
    assert fk.act(items, keys, ["order_id"], ["id"], "set default", 7).where("order_id = 7").count() == 1
    with pytest.raises(Refused):
        fk.act(items, keys, ["order_id"], ["id"], "restrict")
    ref = ForeignKey("f", "items", ("order_id",), ("id",))
    convert.manage(lake, orders, "orders", "id", 100, NOW, key=("id",), fks=(ref,), incoming_fks="preserve")
    assert fk.suspend(lake, NOW) == 1 and fk.restore(lake, NOW) == 1
    tables = {"items": items}
    assert fk.orphan_counts(lake, orders, tables).first()["orphan_rows"] == 1
    assert fk.validate(lake, orders, tables, NOW) == 0
    assert fk.validate(lake, orders, {"items": items.where("item <> 2")}, NOW) == 0  # waits
    assert fk.validate(lake, orders, {"items": items.where("item <> 2")}, NOW + dt.timedelta(minutes=6)) == 1


def test_conversion_refusals(lake, spark):
    df = rows(spark, 10)
    bad = [dict(control="nope"), dict(key=("payload",)), dict(fks=(ForeignKey("f", "x", ("a",), ("id",)),)), dict(incoming_fks="drop")]
    for b in bad:
        with pytest.raises(Refused):
            convert.manage(lake, df, "t", **({"control": "id", "step": 10, "as_of": NOW} | b))
    with pytest.raises(Refused, match="unique"):
        convert.manage(lake, df.union(df), "t", "id", 10, NOW, key=("id",))
    with pytest.raises(Refused, match="nulls"):
        convert.manage(lake, df.withColumn("id", F.when(F.col("id") > 3, F.col("id"))), "t", "id", 10, NOW)
    uuids = df.select(F.expr("uuid()").alias("u"))
    with pytest.raises(Refused, match="plausible"):
        convert.manage(lake, uuids, "t", "u", Step(1), NOW)
    convert.manage(lake, df, "t", "id", 10, NOW, key=("id",))
    with pytest.raises(Refused, match="already"):
        convert.manage(lake, df, "t", "id", 10, NOW)
    assert convert.unmanage(lake).count() == 10 and not lake.managed


def test_migration(lake, spark):
    e = spark.range(240).select(F.expr("timestampadd(HOUR, id, timestamp_ntz'2024-01-01')").alias("ts"), (F.col("id") % 7).alias("device"), F.col("id").cast("double").alias("temp"))
    s = migrate.Source(e, "ts", ("device", "ts"))
    g = Grid("time", Step.of(days=1))
    for b in (dict(dimensions=2), dict(continuous_aggregates=True), dict(unvalidated_references=("f",)), dict(control="x")):
        with pytest.raises(Refused):
            migrate.preflight(migrate.Source(**({"df": e, "control": "ts"} | b)))
    with pytest.raises(Refused):
        migrate.preflight(migrate.Source(e, "ts"), track=True)
    assert len(scan.chunks(e, g, "ts")) == 10
    late = e.where("temp >= 200")
    done, mark = migrate.drain_appends(e.where("temp < 200"), e, "ts", 7, e.where("temp = 199").first()["ts"])
    assert changes.rowset_equal(done, e) and mark == late.agg(F.max("ts")).first()[0]
    m = migrate.from_chunks(lake, s, "t", g, dt.datetime(2024, 1, 11))
    assert changes.rowset_equal(scan.table(lake, m), e)
    delta = e.select("device", "ts", F.monotonically_increasing_id().alias("seq"))
    with pytest.raises(Refused, match="end"):
        migrate.drain_delta(e, e, delta, ["device", "ts"], "ts", 1, max_steps=1)


def test_tick_goes_in_order(lake, spark):
    managed(lake, spark, retain=30_000, archive="noop")
    assert tick.tick(lake, NOW) == "paused"
    convert.configure(lake, paused=False, regrain_to=10_000)
    said = [tick.tick(lake, NOW) for _ in range(4)]
    assert "regrain=prepared" in said[0] and "copied" in said[1] and "swapped:6" in said[2]
    assert "archived=3" in said[3] and "dropped=3" in said[3]
    assert min(p.lo for p in lake.manifest().attached) == 30_000
    assert observe.observe_window(observe.log_frame(lake), "t", dt.timedelta(days=1), NOW).first()["retains"] == 3


def test_status_of_a_table_that_is_gone(lake, spark):
    managed(lake, spark, retain=30_000)
    s = observe.status(lake, NOW, 65_000)
    assert s["coarse_partitions"] == 1 and s["retain_backlog"] == 0 and s["history_unregrained"]
    assert observe.status(lake, NOW, 65_000, missing=True)["retain_backlog"] is None
    for f in {f for p in lake.manifest().parts for f in p.files}:
        lake.store.delete(f)
    assert retain.forget_missing([lake])[0]["partitions_forgotten"] == 2 and not lake.managed


def test_changes_as_a_stream(lake, spark, tmp_path):
    convert.manage(lake, rows(spark, 20), "t", "id", 100, NOW, key=("id",))
    feed = f"file://{tmp_path}/feed"
    spark.createDataFrame([(1, "a", "upsert", 1), (1, "b", "upsert", 2), (2, None, "delete", 3), (50, "c", "upsert", 4)], "id long, payload string, op string, seq long").write.parquet(feed)
    stream = spark.readStream.schema("id long, payload string, op string, seq long").parquet(feed)
    for _ in range(2):  # the second run finds nothing new
        tick.stream_changes(lake, stream, f"file://{tmp_path}/cp", ["id"]).awaitTermination(120)
    got = {r["id"]: r["payload"] for r in scan.table(lake).collect()}
    assert got[1] == "b" and 2 not in got and got[50] == "c" and len(got) == 20
    tick.stream_appends(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp2").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4


def test_chunks_of_uuids_within_a_millisecond(spark):
    g = Grid("uuidv7", Step.of(days=1))
    lo = dt.datetime(2024, 1, 1)
    head = g.encode(lo)[:14]
    df = spark.createDataFrame([(f"{head}7{i:03d}-8000-000000000000",) for i in range(30)] + [(g.encode(lo + dt.timedelta(seconds=1)),)], "u string")
    seen, at, hi = 0, lo, lo + dt.timedelta(days=1)
    while chunk := planner.next_chunk(df, g, "u", at, hi, 100, 10):
        seen += df.where(g.within_col(F.col("u"), *chunk)).count()
        assert chunk[1] > at
        at = chunk[1]
    assert seen == 31


def test_generators_are_the_same_each_time(spark):
    from gridlake.sources import generate

    assert changes.rowset_equal(generate.messages(spark, 100), generate.messages(spark, 100))
    assert generate.events(spark, 50).agg(F.count_distinct("created_at")).first()[0] == 50
    u = observe.check_uuidv7(generate.uuid_events(spark, 50), "id", dt.datetime(2024, 8, 1)).first()
    assert u["sampled"] == u["plausible"] == 50


def test_latest_and_percentiles(spark):
    e = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k long, t long, v string")
    assert {(r["k"], r["v"]) for r in changes.latest(e, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c")}
    r = observe.percentiles(spark.range(1, 101).select(F.col("id").alias("x"), (F.col("id") % 2).alias("g")), "x", ["g"]).orderBy("g").collect()
    assert [(x["p50"], x["p95"], x["p99"], x["max"]) for x in r] == [(52, 96, 100, 100), (51, 95, 99, 99)]


def test_writers_at_the_same_time(lake, spark):
    """Of many writers of one version one wins, whatever the order of their steps."""
    from concurrent.futures import ThreadPoolExecutor

    managed(lake, spark)
    m = lake.manifest()

    def publish(_):
        try:
            return lake.publish(m).version
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sorted(v is not None for v in pool.map(publish, range(8))) == [False] * 7 + [True]
    assert lake.manifest().version == m.version + 1 and not any(n.endswith(".tmp") for n in lake.store.names("_manifest"))


def test_repeated_keys_and_own_names_are_refused(lake, spark):
    managed(lake, spark)
    with pytest.raises(Refused, match="same key"):
        changes.apply_changes(lake, spark.createDataFrame([(5, "a"), (5, "b")], "id long, payload string"))
    with pytest.raises(Refused, match="same key"):
        changes.upsert(rows(spark, 3), rows(spark, 3).union(rows(spark, 1)), ["id"])
    with pytest.raises(Refused, match="own"):
        convert.manage(Lake(spark, f"{lake.root}2"), rows(spark, 3).withColumn("gridlake_tile", F.lit(1)), "t", "id", 10, NOW)


def jobs(spark):
    """The number of the job that has run last."""
    spark.range(1).collect()
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.mark.parametrize("kind", ["noop", "parquet", "ndjson"])
def test_many_chunks_are_archived_in_a_few_jobs(lake, spark, tmp_path, kind):
    """a job or two for each partition took longer than all else. One chunk is empty, and one is too large for the budget."""
    df = rows(spark, 4000).where("id < 2000 or id >= 2100").repartition(3).withColumn("payload", F.when(F.col("id").between(500, 599), F.repeat(F.lit("x"), 1000)).when(F.col("id") > 7, F.col("payload")))
    convert.manage(lake, df, "t", "id", 100, NOW, key=("id",), obtain=0, retain=0, archive="noop", archive_byte_budget=50_000)
    assert regrain.regrain_history(lake, NOW, front=5000) == 41
    if kind != "noop":
        archive.configure(lake, kind, f"file://{tmp_path}/archive")
    lake.publish(planner.write_blocks(lake.manifest(), 4000))
    first = jobs(spark)
    assert archive.archive_step(lake, NOW) == 40 and jobs(spark) - first < 40
    while archive.archive_step(lake, NOW):
        pass
    m = lake.manifest()
    assert all(planner.covered(m, p) for p in m.attached[:40]) and sum(e["rows"] for e in m.ledger) == 3899
    assert [e["id"] for e in m.log] == list(range(1, len(m.log) + 1)) and {e["rows"] for e in m.ledger if e["child"] == "t_p0000000000000002000"} == {0}
    for e in m.ledger if kind != "noop" else ():
        assert e["key"] == f"file://{tmp_path}/archive/" + archive.object_name("t", e["lo"], e["hi"], f".{kind}")
        there = spark.read.schema("id long, payload string")
        there = [tuple(r) for r in (there.parquet(e["key"]) if kind == "parquet" else there.json(e["key"])).collect()]
        assert there == [tuple(r) for r in df.where(F.col("id").between(e["lo"], e["hi"] - 1)).orderBy("id").collect()]
    assert sorted(p.name for p in (tmp_path / "archive").glob("*")) == sorted(e["key"].rsplit("/", 1)[1] for e in m.ledger if e["key"])
    first = jobs(spark)
    assert retain.retain(lake, NOW, 4000) == 40 and jobs(spark) - first == 1 and scan.table(lake).count() == 1


def test_references_hold_partitions_in_one_job(lake, spark):
    ref = ForeignKey("f", "items", ("order_id",), ("id",))
    convert.manage(lake, rows(spark, 4000), "t", "id", 100, NOW, key=("id",), obtain=0, retain=4100, fks=(ref,), incoming_fks="preserve")
    assert regrain.regrain_history(lake, NOW, front=4100) == 41
    items = spark.createDataFrame([(1, 5), (2, 77), (3, 1099), (4, None), (5, 3020)], "item long, order_id long")
    first = jobs(spark)
    assert retain.retain(lake, NOW, 6100, {"items": items}) == 18 and jobs(spark) - first < 18
    m = lake.manifest()
    assert [p.lo for p in m.attached[:3]] == [0, 1000, 2000]
    assert [(e["lo"], e["method"]) for e in m.log if e["action"] == "fail_retain_crossing"] == [(0, "f"), (1000, "f")]
    assert retain.retire(lake, m.attached[1].child, NOW, 6100, {"items": items}) is False and retain.retire(lake, m.attached[1].child, NOW, 6100, {"items": items.where("item = 1")}) is True


def test_rank_without_one_sort(spark):
    """one task read the keys of a whole chunk."""
    for df, n in ((spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("c")), 20_000), (spark.range(9000).select((F.col("id") % 3).alias("c")), 9000), (spark.range(3000).select(F.format_string("k%05d", F.col("id") % 1500).alias("c")), 3000)):
        keys = sorted(r["c"] for r in df.collect())
        assert [planner.at_rank(df, k, 50, 100) for k in (1, n // 3, n - 1, n, n + 5)] == [keys[min(k, n) - 1] for k in (1, n // 3, n - 1, n, n + 5)]
    days = spark.range(3000).select(F.expr("timestampadd(HOUR, id div 2, timestamp_ntz'2024-01-01')").alias("c"))
    assert planner.at_rank(days, 1001, 50, 100) == dt.datetime(2024, 1, 1) + dt.timedelta(hours=500)
    assert planner.at_rank(df.limit(0), 5) is None
    asked, limit = [], type(df).limit
    mp = pytest.MonkeyPatch()
    mp.setattr(type(df), "limit", lambda self, k: asked.append(k) or limit(self, k))
    try:
        one = planner.next_chunk(spark.range(400_000).select("id"), Grid("id", 1000), "id", 0, 400_000, 8 * 250_000, 1000)
    finally:
        mp.undo()
    assert one == (0, 250_000) and max(asked) <= 100_000  # it sorted 250,000 rows into one task


def test_many_folders_are_listed_in_few_tasks(lake, spark):
    """each tile's folder was listed in a task of its own."""
    convert.manage(lake, rows(spark, 4000), "t", "id", 50, NOW, key=("id",), obtain=0)
    assert regrain.regrain_history(lake, NOW, front=5000) == 81
    was, first = spark.conf.get(scan.LISTING), jobs(spark)
    df, tracker = scan.table(lake), spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(None) if j > first for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism < 81
    assert df.count() == 4000 and spark.conf.get(scan.LISTING) == was

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlake.functions.grid import Grid, GridError, Step, literal, ntz, uuid_ms_col, uuid_of

MONTH, WEEK = Grid("time", Step(1)), Grid("time", Step.of(days=7))
times = st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2150, 1, 1))


def test_month_floor_drops_the_anchors_day():
    g = Grid("time", Step(3), dt.datetime(2000, 1, 15, 9))
    assert g.floor(dt.datetime(1999, 11, 30)) == dt.datetime(1999, 10, 1)
    assert g.next(dt.datetime(1999, 10, 1)) == dt.datetime(2000, 1, 1)


def test_id_floor_below_zero():
    g = Grid("id", 10, 7)
    assert [g.floor(v) for v in (3, 7, -20)] == [-3, 7, -23]


@given(times, st.sampled_from([Step(1), Step(5), Step(12), Step.of(days=7), Step.of(hours=5), Step(0, 1_234_567)]))
@settings(max_examples=200)
def test_floor_and_next_enclose(v, step):
    g = Grid("time", step)
    lo = g.floor(v)
    assert lo <= v < g.next(lo) and g.floor(lo) == lo


def test_columns_match_scalars(spark):
    some = [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1999, 12, 31), dt.datetime(2000, 1, 1), dt.datetime(2024, 2, 29, 12, 30, 1, 5)]
    df = spark.createDataFrame([(v,) for v in some], "v timestamp_ntz")
    for g in (MONTH, WEEK, Grid("time", Step(7), dt.datetime(2001, 5, 9)), Grid("time", Step.of(minutes=7))):
        lo = g.floor_col(F.col("v"))
        rows = df.select("v", lo.alias("lo"), g.next_col(lo).alias("hi"), g.name_col("t", lo).alias("name")).collect()
        assert [tuple(r) for r in rows] == [(v, g.floor(v), g.next(g.floor(v)), g.name("t", g.floor(v))) for v in some]
    ids = Grid("id", 1000, 7)
    big = 2**62 + 12345
    assert spark.range(1).select(ids.floor_col(F.lit(big)), ids.floor_col(F.lit(-1))).first()[:] == (ids.floor(big), ids.floor(-1))


def test_uuid_codec(spark):
    g, v = Grid("uuidv7", Step.of(days=1)), dt.datetime(2024, 2, 29, 12, 30, 1, 5999)
    assert g.decode(g.encode(v)) == dt.datetime(2024, 2, 29, 12, 30, 1, 5000)
    row = spark.range(1).select(g.encode_col(ntz(v)), uuid_ms_col(F.lit("ffffffff-ffff-7fff-bfff-ffffffffffff")), g.encode_col(F.lit(None).cast("timestamp_ntz"))).first()
    assert row[0] == g.encode(v) and row[1] == 2**48 - 1 and row[2] is None
    with pytest.raises(GridError):
        uuid_of(dt.datetime(1969, 12, 31))
    with pytest.raises(Exception, match="2\\*\\*48"):
        spark.range(1).select(g.encode_col(ntz(dt.datetime(1969, 12, 31)))).collect()


def test_names():
    ids = Grid("id", 10000)
    assert ids.name("t", 0) == "t_p0000000000000000000" == ids.name("t", 0, 10000)
    assert ids.name("t", 0, 50000) == "t_p0000000000000000000_to_0000000000000050000"
    lo = dt.datetime(2024, 3, 1)
    for step, label in ((Step(12), "2024"), (Step(1), "2024_03"), (Step.of(days=1), "2024_03_01"), (Step.of(hours=6), "2024_03_01_00"), (Step.of(minutes=5), "2024_03_01_0000")):
        assert Grid("time", step).name("t", lo) == f"t_p{label}"


@pytest.mark.parametrize("make", [lambda: Step(1, 5), lambda: Step(), lambda: Grid("hash", 5), lambda: Grid("id", Step(1)), lambda: Grid("time", 5), lambda: Grid("id", 0)])
def test_refused_definitions(make):
    with pytest.raises(GridError):
        make()


def test_refused_types():
    for kind, bad in (("id", T.DoubleType()), ("id", T.DecimalType(10, 2)), ("time", T.LongType()), ("uuidv7", T.LongType())):
        with pytest.raises(GridError):
            Grid(kind, 5 if kind == "id" else Step(1)).check_type(bad)
    Grid("id", 5).check_type(T.DecimalType(20, 0))
    assert literal(5) is not None

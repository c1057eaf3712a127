"""Catalog queries against their SQL, over the smallest sample tables where those are at hand."""

import os

import pytest

from timelineql import catalog

DATA = "/root/testdata/sf0.001"
SOME = ["a2_prefix", "a5_cells", "a6_columns", "c5_zero", "t2_any", "t8_every_simultaneously", "w4_self", "w6_every_right", "w12_outside_bounds", "g23_per_reference", "g24_sliding_rise", "flagship", "r2_pct", "r5_multi_query", "s5_smart_combine", "b3_labels", "p4_stringify_merged", "p5_stringify_durations", "p13_string_query", "p9_p12_string_operations", "p13_string_window", "p13_time_window", "p13_durations", "p16_cross_validate", "p2_bounds_by_person", "r3_mask", "i7_incidence_historical", "i7_incidence_two_events", "i2_washout", "i3_singles"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    want = c.execute(f"select {', '.join(chr(34) + x + chr(34) for x in got.columns)} from ({catalog.SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_every_query_of_rows_has_sql():
    assert set(catalog.ROWS) <= set(catalog.SQL) <= set(catalog.QUERIES)


#: Values of persons by time, one event a day: bases of 0 first, later, alone and after a negative one, and missing values.
BASES = [[0, 5, 4], [7, 0, 9], [0, 0], [0], [-3, 0, 2], [0, -3, 2], [-3, -6], [None, 0, None, 8], [None], [8, 9], [600, 5], [0.5, 400], [100, 99, 0.5]]


def equal_sql(spark, path, name, events):
    """Holds the query against its SQL over a table of (day of the month, user, type, value)."""
    import datetime as dt

    import duckdb

    rows = [(i, dt.datetime(2024, 1, day, 8), user, kind, None if v is None else float(v)) for i, (day, user, kind, v) in enumerate(events)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(path))
    want = c.execute(f"select {', '.join(chr(34) + x + chr(34) for x in got.columns)} from ({catalog.SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    return {r[0] for r in want}


@pytest.mark.parametrize("name,persons", [("g11_fall_relative", {0, 1, 2, 3, 4, 5, 7, 10, 12}), ("g11_rise_relative", {0, 1, 2, 3, 5, 7, 11}), ("g8_range_relative", {0, 1, 2, 3, 7, 10, 11, 12})])
def test_bases_of_zero(spark, tmp_path, name, persons):
    assert equal_sql(spark, tmp_path, name, [(1 + k, user, "purchase", v) for user, values in enumerate(BASES) for k, v in enumerate(values)]) == persons


def test_means_that_are_the_threshold(spark, tmp_path):
    """Added up by days the values of person 1 give a little over 50, and exactly, or in the order of the table, 50."""
    values = [63.91, 80.01, 34.84, 13.71, 29.61, 78.8, 27.58, 34.94, 41.86, 94.74]
    rows = [(8 + k, user, "view", v + (user == 2) * 0.01) for user in (1, 2) for k, v in enumerate(values)][::-1]
    assert equal_sql(spark, tmp_path, "g22_anchored_outside", [(1, 1, "error", 150), (1, 2, "error", 150), *rows]) == {2}


def test_sums_in_any_order(spark):
    """Sums and means of all events of a person are those of exact sums."""
    import math
    import random

    from pyspark.sql import functions as F

    from timelineql.operators import aggregates as G

    rng = random.Random(5)
    rows = [(g, round(rng.expovariate(0.02), 2) * (1 if g % 2 else rng.choice([-1, 1e4]))) for g in range(300) for _ in range(rng.randint(1, 80))]
    rows += [(300, None), (301, None), (301, 2.5), (302, 1e300), (302, 1e300), (303, float("inf")), (303, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    for r in df.groupBy("g").agg(*[G.plain(f, F.col("v"), False, zero=False).alias(f) for f in ("sum", "mean")]).collect():
        v = [x for g, x in rows if g == r["g"] and x is not None]
        want = (math.fsum(v), math.fsum(v) / len(v)) if v else (None, None)
        assert (r["sum"], r["mean"]) == want

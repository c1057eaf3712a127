"""Small logs with known answers; results, settings, several tables, batches."""

import datetime as dt

import pytest

import timelineql as tl


def log(spark, rows, columns="pid int, start_date date, icd string", **given):
    return tl.EventLog(spark.createDataFrame([(p, dt.date.fromisoformat(d), *rest) for p, d, *rest in rows], columns), **given)


def ids(df):
    return {r[0] for r in df.collect()}


SIMPLE = [(1, "2020-01-01", "K50"), (1, "2020-02-01", "K51"), (1, "2020-03-01", "K52"), (2, "2020-01-01", "K51"), (2, "2020-01-15", "K50"), (2, "2020-03-01", "K52"), (3, "2020-06-01", "K50"), (3, "2020-07-01", "K50"), (3, "2020-08-01", "K51")]
SHIFTED = [(1, "2020-01-01", "K51"), (1, "2020-05-15", "K50"), (2, "2020-02-01", "K51"), (2, "2020-02-20", "K50"), (3, "2020-03-01", "K51"), (3, "2020-03-10", "K50"), (4, "2020-01-10", "K50")]
EVERY = [(1, "2020-01-11", "K51"), (1, "2020-02-20", "K50"), (2, "2020-01-11", "K51"), (2, "2020-02-20", "K50"), (2, "2020-07-29", "K51"), (3, "2020-01-06", "K50"), (3, "2020-01-11", "K51"), (3, "2020-02-20", "K50"), (4, "2020-01-11", "K51"), (5, "2020-02-20", "K50")]
SHARES = [(1, "2020-01-01", "K50"), (1, "2020-01-10", "K51"), (1, "2020-01-20", "K52"), (2, "2020-01-01", "K51"), (2, "2020-01-10", "K50"), (3, "2020-01-01", "K50"), (4, "2020-01-01", "K51"), (5, "2020-01-01", "K52")]


@pytest.mark.parametrize("text,want", [
    ("K50", {1, 2, 3}), ("K52", {1, 2}), ("not K52", {3}), ("K50 before K51", {1, 3}), ("K50 after K51", {2}), ("K50 before K51 and K52", {1}), ("min 2 of K50", {3}), ("exactly 1 of K50", {1, 2}),
    ("1st of K50 before 1st of K51", {1, 3}), ("min 4 of event", set()), ("K50 after 1st event", {2}), ("(K50 or K52) before K51", {1, 3}), ("ZZZ", set()),
])
def test_simple(spark, text, want):
    assert ids(tl.query(log(spark, SIMPLE), text).pids) == want


@pytest.mark.parametrize("rows,text,want", [
    (SHIFTED, "1st K51 before 1st K50 - 100 days", {1}), (SHIFTED, "1st K51 before 1st K50 - 50 days - 50 days", {1}), (SHIFTED, "1st K50 before 1st K51 + 30 days", {2, 3}), (SHIFTED, "K50 inside 200 days after 1st K51 - 30 days", {1, 2, 3}),
    (EVERY, "K50 after K51", {1, 2}), (EVERY, "K50 after every K51", {1, 3}), (EVERY, "every K50 after every K51", {1}), (EVERY, "every K50 before K51", {2}), (EVERY, "every K50 before every K51", set()),
    (EVERY, "K50 inside 100 days after every K51", {1, 3}), (EVERY, "every K50 inside 100 days after K51", {1, 2}), (EVERY, "every K50 inside 100 days after every K51", {1}), (EVERY, "not (K50 after every K51)", {2, 4, 5}),
])
def test_shifts_and_quantifiers(spark, rows, text, want):
    assert ids(tl.query(log(spark, rows), text).pids) == want


def test_results(spark):
    r = tl.query(log(spark, SIMPLE), "K50 before K51")
    assert (r.count, r.total, r.evaluable) == (2, 3, 3) and r.pct() == pytest.approx(200 / 3)
    assert ids(r.filter("persons").select("pid")) == {1, 3} and r.filter("persons").count() == 6 and r.filter("rows").count() == 3
    assert {(x["pid"], x["n"]) for x in r.event_counts.collect()} == {(1, 1), (2, 0), (3, 2)}
    assert r.rows.where("match").count() == 3 and {(x["pid"], x["match"]) for x in r.persons.collect()} == {(1, True), (2, False), (3, True)}
    assert r.mask("2nd of K50").where("m0").count() == 1 and r.mask("K52", "persons").where("m0").count() == 6
    assert "2 of 3 persons" in r.summary()
    with pytest.raises(ValueError):
        r.filter("columns")


@pytest.mark.parametrize("text,n,answers,pct,marginal", [("K50", 3, 5, 60, 60), ("K50 before K51", 1, 2, 50, 20), ("(K50 before K51) and K52", 1, 2, 50, 20), ("(K50 before K51) or K52", 2, 5, 40, 40), ("K50 before ZZZ", 0, 0, 0, 0), ("not (K50 before K51)", 4, 5, 80, 80), ("K50 inside 20 days after 1st K51 + 0 days", 1, 2, 50, 20)])
def test_percentages(spark, text, n, answers, pct, marginal):
    r = tl.query(log(spark, SHARES), text)
    assert (r.count, r.evaluable, r.pct(), r.pct(False)) == (n, answers, pct, marginal)


def test_errors(spark):
    lg = log(spark, [(1, "2020-01-01", "K50", 1.0)], "pid int, start_date date, icd string, dose double")
    for text in ("1st K50 + 3 days before K51", "K50 inside 3 events after 1st K51 + 3 days", "K50 inside 1st K51 + 3 days", "every K50 inside 3 events after K51", "sum(dose) > 3 outside 5 days after every K50"):
        with pytest.raises(tl.UnsupportedError):
            tl.query(lg, text)
    for text in ("nothing > 3", "sum(icd) > 3"):
        with pytest.raises(tl.ColumnError):
            tl.query(lg, text).count
    with pytest.raises(tl.CodeError):
        tl.query(lg, "@unknown").count
    with pytest.raises(tl.CodeError):
        tl.query(lg, "Z* before K50", strict=True)
    with pytest.raises(tl.ColumnError):
        tl.query(lg.df, "K50", pid="nobody")
    assert tl.query(lg, "Z* before K50", strict=False).count == 0


def test_cells_columns_and_dates(spark):
    df = spark.createDataFrame([(1, "2020-01-01 10:00:00", "K50, K51", "a"), (1, "2020-01-01 09:00:00", "K501", None), (2, "not a date", None, "K50"), (None, "2020-01-01", "K50", "a")], "pid int, start_date string, icd1 string, icd2 string")
    assert tl.query(df, "K51", sep=",").filter("rows").count() == 1 and ids(tl.query(df, "K50", sep=",").pids) == {1, 2}
    assert ids(tl.query(df, "K50 in icd2").pids) == {2} and ids(tl.query(df, "K50, K501 in icd1:icd2").pids) == {1, 2} and tl.query(df, "K50 in other").count == 0
    assert tl.query(df, "K501 before a").count == 0 and tl.query(df, "K501 simultaneously a").count == 1  # days, not times
    arrays = spark.createDataFrame([(1, dt.date(2020, 1, 1), ["K50", "X"]), (2, dt.date(2020, 1, 1), None)], "pid int, start_date date, icd array<string>")
    assert ids(tl.query(arrays, "X").pids) == {1}


def test_several_tables(spark):
    npr = log(spark, SIMPLE).df
    rx = spark.createDataFrame([("1", "2020-02-15", "L04AB02"), ("2", "2020-01-20", "L04AB04"), ("3", "bad", "L04AB02")], "pid string, start_date string, atc string")
    with pytest.warns(UserWarning):
        both = tl.combine({"npr": npr, "rx": rx})
    assert both.count() == 12 and both.where("__source__ = 'rx' and start_date is null").count() == 1
    with pytest.warns(UserWarning):
        r = tl.query([npr, rx], "K50 in icd before L04AB* in atc")
        assert ids(r.pids) == {"1", "2"} and r.total == 3
        assert "In(icd" not in r.pids._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        tl.combine([])
    with pytest.raises(ValueError):
        tl.combine([npr], ["a", "b"])


def test_scan_filters_reach_parquet(spark, tmp_path):
    log(spark, SIMPLE).df.write.parquet(str(tmp_path / "e"))
    r = tl.query(spark.read.parquet(str(tmp_path / "e")), "K50* before K51")
    plan = r.pids._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(icd,K50)" in plan and plan.count("Exchange") == 1
    plan = tl.query(spark.read.parquet(str(tmp_path / "e")), "every K50 inside 9 days around K51 and not 2nd K52", tie=["icd"]).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_batches(spark):
    lg = log(spark, SIMPLE)
    assert tl.multi_query(lg, "K5?[0,1,2] before K51") == {"K50 before K51": 2, "K51 before K51": 0, "K52 before K51": 0}
    assert tl.multi_query(lg, "min ?[1,2] of K50") == {"min 1 of K50": 3, "min 2 of K50": 1}
    assert tl.multi_query(lg, "K50 inside ?[20-21] days before K5?[1-1]") == {"K50 inside 20 days before K51": 0, "K50 inside 21 days before K51": 0}
    assert tl.multi_query(lg, "?[K50,)] or K51") == {"K50 or K51": 3, ") or K51": 0}
    with pytest.raises(ValueError):
        tl.multi_query(lg, "K?[0-99]?[0-99]")


def test_config(spark):
    df = log(spark, SIMPLE).df.withColumnsRenamed({"pid": "person", "start_date": "day"})
    before = tl.get_config()
    tl.use(tl.Config(pid="person", date="day", variables={"x": ["K50", "K5*"]}))
    try:
        assert tl.query(df, "@x").filter("rows").count() == 9 and tl.query(df, "@x", variables={"x": "K52"}).count == 2
        assert tl.count_persons(df, "K52") == 2 and tl.event_counts(df, "K52").count() == 3
    finally:
        tl.use(before)
    tl.set_backend("spark")
    tl.set_backend(None)
    with pytest.raises(ValueError):
        tl.Config(backend="other")
    lg = log(spark, SIMPLE)
    assert tl.query(lg.period("2020-02-01", "2020-06-30"), "event").filter("rows").count() == 4 and tl.query(lg.year(2021), "event").count == 0


def test_standing_query(spark, tmp_path):
    from timelineql.streaming.continuous import standing_query

    source, got = str(tmp_path / "in"), {}
    df = log(spark, SIMPLE).df
    for k, part in enumerate((df.where("icd <> 'K51'"), df.where("icd = 'K51'"))):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        q = standing_query(stream, "K50 before K51", str(tmp_path / "log"), lambda out, n: got.update({r["pid"]: r["match"] for r in out.collect()}), tl.Config(), str(tmp_path / "check"), available_now=True)
        q.awaitTermination()
        assert got == ({1: False, 2: False, 3: False} if k == 0 else {1: True, 2: False, 3: True})


def test_methods_of_a_log(spark):
    lg = log(spark, SIMPLE)
    assert lg.count("K52") == 2 and lg.pct("K52", dropna=False) == pytest.approx(200 / 3) and lg.multi("K5?[2,3]") == {"K52": 2, "K53": 0}
    assert lg.mask("K52").where("match").count() == 2 and lg.mask("K52", "persons").where("match").count() == 6 and lg.event_counts("K50").where("n = 2").count() == 1
    assert lg.raw_incidence() == {2020: 3} and lg.stringify_order({"a": "K50", "b": "K51"}).count() == 3 and lg.cross_validate("K50 before K51", {"a": "K50", "b": "K51"}).match
    assert lg.labels().where("icd_label = 'Diseases of the digestive system'").count() == 9 and lg.count_codes().first()["code"] == "K50" and [e["code"] for e in lg.search_codes("nervous", "icd10")] == ["G00-G99"]
    with pytest.raises(AttributeError):
        lg.nothing


def test_dates_that_are_none_and_ids_that_are_null(spark):
    rows = [(1, "2020-01-05", "K50"), (1, "no date", "K51"), (1, "2021-02-01", "K51"), (None, "2020-03-01", "K50"), (None, "2020-04-01", "K51"), (2, None, "K50"), (2, "2020-06-01", "K51")]
    log = tl.EventLog(spark.createDataFrame(rows, "pid long, start_date string, icd string"), pid="pid", date="start_date", cols="icd")
    assert [r["icd"] for r in log.period("2020-01-01", "2020-12-31").df.orderBy("start_date").collect()] == ["K50", "K50", "K51", "K51"]
    assert log.year(2021).df.count() == 1
    r = log.query("K50 before K51")
    assert [x["pid"] for x in r.filter("rows").collect()] == [1] and {x["pid"] for x in r.filter().collect()} == {1}
    assert r.rows.count() == len(rows) and r.rows.where("pid is null and match").count() == 0
    assert r.mask("K50", "persons").where("pid is null").select("match", "m0").distinct().collect() == [(False, False)]
    assert log.query("not K50").rows.where("pid is null and match").count() == 0
    ends = tl.EventLog(log.df.withColumn("stop", log.df["start_date"]), log.config)
    tracks = tl.stringify_durations(ends, {"a": "K50", "b": "K51"}, event_end="stop", step=30).orderBy("pid").collect()
    assert [x["pid"] for x in tracks] == [1, 2]
    assert tl.stringify_order(ends, {"a": "K50", "b": "K51"}, last_date="stop").orderBy("pid").collect() == [(1, "ab"), (2, "b")]


def test_made_up_data(spark):
    df = tl.make_test_data(spark, n_persons=50, events_per_person=6, codes=("K50", "X1"), start_year=2019, end_year=2020, seed=3)
    assert df.columns == ["pid", "start_date", "icd", "dose", "dose_k"] and df.select("pid").distinct().count() == 50 and 150 < df.count() < 450
    got = df.agg({"start_date": "min"}).collect()[0][0].year, df.agg({"start_date": "max"}).collect()[0][0].year
    assert set(got) <= {2019, 2020} and {r["icd"] for r in df.select("icd").distinct().collect()} == {"K50", "X1"}
    assert df.where("dose_k is null and icd = 'K50' or dose_k is not null and icd = 'X1'").count() == 0
    assert tl.query(df, "K50 before X1", cols="icd").count > 0

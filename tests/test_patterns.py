"""Pattern strings, the string evaluator, code books and incidence."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import timelineql as tl
from timelineql.errors import ColumnError, PatternStringError
from timelineql.functions import codebook as B
from timelineql.functions import stringops as S
from timelineql.functions.codes import distinct_codes, label_of, route_columns
from timelineql.operators import incidence as I
from timelineql.operators import stringeval as V
from timelineql.operators import stringify as T

CODES = {"i": "L04AB02", "a": ["L04AB04"], "g": "L04AB06*"}


def log(spark, rows, columns="pid int, start_date date, atc string", **given):
    return tl.EventLog(spark.createDataFrame([(p, dt.date.fromisoformat(d) if d else None, *rest) for p, d, *rest in rows], columns), **given)


def strings(df):
    return {r[0]: r["pattern"] for r in df.collect()}


@pytest.fixture(scope="module")
def drugs(spark):
    rows = [(1, "2020-01-01", "L04AB02"), (1, "2020-04-01", "L04AB02"), (1, "2020-07-01", "L04AB04"), (1, "2020-10-01", "L04AB02"), (2, "2020-01-01", "L04AB04"), (2, "2020-04-01", "L04AB02"), (2, "2020-07-01", "L04AB06"), (2, None, "L04AB02"), (None, "2020-01-01", "L04AB02"), (3, "2020-01-01", "X")]
    return log(spark, rows)


def test_order(drugs):
    assert strings(T.stringify_order(drugs, CODES)) == {1: "iiai", 2: "aig"}
    assert strings(T.stringify_order(drugs, CODES, keep_repeats=False)) == {1: "iai", 2: "aig"}
    assert strings(T.stringify_order(drugs, CODES, only_unique=True)) == {1: "ia", 2: "aig"}
    assert strings(T.stringify_order(drugs, CODES, first_date="2020-03-01")) == {1: "iai", 2: "ig"}
    assert strings(T.stringify_order(drugs, CODES, first_date={1: "2020-05-01"}, last_date=dt.date(2020, 8, 1))) == {1: "a"}


def test_time_and_durations(spark, drugs):
    tracks = {r["pid"]: (r["i"], r["a"], r["g"]) for r in T.stringify_time(drugs, CODES, no_event="-", merge=False).collect()}
    assert tracks == {1: ("ii-i", "--a-", "-"), 2: ("-i-", "a--", "--g")}
    assert strings(T.stringify_time(drugs, CODES, no_event="-")) == {1: "i--|i--|-a-|i--", 2: "-a-|i--|--g"}
    d = log(spark, [(1, "2020-01-01", "L04AB02", 250, dt.date(2020, 9, 7)), (1, "2020-06-01", "L04AB04", 0, dt.date(2020, 6, 1))], "pid int, start_date date, atc string, days int, end date")
    want = [{"pid": 1, "i": "iii", "a": "-a-", "g": "-"}]
    for kind in ({"event_duration": "days"}, {"event_end": "end"}):
        assert [r.asDict() for r in T.stringify_durations(d, CODES, no_event="-", merge=False, **kind).collect()] == want
    with pytest.raises(ValueError):
        T.stringify_durations(d, CODES)
    with pytest.raises(ColumnError):
        T.stringify_durations(d, CODES, event_end="nothing")


def test_string_operations(spark):
    df = spark.createDataFrame([("ac", "bd  e"), ("i a", "x"), ("aabca", None), ("", "b")], "a string, b string")
    got = df.select(S.interleave(["a", "b"]), S.overlay(["a", "b"]), S.shorten(F.col("a"), 2), S.del_repeats(F.col("a")), S.del_singles(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("ab|cd|  |  | e", "xx  e", "a", "ac", ""), ("ix|  |a ", "x a", "ia", "i a", ""), ("a |a |b |c |a ", "aabca", "aba", "abca", "aa"), (" b", "b", "", "", "")]
    assert [r["a"] for r in S.left_justify(df, "a", "_").collect()] == ["ac___", "i a__", "aabca", "_____"]


def test_string_queries(drugs):
    assert [r["pid"] for r in V.string_query_auto(drugs, "L04AB02 before L04AB04", CODES).collect()] == [1]
    assert {r["pid"] for r in V.string_query_auto(drugs, "L04AB* inside 1 to 200 days after L04AB04", CODES, "time").collect()} == {1, 2}
    order = T.stringify_order(drugs, CODES)
    assert {r["pid"]: r["places"] for r in V.StringEvaluator(order, CODES).matches("last 2 of L04AB02").collect()} == {1: [1, 3], 2: [1]}
    assert [r["pid"] for r in V.string_query("L04AB04 inside 1 events before L04AB02", order, CODES).collect()] == [1, 2]
    for text, mode in [("event", "order"), ("sum(v) > 1", "order"), ("L04AB02 simultaneously L04AB04", "order"), ("L04AB02 inside 9 days", "order"), ("every L04AB02 before L04AB04", "order"), ("L04AB02 inside 2 events after L04AB04", "time"), ("K50 between K51 and K52", "order")]:
        with pytest.raises(PatternStringError):
            V.string_query_auto(drugs, text, CODES, mode).collect()
    with pytest.raises(ValueError):
        V.string_query_auto(drugs, "L04AB02", CODES, "other")


@pytest.mark.parametrize("text", ["K50", "K50 before K51", "K50 after K51", "K50 and K51", "K50 or K52", "not K50", "min 2 of K5*", "2-3 of K50", "2nd K50", "-1st K51 after K50", "first 2 of K51 before K52", "K50 inside 2 events after K51", "K51 outside 1 events before K50", "not (K50 before K51)"])
def test_two_evaluators_agree(spark, text):
    rng = random.Random(9)
    rows = [(p, str(dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 30))), rng.choice(["K50", "K51", "K52"])) for p in range(80) for _ in range(rng.randint(1, 6))]
    lg = log(spark, rows)
    lg = tl.EventLog(lg.df.withColumn("k", F.monotonically_increasing_id()).cache(), tie=["k"])
    found = V.cross_validate(lg, text, {"a": "K50", "b": "K51", "c": "K52"})
    assert found.match, text


def test_codebook(spark, drugs, tmp_path):
    (tmp_path / "own.csv").write_text("code,label\nQ1,mine\nL04AB02,other\n")
    (tmp_path / "none.csv").write_text("x,y\n1,2\n")
    b = B.get_codebook(str(tmp_path))
    assert b.label("Q1") == "mine" and b.label("L04AB02") == "Infliximab" and b.label("L04AB99") == b.label("L04AB") and b.label("K50.1") == "Diseases of the digestive system" and b.label("9") is None and b.label(None) is None
    assert [e["code"] for e in b.search("DIAB.*")] == ["A10"] and b.search("diab", "icd10") == [] and {e["code"] for e in b.get("L04A*")} == {"L04A", "L04AA23", "L04AA33", "L04AB", "L04AB02", "L04AB04", "L04AB06", "L04AC05"} and len(b.get("A00-C99")) > 3
    df = spark.createDataFrame([(c,) for c in ["Q1", "K50.1", "L04AB99", "9", None, "L04", "H5"]], "c string")
    assert all(r["l"] == b.label(r["c"]) for r in df.select("c", b.column(F.col("c")).alias("l")).collect())
    assert {r["atc_label"] for r in B.labelled(drugs, book=b).where("pid = 1").collect()} == {"Infliximab", "Adalimumab"}
    assert [tuple(r) for r in B.count_codes(drugs).collect()][:2] == [("L04AB02", 6), ("L04AB04", 2)] and [tuple(r) for r in B.count_codes(drugs, per_person=True, pattern="L04AB0*").collect()] == [("L04AB02", 2), ("L04AB04", 2), ("L04AB06", 1)]
    assert len(b.get("A-Z")) >= 51 + 22 and [b.label(c) for c in ("A10BA02", "B01AF01", "C10AA05", "J01CR02", "N06AB03")] == [b.label(c) for c in ("A10BA", "B01AF", "C10AA", "J01CR", "N06A")]
    B.reset_codebook()


def test_code_helpers(spark):
    columns = ["pid", "icd1", "icd10", "icd2", "main"]
    assert route_columns(["icd*"], columns) == ["icd1", "icd10", "icd2"] and route_columns(["icd10:main", "icd1"], columns) == ["icd10", "icd2", "main", "icd1"] and route_columns(["icd1-icd10", "nothing"], columns) == ["icd1", "icd10"]
    df = spark.createDataFrame([("K50; K51", None), (None, "X"), ("K52", "K50")], "a string, b string")
    assert [r["code"] for r in distinct_codes(df, ["a", "b"], ";").collect()] == ["K50", "K51", "K52", "X"]
    assert [r[0] for r in df.select(label_of(df, {"x": "K51", "y": ["K5*", "X"]}, ["a", "b"], ";")).collect()] == ["x", "y", "y"]


def test_incidence_counts(spark):
    lg = log(spark, [(1, "2016-05-01", "K50"), (1, "2018-03-01", "K50"), (2, "2018-06-01", "K50"), (3, "2018-01-05", "K50"), (3, "2019-01-01", "K50"), (4, "2019-02-01", "X"), (5, None, "K50")])
    assert I.raw_incidence(lg) == {2016: 1, 2018: 2, 2019: 1} and I.raw_incidence(lg, "K50", required_events=2) == {2016: 1, 2018: 1}
    assert I.washout_pattern(lg, "K50", year=2018, step_days=400) == {0: 3.0, 400: 3.0, 610: 2.0}
    assert I.washout_pattern(lg, "K50", year=2018, step_days=400, pct=True)[610] == pytest.approx(2 / 3)
    assert set(I.washout_pattern(lg, "K50")) == {2018, 2019} and I.washout_pattern(lg, "ZZ") == {} and I.raw_incidence(lg, "ZZ") == {} and I.incidence(lg, "ZZ") == {}
    assert I.singles_pattern(lg, "K50", year=2018, step_days=1) == {0: 3.0, 1: 2.0}
    for bad in ({"washout": "x"}, {"lookahead": "x"}):
        with pytest.raises(ValueError):
            I.incidence(lg, **bad)


def test_decay_is_recovered():
    days = np.arange(0, 3000, 200)
    fit = I.fit_decay(dict(zip(days.tolist(), 0.3 + 0.7 * np.exp(-1.5 * days / 365.25))))
    assert fit["coeffs"] == pytest.approx([0.3, 1.5], abs=1e-4) and fit["asymptote"] == pytest.approx(0.3) and fit["r2"] == pytest.approx(1) and fit["predict"]([0])[0] == pytest.approx(1)
    assert set(I.fit_decay({1999: {0: 1.0, 200: 0.8, 400: 0.7, 600: 0.66}, 2000: {0: 1.0, 200: 0.7, 400: 0.65}}, "all")) == {"exponential", "hyperbolic", "rational"}
    with pytest.raises(ValueError):
        I.fit_decay({}, "exponential")
    with pytest.raises(ValueError):
        I.fit_decay({0: 1.0}, "other")


def test_incidence_corrects_a_short_history(spark):
    """200 new persons a year since 2000, each with visits for years: counting from 2010 on, the first years look too high."""
    rng = random.Random(2)
    rows = []
    for p in range(200 * 21):
        day = dt.date(2000 + p // 200, 1, 1).toordinal() + rng.randint(0, 364)
        while day < dt.date(2020, 1, 1).toordinal() and rng.random() < 0.9:
            if day >= dt.date(2010, 1, 1).toordinal():
                rows.append((p, str(dt.date.fromordinal(day)), "K50"))
            day += rng.randint(100, 900)
    lg = log(spark, rows)
    raw, found = I.raw_incidence(lg), I.incidence(lg)
    spread = lambda x: max(x.values()) / min(x.values())
    assert set(raw) == set(found) == set(range(2010, 2020)) and raw[2010] > 300 and spread(found) < spread(raw) and found[2010] < raw[2010]
    assert all(v >= 0 for v in I.incidence(lg, required_events=2, washout="historical", lookahead="historical").values())


def test_codebook_has_all_codes():
    B.reset_codebook()
    b = B.get_codebook()
    atc = [e for e in b.entries if e["system"] == "atc"]
    assert len(atc) == 54 and b.label("A10BA02") == "Biguanides" and b.label("L04AC05") == "Ustekinumab" and b.label("N06AB10") == "Antidepressants"
    assert len(b.get("L04A*")) == 8 and {e["code"] for e in b.search("statin")} == {"C10AA"} and {e["level"] for e in atc} == {"1", "2", "3", "4", "5"}

"""The compiler against the plain evaluator, row by row, over random timelines with ties, nulls and missing dates."""

import datetime as dt
import random

import pytest

import timelineql as tl
from timelineql.plans.compiler import RowPlan
from timelineql.plans.parser import parse

from brute import Person

ATOMS = ["K50", "K51", "K50*", "K50-K51", "X, K52", "event", "dose > 50", "dose != 50"]
TEMPORAL = [f"{a} {op} {b}" for op in ("before", "after", "simultaneously") for a, b in [("K50", "K51"), ("any K50", "any K51"), ("K50", "any K51"), ("any K50", "K51"), ("every K50", "K51"), ("K50", "every K51"), ("every K50", "every K51"), ("every K50", "any K51"), ("any K50", "every K51")]]
SHIFTS = ["K50 before 1st K51 + 10 days", "K50 after -1st K51 - 5 days - 5 days", "K50 simultaneously 1st K51 + 3 days", "every K50 simultaneously 1st event + 0 days", "K50 inside 20 days after 1st K51 - 10 days", "K50 inside 1st K51 - 10 days to 1st K51 + 20 days", "K50 inside 0 to 5 days around 1st K50 + 2 days"]
LOGIC = ["K50 and K51", "K50 or K51", "not K50", "never (K50 before K51)", "(K50 or K51) before K52", "not K50 and X", "(K50 and K51) before X", "not K50 before K51"]
COUNTS = [f"{p} of K50*" for p in ("min 2", "max 2", "exactly 1", "exactly 0", "min 0", "max 0", "1-2", "0-1", "1st", "2nd", "-1st", "-2nd", "first 2", "last 2")] + ["last 3 events", "min 2 of (K50 inside 30 days after K51)", "2nd (K50 or K51) before X"]
WINDOWS = [f"K50* {w}" for w in (
    "inside 20 days after K51", "inside 10 to 40 days after K51", "inside 20 days before K51", "inside 20 days around K51", "inside 5 to 20 days around K51", "inside -5 to 20 days around K51",
    "inside 30 days", "inside 5 to 30 days", "outside 20 days after K51", "outside 30 days", "inside 20 days after K50*", "inside 0 days around K50*", "inside 20 days after every K51", "outside 20 days around K51",
    "inside 2 events after K51", "inside 2 events before K51", "inside 2 events around K51", "inside 0 to 2 events after K50*", "outside 2 events after K51", "inside -1 to 2 events around K50*", "inside 1 to 1 events before event",
    "inside 1st K51 to 2nd K51", "outside 1st K51 to -1st K51", "inside last 3 events", "outside first 2 K51", "between K51 and X", "inside K51",
)] + ["every K50 inside 20 days after K51", "every K50 inside 20 days around every K51", "K50 outside 20 days after every K51", "every K50 inside 30 days", "K50 inside 10 days after (K51 before X)"]
FUNCS = ["sum(dose) > 100", "mean(dose) < 50", "min(dose) <= 10", "max(dose) >= 90", "median(dose) > 50", "sd(dose) > 20", "var(dose) < 900", "count(dose) == 2", "range(dose) > 40", "rise(dose) > 30", "fall(dose) > 30", "rise(dose) > 50%", "fall(dose) >= 40%", "range(dose) > 100%", "rise(dose) < 20", "sum(dose) != 0", "n(dose) == 0", "avg(dose) >= 0"]
AGGREGATES = FUNCS + [f"{f} {w}" for f in FUNCS for w in ("inside 15 days", "inside 3 events", "inside 20 days after K51", "inside 20 days around every K51", "inside 3 to 20 days around every K51", "outside 20 days after K51", "inside 2 events after K51", "outside 2 events around K51")] + ["rise(dose) > 10 inside 0 days", "(sum(dose) > 50) before K51", "sum(dose) > 20 inside 10 days after 1st K51 + 5 days"]
GROUPS = {"atoms": ATOMS + LOGIC, "temporal": TEMPORAL, "shifts": SHIFTS, "counts": COUNTS, "windows": WINDOWS, "aggregates": AGGREGATES}
START = dt.date(2020, 1, 1)


def timelines(seed, persons=60):
    rng = random.Random(seed)
    rows = []
    for p in range(persons):
        for _ in range(rng.randint(1, 10)):
            day = None if rng.random() < 0.04 else rng.randint(0, 60)
            dose = None if rng.random() < 0.3 else float("nan") if rng.random() < 0.03 else float(rng.choice([0, 5, 10, 50, 50, 60, 75, 90, 100]))
            rows.append((p, day, len(rows), rng.choice(["K50", "K50.1", "K51", "K52", "X", None]), dose))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = timelines(7)
    df = spark.createDataFrame([(p, None if d is None else START + dt.timedelta(d), k, c, v) for p, d, k, c, v in rows], "pid int, start_date date, k int, icd string, dose double")
    people = {}
    for p, d, k, c, v in rows:
        people.setdefault(p, []).append({"day": d, "k": k, "icd": c, "dose": None if v is None or v != v else v})
    for events in people.values():
        events.sort(key=lambda e: (e["day"] is None, e["day"] or 0, e["k"]))
    return tl.EventLog(df.repartition(3).cache(), tie=["k"]), {p: Person(e) for p, e in people.items()}


@pytest.mark.parametrize("group", GROUPS)
def test_rows(data, group):
    log, people = data
    texts = GROUPS[group]
    for at in range(0, len(texts), 12):
        some = texts[at : at + 12]
        plan = RowPlan(log)
        nodes = [parse(t) for t in some]
        columns = [plan.mask(n) for n in nodes]
        answers = [plan.evaluable(n) for n in nodes]
        got = plan.df.select("pid", "k", *[c.alias(f"m{i}") for i, c in enumerate(columns)], *[c.alias(f"a{i}") for i, c in enumerate(answers)]).collect()
        want = {n: {p: (person.mask(n), person.evaluable(n)) for p, person in people.items()} for n in nodes}
        for r in got:
            i = next(i for i, e in enumerate(people[r["pid"]].e) if e["k"] == r["k"])
            for j, n in enumerate(nodes):
                mask, answer = want[n][r["pid"]]
                assert r[f"m{j}"] is mask[i], (some[j], r["pid"], i, people[r["pid"]].e, mask)
                assert r[f"a{j}"] is answer, (some[j], r["pid"], "evaluable")


@pytest.mark.parametrize("text", ATOMS + LOGIC + TEMPORAL[:4] + TEMPORAL[9:13] + COUNTS[:8] + WINDOWS[:1] + FUNCS[:4] + SHIFTS[:1])
def test_persons(data, text):
    """The grouped plan and the scan filter find the same persons."""
    log, people = data
    node = parse(text)
    assert {r["pid"] for r in tl.query(log, text).pids.collect()} == {p for p, person in people.items() if any(person.mask(node))}

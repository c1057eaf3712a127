"""Every operator as a named query over the sample tables, with the same question in join-style SQL.

The SQL is written from the rules, row against row, and shares nothing with the compiler but the question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import query
from .functions import codebook as B
from .functions import stringops as S
from .functions.codes import distinct_codes, label_of
from .operators import incidence as I
from .operators import stringeval as V
from .operators import stringify as T
from .operators.batch import multi_query
from .sources.eventlog import EventLog, combine

Query = Callable[[SparkSession, str], DataFrame]

EVENTS = """
select event_id, user_id, ts, (ts::date - date '1970-01-01')::int as day, value, case when event_type = 'purchase' then value end as paid, event_type,
  event_type || case when value >= 100 then '.hi' when value < 10 then '.lo' else '' end as code, row_number() over (partition by user_id order by ts, event_id) as pos
from events
"""


def events(spark: SparkSession, d: str, **given) -> EventLog:
    df = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    kind = F.when(F.col("value") >= 100, ".hi").when(F.col("value") < 10, ".lo").otherwise("")
    df = df.withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value"))).withColumn("code", F.concat("event_type", kind))
    return EventLog(df, **({"pid": "user_id", "date": "ts", "cols": "code", "tie": ["event_id"], "variables": {"big": ["purchase.hi", "sign*"]}} | given))


def rows(text: str, **given) -> Query:
    """(user_id, n_rows, sum_ids): the matching rows by person, pinned down by their ids."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = query(events(spark, d, **given), text).filter("rows")
        return hits.groupBy("user_id").agg(F.count("*").alias("n_rows"), F.sum("event_id").alias("sum_ids"))

    return run


def sql(where: str, more: str = "") -> str:
    return f"with e as ({EVENTS}){more} select r.user_id, count(*) as n_rows, sum(r.event_id)::bigint as sum_ids from e r where {where} group by r.user_id"


def some(test: str, a: str = "x") -> str:
    """That the person of r has such an event."""
    return f"exists (select 1 from e {a} where {a}.user_id = r.user_id and {test})"


def agg(what: str, test: str) -> str:
    return f"(select {what} from e x where x.user_id = r.user_id and {test})"


def code(c: str, a: str) -> str:
    return f"{a}.code = '{c}'"


def near(ref: str, band: str, a: str = "r", z: str = "z", own: bool = False) -> str:
    """That a has an event of ref, not itself, with the band on gap = days of a after it."""
    return f"exists (select 1 from e {z} where {z}.user_id = {a}.user_id and {code(ref, z)} and {band.replace('gap', f'({a}.day - {z}.day)')}" + ("" if own else f" and {z}.event_id <> {a}.event_id") + ")"


def placed(ref: str, low: int, high: int, a: str = "r", own: bool = False) -> str:
    return f"exists (select 1 from e z where z.user_id = {a}.user_id and {code(ref, 'z')} and {a}.pos - z.pos between {low} and {high}" + ("" if own else f" and z.event_id <> {a}.event_id") + ")"


def first(c: str) -> str:
    return agg("min(x.day)", code(c, "x"))


def last(c: str) -> str:
    return agg("max(x.day)", code(c, "x"))


A, Z, Y = "click.hi", "error.hi", "purchase.hi"
a_r = code(A, "r")
n_a = agg("count(*)", code(A, "x"))
before_a = f"(select count(*) from e x where x.user_id = r.user_id and {code(A, 'x')} and x.pos <= r.pos)"
ALL = "x.user_id = x.user_id"
inside_z = near(Z, "gap between 0 and 3", "x", own=True)
_rise = """, s as (select user_id, value - min(value) over (partition by user_id order by ts, event_id) as up, max(value) over (partition by user_id order by ts, event_id) - value as down,
 (value - min(value) over (partition by user_id order by ts, event_id)) / min(value) over (partition by user_id order by ts, event_id) as up_by,
 (max(value) over (partition by user_id order by ts, event_id) - value) / max(value) over (partition by user_id order by ts, event_id) as down_by from e)"""
slide = "(select {0} from e x where x.user_id = w.user_id and x.day between w.day - {1} and w.day)"
per_ref = f"{some(code(Z, 'x'))} and not exists (select 1 from e w where w.user_id = r.user_id and {code(Z, 'w')} and not coalesce((select {{0}} from e x where x.user_id = w.user_id and x.day - w.day between 0 and 3), false))"
per_ref_around = per_ref.replace("x.day - w.day between 0 and 3", "abs(x.day - w.day) between 2 and 3")

_near_error = code(A, "x") + " and exists (select 1 from e z where z.user_id = x.user_id and z.code like 'error%' and x.day - z.day between 0 and 3)"

#: name: (query, SQL test of a row r of e, more tables)
ROWS: dict[str, tuple] = {
    "a1_code": ("click", "r.code = 'click'"),
    "a1_codes": ("click, purchase.hi", "r.code in ('click', 'purchase.hi')"),
    "a2_prefix": ("click*", "r.code like 'click%'"),
    "a3_range": ("click-error.hi", "r.code between 'click' and 'error.hi'"),
    "a4_variable": ("@big", "r.code = 'purchase.hi' or r.code like 'sign%'"),
    "a6_columns": ("click in event*", "r.event_type = 'click'"),
    "a7_event": ("event", "true"),
    "a8_comparison": ("value >= 99.5", "r.value >= 99.5"),
    "a8_comparison_null": ("paid != 50", "r.paid <> 50"),
    "l1_and": (f"{A} and {Z}", f"r.code in ('{A}', '{Z}') and {some(code(A, 'x'))} and {some(code(Z, 'x'))}"),
    "l2_or": (f"{A} or {Z}", f"r.code in ('{A}', '{Z}')"),
    "l3_not": (f"not {A}", f"not {some(code(A, 'x'))}"),
    "c1_min": (f"min 3 of {A}", f"{a_r} and {n_a} >= 3"),
    "c2_max": (f"max 2 of {A}", f"{a_r} and {n_a} <= 2"),
    "c3_exactly": (f"exactly 2 of {A}", f"{a_r} and {n_a} = 2"),
    "c4_count_range": (f"2-3 of {A}", f"{a_r} and {n_a} between 2 and 3"),
    "c5_zero": (f"0-1 of {A}", f"({a_r} and {n_a} = 1) or {n_a} = 0"),
    "c6_nth": (f"2nd {A}", f"{a_r} and {before_a} = 2"),
    "c7_nth_last": (f"-2nd {A}", f"{a_r} and {n_a} - {before_a} = 1"),
    "c8_first": (f"first 2 of {A}", f"{a_r} and {before_a} <= 2"),
    "c9_last": (f"last 2 of {A}", f"{a_r} and {n_a} - {before_a} < 2"),
    "t1_before": (f"{A} before {Z}", f"{a_r} and {first(A)} < {first(Z)}"),
    "t1_after": (f"{A} after {Z}", f"{a_r} and {first(A)} > {first(Z)}"),
    "t2_any": (f"any {A} before any {Z}", f"{a_r} and {first(A)} < {last(Z)}"),
    "t2_any_after": (f"any {A} after {Z}", f"{a_r} and {last(A)} > {first(Z)}"),
    "t3_every_left": (f"every {A} before {Z}", f"{a_r} and {last(A)} < {last(Z)}"),
    "t4_every_right": (f"{A} after every {Z}", f"{a_r} and {last(A)} > {last(Z)}"),
    "t5_every_both": (f"every {A} before every {Z}", f"{a_r} and {last(A)} < {first(Z)}"),
    "t6_mixed": (f"every {A} after any {Z}", f"{a_r} and {first(A)} > {first(Z)}"),
    "t7_simultaneously": (f"{A} simultaneously {Z}", f"{a_r} and " + some(f"{code(A, 'x')} and {near(Z, 'gap = 0', 'x')}")),
    "t8_every_simultaneously": (f"every {A} simultaneously error*", f"{a_r} and not " + some(f"{code(A, 'x')} and not exists (select 1 from e z where z.user_id = x.user_id and z.code like 'error%' and z.day = x.day)")),
    "t9_shift": (f"{A} before 1st {Z} - 2 days - 2 days", f"{a_r} and {first(A)} < {first(Z)} - 4"),
    "w1_after": (f"{A} inside 1 to 3 days after {Z}", f"{a_r} and {near(Z, 'gap between 1 and 3')}"),
    "w1_before": (f"{A} inside 2 days before {Z}", f"{a_r} and {near(Z, 'gap between -2 and 0')}"),
    "w1_around": (f"{A} inside 2 to 3 days around {Z}", f"{a_r} and {near(Z, 'abs(gap) between 2 and 3')}"),
    "w1_shift": (f"{A} inside 2 days after 1st {Z} + 3 days", f"{a_r} and r.day - ({first(Z)} + 3) between 0 and 2"),
    "w2_signed": (f"{A} inside -1 to 2 days around {Z}", f"{a_r} and {near(Z, 'gap between -1 and 2')}"),
    "w3_first_event": (f"{A} inside 2 to 9 days", f"{a_r} and r.day - {agg('min(x.day)', 'true')} between 2 and 9"),
    "w4_self": (f"{A} inside 2 days after {A}", f"{a_r} and {near(A, 'gap between 0 and 2')}"),
    "w5_every_left": (f"every {A} inside 6 days around {Z}", f"{a_r} and {some(code(Z, 'x'))} and not " + some(f"{code(A, 'x')} and not {near(Z, 'abs(gap) <= 6', 'x')}")),
    "w6_every_right": (f"{A} inside 6 days after every {Z}", f"{a_r} and {some(code(Z, 'x'))} and not " + some(f"{code(Z, 'x')} and not {near(A, 'gap between -6 and 0', 'x')}")),
    "w7_outside": (f"{A} outside 3 days around {Z}", f"{a_r} and {some(code(Z, 'x'))} and not {near(Z, 'abs(gap) <= 3')}"),
    "w8_events": (f"{A} inside 3 events after {Z}", f"{a_r} and {placed(Z, 1, 3)}"),
    "w8_events_before": (f"{A} inside 2 to 5 events before {Z}", f"{a_r} and {placed(Z, -5, -2)}"),
    "w8_events_around": (f"{A} inside 4 events around {A}", f"{a_r} and {placed(A, -4, 4)}"),
    "w9_outside_events": (f"{A} outside 3 events after {Z}", f"{a_r} and {some(code(Z, 'x'))} and not {placed(Z, 1, 3)}"),
    "w10_span": (f"{A} inside {Z}", f"{a_r} and r.day between {first(Z)} and {last(Z)}"),
    "w11_bounds": (f"{A} inside 1st {Z} + 1 days to -1st {Y}", f"{a_r} and r.day between {first(Z)} + 1 and {last(Y)}"),
    "w11_between": (f"{A} between {Z} and {Y}", f"{a_r} and r.day between {first(Z)} and {last(Y)}"),
    "w12_outside_span": (f"{A} outside {Z}", f"{a_r} and {some(code(Z, 'x'))} and r.day not between {first(Z)} and {last(Z)}"),
    "w12_outside_bounds": (f"{A} outside {Z} to {Y}", f"{a_r} and {some(code(Z, 'x'))} and {some(code(Y, 'x'))} and r.day not between {first(Z)} and {last(Y)}"),
    "g1_sum": ("sum(paid) > 650", agg("sum(x.paid) > 650", "true")),
    "g2_mean": ("mean(value) > 50", agg("avg(x.value) > 50", "true")),
    "g3_min": ("min(paid) > 2", agg("min(x.paid) > 2", "true")),
    "g3_max": ("max(value) >= 250", agg("max(x.value) >= 250", "true")),
    "g4_median": ("median(paid) > 35", agg("median(x.paid) > 35", "true")),
    "g5_sd": ("sd(value) > 50", agg("stddev_samp(x.value) > 50", "true")),
    "g5_var": ("var(value) < 2500", agg("var_samp(x.value) < 2500", "true")),
    "g6_count": ("count(paid) >= 14", agg("count(x.paid) >= 14", "true")),
    "g7_range": ("range(paid) > 150", agg("max(x.paid) - min(x.paid) > 150", "true")),
    "g8_range_relative": ("range(paid) > 9000%", agg("(max(x.paid) - min(x.paid)) / min(x.paid) > 90", "true")),
    "g9_rise": ("rise(value) > 240", "(select max(up) from s where s.user_id = r.user_id) > 240", _rise),
    "g10_fall": ("fall(value) > 240", "(select max(down) from s where s.user_id = r.user_id) > 240", _rise),
    "g11_rise_relative": ("rise(value) > 50000%", "(select max(up_by) from s where s.user_id = r.user_id) > 500", _rise),
    "g11_fall_relative": ("fall(value) > 99%", "(select max(down_by) from s where s.user_id = r.user_id) > 0.99", _rise),
    "g23_per_reference_around": (f"sum(value) > 150 inside 2 to 3 days around every {Z}", per_ref_around.format("coalesce(sum(x.value), 0) > 150")),
    "g21_anchored": (f"sum(value) > 900 inside 3 days after {Z}", f"{some(code(Z, 'x'))} and {agg('coalesce(sum(x.value), 0) > 900', inside_z)}"),
    "g21_anchored_rise": (f"rise(value) > 150 inside 3 days after {Z}", f"{some(code(Z, 'x'))} and exists (select 1 from e x join e y on x.user_id = y.user_id and y.pos > x.pos where x.user_id = r.user_id and y.value - x.value > 150 and {inside_z} and {near(Z, 'gap between 0 and 3', 'y', 'z2', own=True)})"),
    "g22_anchored_outside": (f"mean(value) > 50 outside 3 days after {Z}", f"{some(code(Z, 'x'))} and {agg('avg(x.value) > 50', f'not {inside_z}')}"),
    "g23_per_reference": (f"sum(value) > 300 inside 3 days after every {Z}", per_ref.format("coalesce(sum(x.value), 0) > 300")),
    "g24_sliding": ("sum(value) > 700 inside 4 days", "exists (select 1 from e w where w.user_id = r.user_id and " + slide.format("sum(x.value) > 700", 4) + ")"),
    "g24_sliding_median": ("median(value) > 130 inside 1 days", "exists (select 1 from e w where w.user_id = r.user_id and " + slide.format("median(x.value) > 130", 1) + ")"),
    "g24_sliding_rise": ("rise(value) > 200 inside 3 days", "exists (select 1 from e x join e y on x.user_id = y.user_id and y.pos > x.pos and y.day - x.day <= 3 and y.value - x.value > 200 where x.user_id = r.user_id)"),
    "g25_sliding_events": ("sum(value) > 500 inside 5 events", "exists (select 1 from e w where w.user_id = r.user_id and (select sum(x.value) from e x where x.user_id = w.user_id and x.pos between w.pos - 4 and w.pos) > 500)"),
    "g26_anchored_events": (f"max(value) > 200 inside 5 events after {Z}", f"{some(code(Z, 'x'))} and {agg('max(x.value) > 200', placed(Z, 1, 5, 'x', own=True))}"),
    "g26_anchored_events_outside": (f"max(value) > 250 outside 5 events after {Z}", f"{some(code(Z, 'x'))} and {agg('max(x.value) > 250', 'not ' + placed(Z, 1, 5, 'x', own=True))}"),
    "o_nested": (f"(min 2 of ({A} inside 3 days after error*)) and not {Y}", f"not {some(code(Y, 'x'))} and 2 <= {agg('count(*)', _near_error)}"),
}

#: Whose SQL divides by bases of 0 too.
ANY_BASE = ("g8_range_relative", "g11_fall_relative", "g11_rise_relative")

FLAGSHIP = "sum(value) > 700 inside 7 days after error.hi and purchase inside 1 to 3 days after click"
LETTERS = {"c": "click*", "e": "error*", "p": "purchase*"}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Persons who spend much after an error and buy soon after a click, with how often."""
    return rows(FLAGSHIP)(spark, d)


def _pct(spark, d):
    q = query(events(spark, d), f"{A} before {Z}")
    return q._answers.agg(F.count(F.when(F.col("match"), 1)).alias("n_match"), F.count(F.when(F.col("evaluable"), 1)).alias("n_evaluable"), F.count("*").alias("n_total"))


def _event_counts(spark, d):
    return query(events(spark, d), A).event_counts


def _persons(spark, d):
    return query(events(spark, d), f"{A} before {Z}").pids


def _filter_persons(spark, d):
    return query(events(spark, d), f"{A} before {Z}").filter("persons").groupBy("user_id").agg(F.count("*").alias("n_rows"))


def _period(spark, d):
    return query(events(spark, d).period("2024-01-05", "2024-01-14"), f"{A} before {Z}").pids


def _cells(spark, d):
    log = events(spark, d)
    df = log.df.withColumn("cell", F.concat("event_type", F.lit(" ; "), F.when(F.col("value") > 50, "high").otherwise("low")))
    return query(EventLog(df, log.config, cols="cell", sep=";"), "high").filter("rows").groupBy("user_id").agg(F.count("*").alias("n_rows"))


def _multi(spark, d):
    found = multi_query(events(spark, d), "?[click,error,view].hi before purchase.hi")
    return spark.createDataFrame(list(found.items()), "query string, n bigint")


def _logs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("pid"), F.col("ts").alias("start_date"), F.col("event_type").alias("kind"), F.col("event_id").alias("k"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("pid"), F.col("o_orderdate").alias("start_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k"))
    return {"events": e, "orders": o}


def _combine(spark, d):
    return combine(_logs(spark, d)).groupBy("__source__").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("n_pids"))


def _smart(spark, d):
    return query(_logs(spark, d), "F in status before click in kind", tie=["k"]).pids


def _codes(spark, d):
    return distinct_codes(events(spark, d).df, ["code"])


def _labels(spark, d):
    log = events(spark, d)
    return log.df.withColumn("label", label_of(log.df, {"buy": "purchase*", "other": ["click", "view-view.lo"]}, ["code"])).groupBy("label").agg(F.count("*").alias("n"))


def _count_codes(spark, d):
    return B.count_codes(events(spark, d), per_person=True)


def _book(spark, d):
    book = B.Codebook([{"code": "click", "label": "a click"}, {"code": "err", "label": "an error"}, {"code": "sig-sih", "label": "a range"}])
    return B.labelled(events(spark, d), book=book).groupBy("code_label").agg(F.count("*").alias("n"))


def _order(spark, d):
    return T.stringify_order(events(spark, d), LETTERS, keep_repeats=False)


def _order_all(spark, d):
    return T.stringify_order(events(spark, d), LETTERS)


def _unique(spark, d):
    return T.stringify_order(events(spark, d), LETTERS, only_unique=True)


def _time(spark, d):
    return T.stringify_time(events(spark, d), LETTERS, step=5, no_event="-", merge=False)


def _merged(spark, d):
    return T.stringify_time(events(spark, d), LETTERS, step=5, no_event="-")


def _durations(spark, d):
    log = events(spark, d)
    return T.stringify_durations(EventLog(log.df.withColumn("days", F.floor(F.col("value") / 10).cast("int")), log.config), {"x": "error.hi"}, event_duration="days", step=4, no_event="-", merge=False)


def _stringops(spark, d):
    s = T.stringify_order(events(spark, d), LETTERS)
    s = S.left_justify(s, "pattern", "-")
    p = F.col("pattern")
    return s.select("user_id", F.length(p).alias("width"), S.del_repeats(p).alias("no_repeats"), S.shorten(p, 3, "-").alias("short"), S.del_singles(p).alias("no_singles"))


def _overlay(spark, d):
    return T.stringify_time(events(spark, d), LETTERS, step=3, no_event="-", merge=False).select("user_id", S.overlay(list(LETTERS), no_event="-").alias("pattern"))


def _string_query(spark, d):
    return V.string_query_auto(events(spark, d), "click* before error*", LETTERS)


def _strings(text: str, mode: str = "order", step: int = 5) -> Query:
    def run(spark, d):
        log = events(spark, d)
        if mode == "durations":
            log = EventLog(log.df.withColumn("days", F.floor(F.col("value") / 10).cast("int")), log.config, event_duration="days")
        return V.string_query_auto(log, text, LETTERS, mode, step=step, no_event="-")

    return run


def _cross(spark, d):
    df, strings, same = V.cross_validate(events(spark, d), "click* before error*", LETTERS)
    return df.agg(F.count("*").alias("n_rows")).crossJoin(strings.agg(F.count("*").alias("n_strings"))).withColumn("same", F.lit(same))


def _bounded(spark, d):
    return T.stringify_order(events(spark, d), LETTERS, first_date="2024-01-05", last_date="2024-01-20")


def _bounded_by_person(spark, d):
    return T.stringify_order(events(spark, d), LETTERS, first_date={i: f"2024-01-{1 + i % 28:02d}" for i in range(1, 31)})


def _mask(spark, d):
    both = query(events(spark, d), f"{A} before {Z}").mask(f"min 2 of {Y}", "persons")
    return both.groupBy("match", "m0").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_persons"))


def _years(**given) -> Query:
    def run(spark, d):
        found = I.incidence(_orders(spark, d), "F", **given)
        return spark.createDataFrame([(y, round(float(n), 6)) for y, n in found.items()], "year int, n double")

    return run


def _raw(spark, d):
    return I.raw_table(I.events(_orders(spark, d), "F", 2))


def _orders(spark, d) -> EventLog:
    return EventLog(spark.read.parquet(f"{d}/orders.parquet"), pid="o_custkey", date="o_orderdate", cols="o_orderstatus", tie=["o_orderkey"])


def _washout(spark, d):
    return I.washout_table(I.events(_orders(spark, d), "F"), [1998, 2000], 300)


def _singles(spark, d):
    return I.singles_table(I.events(_orders(spark, d), "F"), [1998], 200, 3)


def _incidence(spark, d):
    return spark.createDataFrame(list(I.incidence(_orders(spark, d), "F").items()), "year int, n double")


_E = f"with e as ({EVENTS}), p as (select user_id, min(day) filter (code = '{A}') as a, min(day) filter (code = '{Z}') as z from e group by user_id)"
_S = "select user_id, string_agg(label, '' order by ts, event_id) as pattern from l where label is not null group by user_id"
_L = f"with e as ({EVENTS}), l as (select *, case when code like 'click%' then 'c' when code like 'error%' then 'e' when code like 'purchase%' then 'p' end as label, day - min(day) filter (code like 'click%' or code like 'error%' or code like 'purchase%') over (partition by user_id) as since from e)"
_O = "with f as (select o_custkey as pid, (o_orderdate::date - date '1970-01-01')::int as day, year(o_orderdate)::int as year from orders where o_orderstatus = 'F'), b as (select min(day) as low, max(day) as high from f)"
#: The persons who still look new in each year but the first, by steps of a year back; and those who still have one event, by steps ahead and back.
_W = "y as (select distinct year from f where year > (select min(year) from f)), s as (select year, (make_date(year, 1, 1) - date '1970-01-01')::int as start from y), g as (select year, start, unnest(list_distinct(range(0, (start - (select low from b) + 1)::bigint, 365) || [(start - (select low from b))::bigint]))::int as lookback_days from s), c as (select distinct pid, year from f), w as (select g.year, lookback_days, count(*) filter (not exists (select 1 from f where f.pid = c.pid and f.day < start and start - f.day <= lookback_days)) as n from g join c on c.year = g.year group by 1, 2)"
_K = "y as (select distinct year from f where year > (select min(year) from f) and year < (select max(year) from f)), g as (select year, unnest(range(0, 6000, 365))::int as d, (make_date(year, 1, 1) - date '1970-01-01')::int as low, (make_date(year, 12, 31) - date '1970-01-01')::int as high from y), k as (select pid, year from f group by pid, year having count(*) < 2), w as (select g.year, d, count(*) filter ((select count(*) from f where f.pid = k.pid and f.day between g.low - d and g.high + d) < 2) as n from g join k on k.year = g.year, b where d = 0 or g.low - d >= b.low and g.high + d <= b.high group by 1, 2)"


def _track_sql(step: int, label: str) -> str:
    return f"case when max((label = '{label}')::int) = 1 then list_aggregate(list_transform(range(0, max(since // {step}) + 1), lambda k: case when list_contains(list(since // {step}) filter (label = '{label}'), k) then '{label}' else '-' end), 'string_agg', '') else '-' end"


OTHER: dict[str, tuple[Query, str | None]] = {
    "flagship": (flagship, sql(f"(r.code = 'purchase' and {near('click', 'gap between 1 and 3')} or true) and {some(code(Z, 'x'))} and {agg('coalesce(sum(x.value), 0) > 700', near(Z, 'gap between 0 and 7', 'x', own=True))} and exists (select 1 from e p where p.user_id = r.user_id and p.code = 'purchase' and {near('click', 'gap between 1 and 3', 'p')})")),
    "r1_pids": (_persons, _E + " select user_id from p where a < z"),
    "r2_pct": (_pct, _E + " select count(*) filter (a < z) as n_match, count(*) filter (a is not null and z is not null) as n_evaluable, count(*) as n_total from p"),
    "r4_event_counts": (_event_counts, f"with e as ({EVENTS}) select user_id, count(*) filter (code = '{A}') as n from e group by user_id"),
    "r5_multi_query": (_multi, f"with e as ({EVENTS}), p as (select user_id, min(day) filter (code = 'click.hi') as c, min(day) filter (code = 'error.hi') as x, min(day) filter (code = 'view.hi') as v, min(day) filter (code = 'purchase.hi') as p from e group by user_id) select 'click.hi before purchase.hi' as query, count(*) filter (c < p) as n from p union all select 'error.hi before purchase.hi', count(*) filter (x < p) from p union all select 'view.hi before purchase.hi', count(*) filter (v < p) from p"),
    "a5_cells": (_cells, "select user_id, count(*) as n_rows from events where value > 50 group by user_id"),
    "a9_distinct_codes": (_codes, f"with e as ({EVENTS}) select distinct code from e"),
    "a10_extract_codes": (_labels, f"with e as ({EVENTS}) select case when code like 'purchase%' then 'buy' when code = 'click' or code between 'view' and 'view.lo' then 'other' end as label, count(*) as n from e group by 1"),
    "a11_filter_persons": (_filter_persons, _E + " select user_id, count(*) as n_rows from e join p using (user_id) where a < z group by user_id"),
    "a12_period": (_period, f"with e as (select * from ({EVENTS}) where ts::date between date '2024-01-05' and date '2024-01-14'), p as (select user_id, min(day) filter (code = '{A}') as a, min(day) filter (code = '{Z}') as z from e group by user_id) select user_id from p where a < z"),
    "s4_combine": (_combine, "select 'events' as \"__source__\", count(*) as n, count(distinct user_id) as n_pids from events union all select 'orders', count(*), count(distinct o_custkey) from orders"),
    "s5_smart_combine": (_smart, "with o as (select o_custkey as pid, min(o_orderdate)::date as f from orders where o_orderstatus = 'F' group by 1), c as (select user_id as pid, min(ts)::date as c from events where event_type = 'click' group by 1) select pid from o join c using (pid) where f < c"),
    "b3_labels": (_book, f"with e as ({EVENTS}) select case when code like 'click%' then 'a click' when code like 'err%' then 'an error' when code[1:3] between 'sig' and 'sih' then 'a range' end as code_label, count(*) as n from e group by 1"),
    "b6_count_codes": (_count_codes, f"with e as ({EVENTS}) select code, count(distinct user_id) as n from e group by code"),
    "p3_stringify_order": (_order_all, _L + " select user_id, string_agg(label, '' order by ts, event_id) as pattern from l where label is not null group by user_id"),
    "p3_stringify_no_repeats": (_order, _L + ", q as (select *, lag(label) over (partition by user_id order by ts, event_id) as was from l where label is not null) select user_id, string_agg(label, '' order by ts, event_id) as pattern from q where was is distinct from label group by user_id"),
    "p3_stringify_unique": (_unique, _L + ", q as (select user_id, label, min(pos) as pos from l where label is not null group by user_id, label) select user_id, string_agg(label, '' order by pos) as pattern from q group by user_id"),
    "p4_stringify_time": (_time, _L + f" select user_id, {_track_sql(5, 'c')} as c, {_track_sql(5, 'e')} as e, {_track_sql(5, 'p')} as p from l where label is not null group by user_id"),
    "p4_stringify_merged": (_merged, _L + f", t as (select user_id, max(since // 5) as n, {_track_sql(5, 'c')} as c, {_track_sql(5, 'e')} as e, {_track_sql(5, 'p')} as p from l where label is not null group by user_id) select user_id, list_aggregate(list_transform(range(1, n + 2), lambda k: rpad(c, (n + 1)::int, '-')[k] || rpad(e, (n + 1)::int, '-')[k] || rpad(p, (n + 1)::int, '-')[k]), 'string_agg', '|') as pattern from t"),
    "p5_stringify_durations": (_durations, f"with e as ({EVENTS}), x as (select *, day - min(day) over (partition by user_id) as since from e where code = 'error.hi'), t as (select user_id, since // 4 as a, since // 4 + floor(value / 10)::int // 4 as b from x), n as (select user_id, max(b) as n, list(a) as a, list(b) as b from t group by user_id) select user_id, list_aggregate(list_transform(range(0, n + 1), lambda k: case when len(list_filter(range(1, len(a) + 1), lambda i: a[i] <= k and k <= b[i])) > 0 then 'x' else '-' end), 'string_agg', '') as x from n"),
    "p8_overlay": (_overlay, _L + ", t as (select user_id, since // 3 as k, count(distinct label) as d, min(label) as label from l where label is not null group by 1, 2), n as (select user_id, max(k) as n from t group by 1), g as (select user_id, unnest(range(0, n + 1)) as k from n) select user_id, string_agg(case when d is null then '-' when d = 1 then label else 'x' end, '' order by k) as pattern from g left join t using (user_id, k) group by user_id"),
    "p2_bounds": (_bounded, _L + " select user_id, string_agg(label, '' order by ts, event_id) as pattern from l where label is not null and ts::date between date '2024-01-05' and date '2024-01-20' group by user_id"),
    "p2_bounds_by_person": (_bounded_by_person, _L + " select user_id, string_agg(label, '' order by ts, event_id) as pattern from l where label is not null and user_id between 1 and 30 and ts::date >= make_date(2024, 1, (1 + user_id % 28)::int) group by user_id"),
    "p9_p12_string_operations": (_stringops, _L + f", s as ({_S}), j as (select user_id, rpad(pattern, (select max(length(pattern)) from s)::int, '-') as pattern from s), c as (select user_id, pattern, string_split(pattern, '') as c from j) select user_id, length(pattern)::int as width, list_aggregate(list_filter(c, lambda x, i: i = 1 or x <> c[i - 1]), 'string_agg', '') as no_repeats, list_aggregate(list_transform(range(1, len(c) + 1, 3), lambda i: coalesce(list_filter(c[i : i + 2], lambda x: x <> '-')[1], '-')), 'string_agg', '') as short, coalesce(list_aggregate(list_filter(c, lambda x, i: (i > 1 and x = c[i - 1]) or (i < len(c) and x = c[i + 1])), 'string_agg', ''), '') as no_singles from c"),
    "p13_string_counts": (_strings("min 14 of click*"), _L + " select user_id from l group by user_id having count(*) filter (label = 'c') >= 14"),
    "p13_string_not": (_strings("not (min 13 of error*)"), _L + " select user_id from l where label is not null group by user_id having count(*) filter (label = 'e') < 13"),
    "p13_string_window": (_strings("min 8 of (click* inside 1 to 2 events after error*)"), _L + ", n as (select *, row_number() over (partition by user_id order by ts, event_id) as k from l where label is not null) select user_id from n a where label = 'c' and exists (select 1 from n b where b.user_id = a.user_id and b.label = 'e' and a.k - b.k between 1 and 2) group by user_id having count(*) >= 8"),
    "p13_time_before": (_strings("click* before error*", "time"), _L + " select user_id from l group by user_id having min(since // 5) filter (label = 'c') < min(since // 5) filter (label = 'e')"),
    "p13_time_window": (_strings("exactly 5 of (click* inside 10 days after error*)", "time"), _L + ", k as (select distinct user_id, label, since // 5 as k from l where label is not null) select user_id from k a where label = 'c' and exists (select 1 from k b where b.user_id = a.user_id and b.label = 'e' and a.k - b.k between 1 and 2) group by user_id having count(*) = 5"),
    "p13_durations": (_strings("min 9 of (purchase* simultaneously error*)", "durations", 4), _L + ", k as (select distinct user_id, label, unnest(range(since // 4, since // 4 + floor(value / 10)::int // 4 + 1)) as k from l where label is not null) select user_id from k where label = 'p' and user_id in (select a.user_id from k a join k b on a.user_id = b.user_id and a.k = b.k and a.label = 'p' and b.label = 'e') group by user_id having count(*) >= 9"),
    "p16_cross_validate": (_cross, _L + ", f as (select user_id, min(day) filter (label = 'c') as c, min(day) filter (label = 'e') as e from l group by user_id) select count(*) as n_rows, count(*) as n_strings, true as same from f where c < e"),
    "r3_mask": (_mask, _E + f", m as (select user_id, coalesce(a < z, false) as match, coalesce((select count(*) from e where e.user_id = p.user_id and e.code = '{Y}') >= 2, false) as m0 from p) select match, m0, count(*) as n_rows, count(distinct user_id) as n_persons from e join m using (user_id) group by match, m0"),
    "p13_string_query": (_string_query, _L + ", f as (select user_id, min(day) filter (label = 'c') as c, min(day) filter (label = 'e') as e from l group by user_id) select user_id from f where c < e"),
    "i1_raw_incidence": (_raw, _O + ", p as (select pid, min(year) as year from f group by pid having count(*) >= 2) select year, count(*) as n from p group by year"),
    "i2_washout": (_washout, _O + ", y as (select unnest([1998, 2000]) as year), s as (select year, (make_date(year, 1, 1) - date '1970-01-01')::int as start from y), g as (select year, start, unnest(list_distinct(range(0, (start - (select low from b) + 1)::bigint, 300) || [(start - (select low from b))::bigint]))::int as lookback_days from s), c as (select distinct pid, year from f) select g.year::int as year, lookback_days, count(*) filter (not exists (select 1 from f where f.pid = c.pid and f.day < start and start - f.day <= lookback_days)) as n from g join c on c.year = g.year group by 1, 2"),
    "i3_singles": (_singles, _O + ", g as (select unnest(range(0, 2000, 200))::int as d, (date '1998-01-01' - date '1970-01-01')::int as low, (date '1998-12-31' - date '1970-01-01')::int as high), k as (select pid from f where year = 1998 group by pid having count(*) < 3) select 1998 as year, d as expand_days, count(*) filter ((select count(*) from f where f.pid = k.pid and f.day between g.low - d and g.high + d) < 3) as n from g, b, k where d = 0 or g.low - d >= b.low and g.high + d <= b.high group by d"),
    "i7_incidence": (_incidence, None),
    "i7_incidence_uncorrected": (_years(washout="none"), _O + " select year, count(*)::double as n from (select pid, min(year) as year from f group by pid) group by year"),
    "i7_incidence_historical": (_years(washout="historical"), _O + f", {_W}, m as (select lookback_days as d, avg(w.n / s.n) as v from w join (select year, n from w where lookback_days = 0 and n > 0) s using (year) group by 1), r as (select year, count(*) as n, (year - min(year) over ()) * 365.25 as x from (select pid, min(year) as year from f group by pid) group by year) select year, round(n * (select v from m order by d desc limit 1) / greatest((select v from m order by abs(d - x), d limit 1), 1e-9), 6) as n from r"),
    "i7_incidence_two_events": (_years(required_events=2, washout="none", lookahead="historical"), _O + f", {_K}, m as (select d, avg(w.n / s.n) as v from w join (select year, n from w where d = 0 and n > 0) s using (year) group by 1), r as (select p.year, count(*) as n, count(*) filter ((select count(*) from f where f.pid = p.pid and f.year = p.year) < 2) as few from (select pid, min(year) as year from f group by pid) p group by p.year) select year, round(greatest(0.0, n - few * (select min(v) from m)), 6) as n from r"),
}

QUERIES: dict[str, Query] = {n: rows(spec[0], any_base=n in ANY_BASE) for n, spec in ROWS.items()} | {n: q for n, (q, _) in OTHER.items()}
SQL: dict[str, str] = {n: sql(*spec[1:]) for n, spec in ROWS.items()} | {n: s for n, (_, s) in OTHER.items() if s}

"""Yearly incidence from event logs, and its correction for cases that only look new (short history) or only look like cases (short future).

Counting is distributed; what comes to the driver is a number per year and step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..result import Result
from ..sources.eventlog import DAY, EventLog

YEAR_DAYS = 365.25
#: Each decay's curve of days and coefficients, and where the fit starts. The first coefficient is what the curve tends to.
MODELS: dict[str, tuple[Callable, list[float]]] = {
    "exponential": (lambda x, a, b: a + (1 - a) * np.exp(-b * x / YEAR_DAYS), [0.5, 1.0]),
    "hyperbolic": (lambda x, a, b, c: a + b / (1 + c * x), [0.5, 0.5, 0.001]),
    "rational": (lambda x, a, b, c: (a * x + b) / (x + c), [0.5, 1.0, 100.0]),
}


def events(log: EventLog, expr: str | None = None, required_events: int = 1) -> DataFrame:
    """(pid, day, year) of the query's rows, of persons who have enough of them."""
    rows = log.df if expr is None else Result(log, expr).filter("rows")
    day = EventLog(rows, log.config).day()
    out = rows.select(log.pid.alias("pid"), day.alias(DAY), F.year(F.date_from_unix_date(day)).alias("year")).where(f"pid is not null and {DAY} is not null")
    if required_events > 1:
        out = out.join(out.groupBy("pid").agg(F.count("*").alias("n")).where(F.col("n") >= required_events).select("pid"), "pid", "left_semi")
    return out


def raw_table(ev: DataFrame) -> DataFrame:
    """(year, n): persons by the year of their first event."""
    return ev.groupBy("pid").agg(F.min("year").alias("year")).groupBy("year").agg(F.count("*").alias("n"))


def raw_incidence(log: EventLog, expr: str | None = None, *, required_events: int = 1) -> dict[int, int]:
    return {r["year"]: r["n"] for r in raw_table(events(log, expr, required_events)).orderBy("year").collect()}


def _bounds(ev: DataFrame):
    return ev.agg(F.min(DAY).alias("low"), F.max(DAY).alias("high"), F.min("year").alias("first"), F.max("year").alias("last")).collect()[0]


def _new_year(year: int) -> int:
    return int((np.datetime64(f"{year:04d}-01-01") - np.datetime64("1970-01-01")).astype(int))


def washout_table(ev: DataFrame, years: Sequence[int] | None, step_days: int) -> DataFrame:
    """(year, lookback_days, n): of the persons with events in the year, those without any in so many days before it; by steps and to the start of the data."""
    spark = ev.sparkSession
    b = _bounds(ev)
    if b["low"] is None:
        return spark.createDataFrame([], "year int, lookback_days int, n long")
    if years is None:
        years = [y for y in (r["year"] for r in ev.select("year").distinct().collect()) if y > b["first"]]
    steps = []
    for y in years:
        reach = max(0, _new_year(y) - b["low"])
        steps += [(y, d) for d in sorted({0, *range(step_days, reach + 1, step_days), *([reach] if reach else [])})]
    table = spark.createDataFrame(steps, "year int, lookback_days int")
    starts = spark.createDataFrame([(int(y), _new_year(y)) for y in years], "year int, start int")
    active = ev.select("pid", "year").distinct().join(F.broadcast(starts), "year")
    back = active.join(ev.select("pid", F.col(DAY).alias("d")), "pid").groupBy("pid", "year").agg(F.min(F.when(F.col("d") < F.col("start"), F.col("start") - F.col("d"))).alias("back"))
    shapes = back.groupBy("year", "back").agg(F.count("*").alias("k"))  # persons with the same history count together
    still = F.when((F.col("lookback_days") == 0) | F.col("back").isNull() | (F.col("back") > F.col("lookback_days")), F.col("k")).otherwise(0)
    return shapes.join(F.broadcast(table), "year").groupBy("year", "lookback_days").agg(F.sum(still).alias("n"))


def singles_table(ev: DataFrame, years: Sequence[int] | None, step_days: int, required_events: int) -> DataFrame:
    """(year, expand_days, n): of the persons with too few events in the year, those who still have too few in the year and so many days on both its sides."""
    spark = ev.sparkSession
    b = _bounds(ev)
    if b["low"] is None:
        return spark.createDataFrame([], "year int, expand_days int, n long")
    years = list(range(b["first"] + 1, b["last"])) if years is None else list(years)
    steps = []
    for y in years:
        low, high, d = _new_year(y), _new_year(y + 1) - 1, 0
        while d == 0 or low - d >= b["low"] and high + d <= b["high"]:
            steps.append((int(y), d, low - d, high + d))
            d += step_days
    table = spark.createDataFrame(steps, "year int, expand_days int, low int, high int")
    few = ev.groupBy("pid", "year").agg(F.count("*").alias("k")).where(F.col("k") < required_events).select("pid", "year")
    inside = few.join(F.broadcast(table), "year").join(ev.select("pid", F.col(DAY).alias("d")), "pid")
    held = inside.groupBy("pid", "year", "expand_days").agg(F.count(F.when(F.col("d").between(F.col("low"), F.col("high")), 1)).alias("k"))
    return held.groupBy("year", "expand_days").agg(F.count(F.when(F.col("k") < required_events, 1)).alias("n"))


def _pattern(table: DataFrame, step: str, pct: bool) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for r in table.orderBy("year", step).collect():
        out.setdefault(r["year"], {})[r[step]] = float(r["n"])
    if pct:
        out = {y: {d: n / p[0] for d, n in p.items()} for y, p in out.items() if p.get(0)}
    return out


def washout_pattern(log: EventLog, expr: str | None = None, *, year: int | Sequence[int] | None = None, step_days: int = 200, pct: bool = False, required_events: int = 1):
    """{days: persons who still look new}, or fractions, for one year; {year: such} for several or, by default, all but the first."""
    years = [year] if isinstance(year, int) else year
    found = _pattern(washout_table(events(log, expr, required_events), years, step_days), "lookback_days", pct)
    return found.get(year, {}) if isinstance(year, int) else found


def singles_pattern(log: EventLog, expr: str | None = None, *, year: int | Sequence[int] | None = None, step_days: int = 200, required_events: int = 2, pct: bool = False):
    """The same for persons with too few events, as the window about the year grows; by default for all years but the first and last."""
    years = [year] if isinstance(year, int) else year
    found = _pattern(singles_table(events(log, expr), years, step_days, required_events), "expand_days", pct)
    return found.get(year, {}) if isinstance(year, int) else found


def mean_pattern(pattern: Mapping) -> dict[int, float]:
    """The mean over years at each step that any year has."""
    if not pattern or not isinstance(next(iter(pattern.values())), Mapping):
        return dict(pattern)
    return {d: float(np.mean([p[d] for p in pattern.values() if d in p])) for d in sorted({d for p in pattern.values() for d in p})}


def least_squares(curve: Callable, x: np.ndarray, y: np.ndarray, start: Sequence[float], rounds: int = 500) -> np.ndarray:
    """Levenberg-Marquardt with numeric derivatives and the scaling of Marquardt."""
    p, damp = np.array(start, float), 1e-3
    with np.errstate(all="ignore"):
        gap = y - curve(x, *p)
        for _ in range(rounds):
            h = 1e-7 * np.maximum(np.abs(p), 1e-4)
            j = np.stack([(curve(x, *(p + np.eye(len(p))[i] * h[i])) - curve(x, *p)) / h[i] for i in range(len(p))], 1)
            a, g = j.T @ j, j.T @ gap
            if not np.isfinite(a).all():
                raise ValueError("the fit ran out of range")
            for _ in range(40):
                move = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
                new = y - curve(x, *(p + move))
                if np.isfinite(new).all() and new @ new <= gap @ gap:
                    break
                damp *= 4
            else:
                return p
            done = gap @ gap - new @ new <= 1e-15 * (1 + gap @ gap) and np.abs(move).max() <= 1e-9 * (1 + np.abs(p).max())
            p, gap, damp = p + move, new, max(damp / 6, 1e-12)
            if done:
                break
    return p


def _fit(x: np.ndarray, y: np.ndarray, name: str) -> dict[str, Any]:
    curve, start = MODELS[name]
    p = least_squares(curve, x, y, start)
    gap = float(((y - curve(x, *p)) ** 2).sum())
    spread = float(((y - y.mean()) ** 2).sum())
    n = len(y)
    return {
        "model": name, "coeffs": p, "asymptote": float(p[0]), "predict": lambda days: curve(np.asarray(days, float), *p),
        "aic": n * np.log(max(gap, 1e-300) / n) + 2 * len(p), "r2": 1 - gap / spread if spread > 0 else float("nan"),
    }


def fit_decay(pattern: Mapping, model: str = "exponential") -> dict[str, Any]:
    """The decay that fits a pattern (or the mean of several) best: coeffs, asymptote, predict, aic, r2. Model all: each by its name, or its error."""
    if model != "all" and model not in MODELS:
        raise ValueError(f"model is one of {sorted(MODELS)} or 'all', not {model!r}")
    mean = mean_pattern(pattern)
    if not mean:
        raise ValueError("there is no pattern to fit")
    x, y = np.array(list(mean), float), np.array(list(mean.values()), float)
    if model != "all":
        return _fit(x, y, model)
    out: dict[str, Any] = {}
    for name in MODELS:
        try:
            out[name] = _fit(x, y, name)
        except (ValueError, np.linalg.LinAlgError) as e:
            out[name] = {"model": name, "error": str(e)}
    return out


def washout_adjusted(raw: Mapping[int, float], asymptote: float, at: Callable[[float], float]) -> dict[int, float]:
    """Counts times asymptote / decay at the history that each year has."""
    return {y: n * asymptote / max(float(at((y - min(raw)) * YEAR_DAYS)), 1e-9) for y, n in raw.items()}


def under_threshold(ev: DataFrame, required_events: int) -> dict[int, int]:
    """By first year, the persons who have fewer events in it than required."""
    first = ev.groupBy("pid").agg(F.min("year").alias("year"), F.collect_list("year").alias("all"))
    few = first.where(F.size(F.filter("all", lambda y: y == F.col("year"))) < required_events)
    return {r["year"]: r["n"] for r in few.groupBy("year").agg(F.count("*").alias("n")).collect()}


def incidence(log: EventLog, expr: str | None = None, *, required_events: int = 1, washout: str = "functional", lookahead: str = "auto", model: str = "exponential", step_days: int = 365) -> dict[int, float]:
    """{year: corrected count}. washout: none, historical (by the observed decay) or functional (by a fitted one). lookahead: the same, or auto: functional
    where more than one event is required."""
    if washout not in ("none", "historical", "functional"):
        raise ValueError(f"washout is none, historical or functional, not {washout!r}")
    if lookahead not in ("none", "historical", "functional", "auto"):
        raise ValueError(f"lookahead is none, historical, functional or auto, not {lookahead!r}")
    ahead = {"auto": "functional"}.get(lookahead, lookahead) if required_events >= 2 else "none"
    ev = events(log, expr, 1 if ahead != "none" else required_events).persist()  # three narrow columns, that up to six jobs read; what doesn't fit in memory goes to disk
    try:
        return _incidence(ev, required_events, washout, ahead, model, step_days)
    finally:
        ev.unpersist()


def _incidence(ev: DataFrame, required_events: int, washout: str, ahead: str, model: str, step_days: int) -> dict[int, float]:
    raw = {r["year"]: float(r["n"]) for r in raw_table(ev).orderBy("year").collect()}
    if not raw:
        return {}
    out = raw
    if washout != "none" and (mean := mean_pattern(_pattern(washout_table(ev, None, step_days), "lookback_days", True))):
        if washout == "functional":
            fit = fit_decay(mean, model)
            out = washout_adjusted(raw, fit["asymptote"], lambda d: fit["predict"](d))
        else:
            days = np.array(list(mean), float)
            out = washout_adjusted(raw, mean[max(mean)], lambda d: mean[int(days[np.argmin(np.abs(days - d))])])
    if ahead != "none" and (mean := mean_pattern(_pattern(singles_table(ev, None, step_days, required_events), "expand_days", True))):
        share = fit_decay(mean, model)["asymptote"] if ahead == "functional" else min(mean.values())
        few = under_threshold(ev, required_events)
        out = {y: max(0.0, n - share * few.get(y, 0)) for y, n in out.items()}
    return out

"""Aggregates held against thresholds: over partitions, over frames, and over arrays of events where order or two bands call for it."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

COMPARE = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}
SYNONYMS = {"avg": "mean", "n": "count"}
ORDERED = ("rise", "fall")


def compared(value: Column, op: str, threshold: float) -> Column:
    """Whether the comparison holds; null never does."""
    return F.coalesce(COMPARE[op](value, F.lit(float(threshold))), F.lit(False))


def parts(v: Column) -> tuple[Column, Column]:
    """v as whole 1024ths and a rest. Below 2 ** 43 sums of the former are exact in any order and those of rests nearly so, and the sum of both is
    rounded once: means that are the threshold itself don't hang on the order of rows."""
    small = F.abs(v) < 2.0**43
    whole = F.when(small, F.rint(v * 1024) / 1024).otherwise(v)
    return whole, F.when(small, v - whole).otherwise(0.0)


def plain(func: str, v: Column, relative: bool | str, over=lambda c: c, framed: bool = False, zero: bool = True) -> Column:
    """An aggregate that needs no order; over puts each part over a window; framed: of few rows, added up in their order; zero: a sum of nothing is 0."""
    if func == "sum" or func == "mean" and not framed:
        total = over(F.sum(v)) if framed else reduce(add, [over(F.sum(part)) for part in parts(v)])
        if func == "mean":
            return total / F.nullif(over(F.count(v)), F.lit(0))
        return F.coalesce(total, F.lit(0.0)) if zero else total
    if func == "count":
        return over(F.count(v)).cast("double")
    if func == "median":
        return over(F.percentile(v, F.lit(0.5)) if framed else F.median(v))
    if func == "range":
        return spread(over(F.min(v)), over(F.max(v)), relative)
    return over({"mean": F.avg, "min": F.min, "max": F.max, "sd": F.stddev_samp, "var": F.var_samp}[func](v))


def quotient(gap: Column, base: Column) -> Column:
    """The quotient by any base: infinite by 0, and 0 / 0 is NaN, which is above all numbers."""
    return F.when(base == 0, F.signum(gap) * F.lit(math.inf)).otherwise(gap / base)


def spread(low: Column, high: Column, relative: bool | str) -> Column:
    """How far high is above low; a fraction of low if relative, null where that isn't positive; the quotient in any case if relative is "any"."""
    if relative == "any":
        return quotient(high - low, low)
    return F.when(low > 0, (high - low) / low) if relative else high - low


def change(func: str, relative: bool | str, v: Column, base: Column) -> Column:
    """How far v is above (rise) or below (fall) its base; a fraction of the base if relative, 0 where that isn't positive; the quotient in any case if
    relative is "any"."""
    gap = v - base if func == "rise" else base - v
    if relative == "any":
        return quotient(gap, base)
    return F.when(base > 0, gap / base).otherwise(F.when(v.isNotNull(), 0.0)) if relative else gap


def running(func: str, relative: bool | str, v: Column, upto: WindowSpec) -> Column:
    """The change of each event from the lowest (rise) or highest (fall) so far; the greatest of a person's is the aggregate."""
    return change(func, relative, v, (F.min if func == "rise" else F.max)(v).over(upto))


def of_array(func: str, relative: bool | str, events: Column, op_zero: bool = True) -> Column:
    """The aggregate of an array of structs whose last field is v, in the order of the array; null values count as missing."""
    v = F.filter(F.transform(events, lambda e: e["v"]), lambda x: x.isNotNull())
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / F.when(n > 0, n))
    if func == "sum":
        return total if op_zero else F.when(n > 0, total)
    if func == "count":
        return n.cast("double")
    if func == "mean":
        return mean
    if func in ("min", "max"):
        return F.array_min(v) if func == "min" else F.array_max(v)
    if func == "range":
        return spread(F.array_min(v), F.array_max(v), relative)
    if func == "median":
        s = F.array_sort(v)
        at = (n + 1) / 2
        return F.when(n > 0, (F.get(s, F.floor(at).cast("int") - 1) + F.get(s, F.ceil(at).cast("int") - 1)) / 2)
    if func in ("sd", "var"):
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        var = F.when(n > 1, square / F.when(n > 1, n - 1))
        return F.sqrt(var) if func == "sd" else var
    start = F.struct(F.lit(None).cast("double").alias("base"), F.lit(None).cast("double").alias("best"))

    def step(a: Column, x: Column) -> Column:
        base = (F.least if func == "rise" else F.greatest)(a["base"], x)
        return F.struct(base.alias("base"), F.greatest(a["best"], change(func, relative, x, base)).alias("best"))

    return F.aggregate(v, start, step, lambda a: a["best"])

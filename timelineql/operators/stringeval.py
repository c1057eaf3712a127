"""A second evaluator: queries over pattern strings, each node an array of places per person.

It knows less than the compiler: counts of zero match nobody, a window's event may be its own reference, and there are no quantifiers, aggregates, comparisons,
spans, bounds or moved dates. What it shares serves to hold one evaluator against the other.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PatternStringError
from ..functions import stringops as S
from ..functions.codes import expand
from ..plans import ast as A
from ..plans.parser import parse
from ..result import Result
from ..sources.eventlog import EventLog
from . import stringify as T

MODES = ("order", "time", "durations")


def overlap(a: tuple[str, str, str], b: tuple[str, str, str]) -> bool:
    """Whether a query's pattern a can mean codes of a label's pattern b."""
    (ka, xa, ya), (kb, xb, yb) = a, b
    if ka == "prefix":
        return xb.startswith(xa) or kb == "prefix" and xa.startswith(xb) or kb == "range" and xb <= xa <= yb
    if kb == "prefix":
        return xa.startswith(xb) or ka == "range" and xa <= xb <= ya
    low_a, high_a, low_b, high_b = xa, ya or xa, xb, yb or xb
    return low_a <= high_b and low_b <= high_a


class StringEvaluator:
    """strings: (pid, pattern) of order mode, or (pid, a column per label); dates: a column of the order strings' days, for strict order within a day."""

    def __init__(self, strings: DataFrame, codes: T.Labels, mode: str = "order", *, pid: str = "pid", step: int = 90, no_event: str = " ", variables: Mapping | None = None, days: str | None = None):
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}, not {mode!r}")
        if mode != "order" and "pattern" in strings.columns and "pattern" not in codes:
            raise PatternStringError(f"mode {mode!r} needs a track per label: stringify with merge=False")
        self.strings, self.codes, self.mode, self.pid, self.step, self.no_event, self.variables, self.days = strings, codes, mode, pid, step, no_event, variables, days

    def _at(self, label: str) -> Column:
        if self.mode != "order" and label not in self.strings.columns:
            return F.array().cast("array<int>")
        c = S.chars(F.col("`pattern`" if self.mode == "order" else f"`{label}`"))
        held = (lambda x: x == label) if self.mode == "order" else (lambda x: x != self.no_event)
        return F.coalesce(F.filter(F.transform(c, lambda x, i: F.when(held(x), i)), lambda i: i.isNotNull()), F.array().cast("array<int>"))

    def _all(self) -> Column:
        return F.array_sort(F.array_distinct(F.concat(*[self._at(x) for x in self.codes])))

    def matches(self, expr: str | A.Node) -> DataFrame:
        """(pid, places) of the persons who match."""
        return self.strings.select(self.pid, self.places(parse(expr) if isinstance(expr, str) else expr).alias("places")).where("size(places) > 0")

    def pids(self, expr: str | A.Node) -> DataFrame:
        return self.matches(expr).select(self.pid)

    def places(self, node: A.Node) -> Column:
        none = F.array().cast("array<int>")
        if isinstance(node, A.CodeAtom):
            asked = expand(node.codes, self.variables)
            labels = [x for x, v in self.codes.items() if any(overlap(a, b) for a in asked for b in expand([v] if isinstance(v, str) else v))]
            return F.array_sort(F.array_distinct(F.concat(*[self._at(x) for x in labels]))) if labels else none
        if isinstance(node, A.NotExpr):
            return F.when(F.size(self.places(node.child)) == 0, self._all()).otherwise(none)
        if isinstance(node, A.BinaryLogical):
            a, b = self.places(node.left), self.places(node.right)
            both = F.array_sort(F.array_union(a, b))
            return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(none) if node.op == "and" else both
        if isinstance(node, A.PrefixExpr | A.RangePrefixExpr):
            x = self.places(node.child)
            n = F.size(x)
            if isinstance(node, A.RangePrefixExpr):
                held = n.between(node.min_n, node.max_n)
            elif node.kind in ("min", "max", "exactly"):
                held = {"min": n >= node.n, "max": n <= node.n, "exactly": n == node.n}[node.kind]
            elif node.kind == "ordinal":
                return F.when(n >= abs(node.n), F.slice(x, node.n, 1)).otherwise(none)
            elif node.n == 0:
                return none
            else:
                return F.slice(x, 1, node.n) if node.kind == "first" else F.when(n > node.n, F.slice(x, -node.n, node.n)).otherwise(x)
            return F.when(held, x).otherwise(none)
        if isinstance(node, A.TemporalExpr) and not isinstance(node.left, A.Quantifier) and not isinstance(node.right, A.Quantifier):
            a, b = self.places(node.left), self.places(node.right)
            if node.op == "simultaneously":
                if self.mode == "order":
                    raise PatternStringError("order strings have no time: `simultaneously` needs time or durations")
                return F.when(F.arrays_overlap(a, b), a).otherwise(none)
            p, q = F.array_min(a), F.array_min(b)
            if self.days:
                p, q = F.get(F.col(f"`{self.days}`"), p), F.get(F.col(f"`{self.days}`"), q)
            return F.when(p < q if node.op == "before" else p > q, a).otherwise(none)
        if isinstance(node, A.WithinExpr) and not isinstance(node.child, A.AggregateExpr):
            if self.mode == "order":
                raise PatternStringError("order strings have no time: windows of days need time or durations")
            x, low, high = self.places(node.child), node.min_days // self.step, node.days // self.step
            if node.ref is None:
                first = F.array_min(self._all())
                return F.filter(x, lambda p: F.abs(p - first).between(low, high))
            y = self.places(node.ref)

            def near(p: Column, q: Column) -> Column:
                side = {"after": p > q, "before": p < q}.get(node.direction, F.lit(True))
                return F.abs(p - q).between(low, high) & side

            return F.filter(x, lambda p: F.exists(y, lambda q: near(p, q)))
        if isinstance(node, A.InsideExpr) and node.ref is not None and not isinstance(node.child, A.AggregateExpr):
            if self.mode != "order":
                raise PatternStringError(f"windows of events need order strings, not {self.mode}")
            x, y = self.places(node.child), self.places(node.ref)

            def within(p: Column, q: Column) -> Column:
                return (q - p if node.direction == "before" else p - q).between(node.min_events, node.max_events)

            hit = lambda p: F.exists(y, lambda q: within(p, q))
            kept = F.filter(x, hit) if node.inside else F.filter(x, lambda p: ~hit(p))
            return F.when(F.size(y) > 0, kept).otherwise(none)
        raise PatternStringError(f"{type(node).__name__} has no meaning over pattern strings")


class CrossCheck(NamedTuple):
    df_pids: DataFrame
    str_pids: DataFrame
    match: bool


def string_query(expr: str, strings: DataFrame, codes: T.Labels, mode: str = "order", **settings) -> DataFrame:
    """The persons whose strings match."""
    return StringEvaluator(strings, codes, mode, **settings).pids(expr)


def string_query_auto(log: EventLog, expr: str, codes: T.Labels, mode: str = "order", *, step: int = 90, no_event: str = " ") -> DataFrame:
    """The same, with strings made from the log."""
    pid, days = log.config.pid, None
    if mode == "order":
        from ..sources.eventlog import DAY, TIE

        events = T.prepared(log, codes).groupBy(pid).agg(F.array_sort(F.collect_list(F.struct(DAY, TIE, F.col("__label").alias("label")))).alias("e"))
        strings = events.select(pid, F.array_join(F.transform("e", lambda x: x["label"]), "").alias("pattern"), F.transform("e", lambda x: x[DAY]).alias("days"))
        days = "days"
    elif mode == "time":
        strings = T.stringify_time(log, codes, step=step, no_event=no_event, merge=False)
    elif mode == "durations":
        strings = T.stringify_durations(log, codes, step=step, no_event=no_event, merge=False)
    else:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    return string_query(expr, strings, codes, mode, pid=pid, step=step, no_event=no_event, variables=log.config.variables, days=days)


def cross_validate(log: EventLog, expr: str, codes: T.Labels, mode: str = "order", *, step: int = 90, no_event: str = " ") -> CrossCheck:
    """The persons by the compiler and by strings, and whether they are the same."""
    a = Result(log, expr).pids
    b = string_query_auto(log, expr, codes, mode, step=step, no_event=no_event)
    return CrossCheck(a, b, a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())

"""From query trees to one DataFrame plan.

Every node becomes a boolean column on the event rows, never null. All of them come from window functions partitioned by person, so a query needs one
shuffle and one sort (by day and tie, of which a sort by day is a prefix), however deep it is; helpers that several nodes need are made once. A relation of
two sets of events is never a join: the window of days about references is a RANGE frame that counts them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnError, UnsupportedError
from ..functions import codes as C
from ..operators import aggregates as G
from ..sources.eventlog import DAY, TIE, EventLog
from . import ast as A

def bands(direction: str, low: int, high: int) -> list[tuple[int, int]]:
    """Closed ranges of (reference day - event day) that a window of days allows."""
    after, before = (-high, -low), (low, high)
    if direction == "after" or direction == "around" and low < 0:
        return [after]
    if direction == "before":
        return [before]
    return [(-high, high)] if low == 0 else [after, before]


def atom_test(log: EventLog, node: A.Node, filtering: bool = False) -> Column:
    """The row test of a code, comparison or event atom; never null, but perhaps when filtering."""
    if isinstance(node, A.EventAtom):
        return F.lit(True)
    if isinstance(node, A.ComparisonAtom):
        return G.compared(number(log, node.column), node.op, node.value)
    columns = log.code_columns if node.columns is None else C.route_columns(node.columns, log.df.columns)
    return C.any_code(log.df, columns, C.expand(node.codes, log.config.variables), log.config.sep, filtering)


def number(log: EventLog, column: str) -> Column:
    """The column as a double in which NaN is null."""
    if column not in log.df.columns:
        raise ColumnError(f"no column {column!r}; there are {log.df.columns}")
    if not isinstance(log.df.schema[column].dataType, T.NumericType | T.BooleanType):
        raise ColumnError(f"{column!r} isn't numeric")
    v = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(v), v)


def relative(log: EventLog, agg: A.AggregateExpr) -> bool | str:
    """Whether the aggregate is in parts of its base, and "any" if that may be any number."""
    return agg.relative and ("any" if log.config.any_base else True)


def check(node: A.Node) -> None:
    """Raises where a shift or quantifier stands where it means nothing."""
    ok: set[int] = set()
    for n in node.walk():
        if isinstance(n, A.TemporalExpr):
            ok |= {id(n.left), id(n.right), id(A.unquantified(n.right)[0])}
            if isinstance(n.left, A.ShiftExpr):
                raise UnsupportedError("a moved date can't be the left side of a temporal comparison")
        elif isinstance(n, A.WithinExpr):
            if isinstance(n.child, A.ShiftExpr):
                raise UnsupportedError("a moved date can't be the subject of a window")
            if isinstance(n.child, A.AggregateExpr) and n.outside and (n.ref is None or isinstance(n.ref, A.Quantifier)):
                raise UnsupportedError("an aggregate `outside` needs references, and not `every` of them")
            ok |= {id(n.child), id(n.ref)}
        elif isinstance(n, A.InsideExpr):
            if isinstance(n.ref, A.ShiftExpr) or isinstance(n.child, A.ShiftExpr):
                raise UnsupportedError("windows of events count positions; dates moved by days have none")
            if isinstance(n.ref, A.Quantifier) or isinstance(n.child, A.Quantifier):
                raise UnsupportedError("`every` isn't supported in windows of events")
        elif isinstance(n, A.BetweenExpr):
            ok |= {id(n.bound_start), id(n.bound_end)}
        elif isinstance(n, A.WithinSpanExpr) and isinstance(n.ref, A.ShiftExpr):
            raise UnsupportedError("a moved date has no span")
        elif isinstance(n, A.ShiftExpr) and id(n) in ok:
            ok.add(id(n.child))
        if isinstance(n, A.ShiftExpr | A.Quantifier) and id(n) not in ok:
            raise UnsupportedError("a moved date or `every` stands alone; it must be a side of a comparison or window")


class RowPlan:
    """Compiles nodes to columns of one growing table."""

    def __init__(self, log: EventLog, extra: list[str] | None = None):
        self.log = log
        self.df: DataFrame = log.prepared()
        pid = log.config.pid
        self.person = Window.partitionBy(F.col(f"`{pid}`"))
        self.rows = self.person.orderBy(F.col(DAY).asc_nulls_last(), F.col(TIE))
        self.days = self.person.orderBy(F.col(DAY).asc_nulls_last())
        self.today = Window.partitionBy(F.col(f"`{pid}`"), F.col(DAY)).orderBy(F.col(TIE))
        self.made: dict = {}
        self.dated = F.col(DAY).isNotNull()
        self.laid_out = False

    def lay_out(self) -> None:
        """One shuffle by person and one sort that serves all frames, whichever comes first."""
        if not self.laid_out:
            self.laid_out = True
            pid = F.col(f"`{self.log.config.pid}`")
            self.df = self.df.repartition(pid).sortWithinPartitions(pid, F.col(DAY).asc_nulls_last(), F.col(TIE))

    def add(self, key, make, window: bool = True) -> Column:
        """The column for key, made once."""
        if key not in self.made:
            column = make()
            if window:
                self.lay_out()
            name = f"__c{len(self.made)}"
            self.df = self.df.withColumn(name, column)
            self.made[key] = name
        return F.col(self.made[key])

    # -- helpers over masks; m is always a column that was made

    def any_of(self, m: Column) -> Column:
        return self.add(("any", str(m)), lambda: F.max(m).over(self.person))

    def every_of(self, where: Column, test: Column, key) -> Column:
        """Whether test holds on all rows of where, and there are any."""
        inner = self.add(("when", key), lambda: F.when(where, test), window=False)
        return self.add(("every", key), lambda: F.coalesce(F.min(inner).over(self.person), F.lit(False)))

    def count_of(self, m: Column) -> Column:
        return self.add(("count", str(m)), lambda: F.count(F.when(m, 1)).over(self.person))

    def run_of(self, m: Column) -> Column:
        return self.add(("run", str(m)), lambda: F.count(F.when(m, 1)).over(self.rows.rowsBetween(Window.unboundedPreceding, 0)))

    def day_of(self, m: Column, last: bool) -> Column:
        return self.add(("day", last, str(m)), lambda: (F.max if last else F.min)(F.when(m, F.col(DAY))).over(self.person))

    def in_days(self, m: Column, a: int, b: int) -> Column:
        return self.add(("days", str(m), a, b), lambda: F.count(F.when(m, 1)).over(self.days.rangeBetween(a, b)))

    def in_events(self, m: Column, a: int, b: int) -> Column:
        return self.add(("events", str(m), a, b), lambda: F.count(F.when(m, 1)).over(self.rows.rowsBetween(a, b)))

    # -- masks

    def mask(self, node: A.Node) -> Column:
        if node in self.made:
            return F.col(self.made[node])
        found = getattr(self, "_" + type(node).__name__)(node)
        return self.add(node, lambda: found, window=False)

    def _atom(self, node):
        return atom_test(self.log, node)

    _CodeAtom = _EventAtom = _ComparisonAtom = _atom

    def _NotExpr(self, node):
        return ~self.any_of(self.mask(node.child))

    def _BinaryLogical(self, node):
        a, b = self.mask(node.left), self.mask(node.right)
        return (a | b) & self.any_of(a) & self.any_of(b) if node.op == "and" else a | b

    def _PrefixExpr(self, node):
        x = self.mask(node.child)
        if node.kind in ("min", "max", "exactly"):
            n = self.count_of(x)
            held = {"min": n >= node.n, "max": n <= node.n, "exactly": n == node.n}[node.kind]
            return x & held | (n == 0) if node.n == 0 else x & held
        run = self.run_of(x)
        if node.kind == "first":
            return x & (run <= node.n)
        if node.kind == "ordinal" and node.n > 0:
            return x & (run == node.n)
        back = self.count_of(x) - run
        return x & (back < node.n) if node.kind == "last" else x & (back == -node.n - 1)

    def _RangePrefixExpr(self, node):
        x = self.mask(node.child)
        n = self.count_of(x)
        held = x & n.between(node.min_n, node.max_n)
        return held | (n == 0) if node.min_n == 0 else held

    def _TemporalExpr(self, node):
        (left, lq), (right, rq) = A.unquantified(node.left), A.unquantified(node.right)
        right, s = A.unshifted(right)
        l, r = self.mask(left), self.mask(right)
        if node.op == "simultaneously":
            held = self._same_day(l, r, s, lq == "every", rq == "every")
        else:
            held = ordered(node.op, lq, rq, lambda last: self.day_of(l, last), lambda last: self.day_of(r, last) + s)
        return l & F.coalesce(held, F.lit(False))

    def _same_day(self, l, r, s, every_left, every_right):
        met = self.add(("met", str(l), str(r), s), lambda: l & self.dated & (self.in_days(r, -s, -s) > 0))
        tests = [self.any_of(met)]
        if every_left:
            tests.append(self.every_of(l & self.dated, met, ("l", str(l), str(r), s)))
        if every_right:
            tests.append(self.every_of(r & self.dated, self.in_days(l, s, s) > 0, ("r", str(l), str(r), s)))
        return reduce(and_, tests)

    def _near(self, child, ref, spans, s, key) -> Column:
        """Rows of child with a reference, moved by s days, in one of the spans about it; a row isn't its own."""
        own = any(a <= s <= b for a, b in spans)
        hits = reduce(lambda x, y: x + y, [self.in_days(ref, a - s, b - s) for a, b in spans])
        least = F.lit(1) + F.when(ref, 1).otherwise(0) if own else F.lit(1)
        return self.add(("near", key), lambda: child & self.dated & (hits >= least), window=False)

    def _WithinExpr(self, node):
        if isinstance(node.child, A.AggregateExpr):
            return self._aggregate_days(node)
        child, cq = A.unquantified(node.child)
        x = self.mask(child)
        if node.ref is None:
            far = F.abs(F.col(DAY) - self.add("first day", lambda: F.min(F.col(DAY)).over(self.person)))
            hit = F.coalesce(x & far.between(node.min_days, node.days), F.lit(False))
            if cq == "every":
                hit = self.add(("hit", node), lambda: hit, window=False)
                hit = x & self.every_of(x & self.dated, hit, ("every", node))
            return self._outside(node, x, hit) if node.outside else hit
        ref, rq = A.unquantified(node.ref)
        ref, s = A.unshifted(ref)
        y = self.mask(ref)
        spans = bands(node.direction, node.min_days, node.days)
        hit = self._near(x, y, spans, s, (node, "hit"))
        if cq == "every" or rq == "every":
            ok = self.any_of(x) & self.any_of(y)
            if cq == "every":
                ok = ok & self.every_of(x & self.dated, hit, (node, "left"))
            if rq == "every":
                back = [(-b, -a) for a, b in spans]
                own = any(a <= s <= b for a, b in spans)
                seen = reduce(lambda p, q: p + q, [self.in_days(x, a + s, b + s) for a, b in back])
                least = F.lit(1) + F.when(x, 1).otherwise(0) if own else F.lit(1)
                ok = ok & self.every_of(y & self.dated, seen >= least, (node, "right"))
            hit = x & ok
        return self._outside(node, x, hit) if node.outside else hit

    def _outside(self, node, x, hit):
        """Rows of x that aren't hit, of persons for whom the node has an answer."""
        hit = self.add((node, "inside"), lambda: hit, window=False)
        return x & ~hit & self.evaluable(node)

    def _InsideExpr(self, node):
        if isinstance(node.child, A.AggregateExpr):
            return self._aggregate_events(node)
        x, y = self.mask(node.child), self.mask(node.ref)
        hit = x & self._at_events(node, y, own=False)
        return hit if node.inside else x & ~hit & self.any_of(y)

    def _at_events(self, node, y, own):
        """Rows at the places that the window allows about rows of y; own: a row of y may be its own reference."""
        a, b = (node.min_events, node.max_events) if node.direction == "before" else (-node.max_events, -node.min_events)
        n = self.in_events(y, a, b)
        return n >= (F.lit(1) + F.when(y, 1).otherwise(0) if a <= 0 <= b and not own else F.lit(1))

    def _between(self, node, x, low, high):
        hit = F.coalesce(x & F.col(DAY).between(low, high), F.lit(False))
        return self._outside(node, x, hit) if node.outside else hit

    def _BetweenExpr(self, node):
        (a, s), (b, t) = A.unshifted(node.bound_start), A.unshifted(node.bound_end)
        return self._between(node, self.mask(node.child), self.day_of(self.mask(a), False) + s, self.day_of(self.mask(b), True) + t)

    def _WithinSpanExpr(self, node):
        y = self.mask(node.ref)
        return self._between(node, self.mask(node.child), self.day_of(y, False), self.day_of(y, True))

    # -- aggregates

    def _over_person(self, agg: A.AggregateExpr, where: Column | None, key) -> Column:
        """The aggregate over a person's rows where that holds."""
        func = G.SYNONYMS.get(agg.func, agg.func)
        v = number(self.log, agg.column)
        v = self.add(("v", key), lambda: v if where is None else F.when(where, v), window=False)
        if func in G.ORDERED:
            steps = self.add(("steps", key), lambda: G.running(func, relative(self.log, agg), v, self.rows.rowsBetween(Window.unboundedPreceding, 0)))
            return self.add(("agg", key), lambda: F.max(steps).over(self.person))
        return self.add(("agg", key), lambda: G.plain(func, v, relative(self.log, agg), lambda c: c.over(self.person)))

    def _AggregateExpr(self, node):
        return G.compared(self._over_person(node, None, node), node.op, node.value)

    def _framed(self, agg: A.AggregateExpr, frame, key) -> Column:
        """The aggregate over a frame about each row."""
        func = G.SYNONYMS.get(agg.func, agg.func)
        v = self.add(("v", key), lambda: number(self.log, agg.column), window=False)
        if func in G.ORDERED:
            event = F.struct(F.coalesce(DAY, F.lit((1 << 31) - 1)).alias("day"), F.col(TIE).alias("tie"), v.alias("v"))
            events = self.add(("list", key), lambda: F.collect_list(event).over(frame))
            return G.of_array(func, relative(self.log, agg), F.array_sort(events))
        return self.add(("agg", key), lambda: G.plain(func, v, relative(self.log, agg), lambda c: c.over(frame), framed=True, zero=False))

    def _sliding(self, node, agg, frame, base) -> Column:
        """Whether some row's trailing frame passes; base: for rise and fall, what each value is measured from."""
        func = agg.func
        if func in G.ORDERED and not agg.relative and agg.op in (">", ">="):
            test = G.compared(G.change(func, False, number(self.log, agg.column), base()), agg.op, agg.value)
        else:
            test = G.compared(self._framed(agg, frame, node), agg.op, agg.value)
        test = self.add((node, "test"), lambda: test & self.dated if isinstance(node, A.WithinExpr) else test)
        return self.any_of(test)

    def _aggregate_days(self, node):
        agg = node.child
        if node.ref is None:

            def base():
                v = number(self.log, agg.column)
                f, g = (F.min, F.least) if agg.func == "rise" else (F.max, F.greatest)
                earlier = self.add((node, "earlier"), lambda: f(v).over(self.days.rangeBetween(-node.days, -1))) if node.days else F.lit(None).cast("double")
                return g(earlier, self.add((node, "today"), lambda: f(v).over(self.today.rowsBetween(Window.unboundedPreceding, 0))))

            return self._sliding(node, agg, self.days.rangeBetween(-node.days, 0), base)
        ref, rq = A.unquantified(node.ref)
        ref, s = A.unshifted(ref)
        y = self.mask(ref)
        spans = bands(node.direction, node.min_days, node.days)
        if rq == "every":
            return self._per_reference(node, agg, y, spans, s)
        hits = reduce(lambda p, q: p + q, [self.in_days(y, a - s, b - s) for a, b in spans])
        inside = self.add((node, "in"), lambda: self.dated & (hits >= 1), window=False)
        where = ~inside if node.outside else inside
        return G.compared(self._over_person(agg, where, (node, "agg")), agg.op, agg.value) & self.any_of(y)

    def _per_reference(self, node, agg, y, spans, s):
        """Whether the window of every reference passes by itself."""
        func = G.SYNONYMS.get(agg.func, agg.func)
        back = sorted((s - b, s - a) for a, b in spans)
        v = self.add((node, "v"), lambda: number(self.log, agg.column), window=False)
        if len(back) == 1 and func not in G.ORDERED:
            value = self.add((node, "value"), lambda: G.plain(func, v, relative(self.log, agg), lambda c: c.over(self.days.rangeBetween(*back[0])), framed=True))
        else:
            event = F.struct(F.coalesce(DAY, F.lit((1 << 31) - 1)).alias("day"), F.col(TIE).alias("tie"), v.alias("v"))
            lists = [self.add((node, "list", a, b), lambda a=a, b=b: F.collect_list(event).over(self.days.rangeBetween(a, b))) for a, b in back]
            value = G.of_array(func, relative(self.log, agg), F.array_sort(F.concat(*lists)))
        return self.every_of(y & self.dated, G.compared(value, agg.op, agg.value), (node, "every"))

    def _aggregate_events(self, node):
        agg = node.child
        if node.ref is None:
            frame = self.rows.rowsBetween(-(node.max_events - 1), 0)
            return self._sliding(node, agg, frame, lambda: self.add((node, "base"), lambda: (F.min if agg.func == "rise" else F.max)(number(self.log, agg.column)).over(frame)))
        y = self.mask(node.ref)
        at = self.add((node, "at"), lambda: self._at_events(node, y, own=True), window=False)
        return G.compared(self._over_person(agg, at if node.inside else ~at, (node, "agg")), agg.op, agg.value) & self.any_of(y)

    # -- for whom there is an answer

    def evaluable(self, node: A.Node) -> Column:
        """Whether the node has an answer for the row's person: comparisons of times need events on all their sides."""
        has = lambda n: self.any_of(self.mask(A.unshifted(A.unquantified(n)[0])[0]))
        if isinstance(node, A.PrefixExpr | A.RangePrefixExpr):
            return self.evaluable(node.child)
        if isinstance(node, A.ShiftExpr):
            return self.evaluable(A.unshifted(node)[0]) & has(node)
        if isinstance(node, A.Quantifier):
            return has(node) if node.kind == "every" else self.evaluable(node.child)
        if isinstance(node, A.BinaryLogical):
            return (and_ if node.op == "and" else or_)(self.evaluable(node.left), self.evaluable(node.right))
        if isinstance(node, A.WithinExpr | A.InsideExpr) and isinstance(node.child, A.AggregateExpr):
            return F.lit(True) if node.ref is None else self.evaluable(node.ref) & has(node.ref)
        sides = {A.TemporalExpr: ("left", "right"), A.WithinExpr: ("child", "ref"), A.InsideExpr: ("child", "ref")}.get(type(node))
        if sides:
            return reduce(and_, [self.evaluable(n) & has(n) for n in (getattr(node, x) for x in sides) if n is not None])
        if isinstance(node, A.BetweenExpr):
            bounds = [node.bound_start, node.bound_end]
            return reduce(and_, [self.evaluable(node.child), *(self.evaluable(b) & has(b) for b in bounds)])
        if isinstance(node, A.WithinSpanExpr):
            return self.evaluable(node.child) & self.evaluable(node.ref) & has(node.ref)
        return F.lit(True)


def ordered(op: str, lq: str | None, rq: str | None, left, right) -> Column:
    """The test of before and after on the sides' first and last days: left(last) and right(last)."""
    every_left, every_right = lq == "every", rq == "every"
    universal = every_left or every_right
    if op == "before":
        return left(every_left) < right(every_left and not every_right or not universal and rq == "any")
    return left(every_right and not every_left or not universal and lq == "any") > right(every_right)


class PersonPlan:
    """Compiles queries whose answer needs only aggregates of a person's rows: one grouped aggregation with partial sums before the shuffle, which
    moves a row per person and task in place of every event. can() says whether a query is of that kind.

    The mask of a node is a list of (row test, its name, person test): the rows for which any such pair of tests holds."""

    def __init__(self, log: EventLog):
        self.log, self.parts = log, {}

    def part(self, key, aggregate: Column) -> Column:
        return F.col(self.parts.setdefault(key, (f"__a{len(self.parts)}", aggregate))[0])

    def any_of(self, mask) -> Column:
        return reduce(or_, [F.coalesce(self.part(("any", k), F.max(r)), F.lit(False)) & g for r, k, g in mask])

    def day_of(self, mask, last: bool) -> Column:
        days = [F.when(g, self.part(("day", last, k), (F.max if last else F.min)(F.when(r, F.col(DAY))))) for r, k, g in mask]
        return days[0] if len(days) == 1 else (F.greatest if last else F.least)(*days)

    def count_of(self, mask) -> Column:
        if len(mask) > 1:
            raise NotImplementedError
        r, k, g = mask[0]
        return F.when(g, self.part(("count", k), F.count(F.when(r, 1)))).otherwise(0)

    def mask(self, node: A.Node) -> list:
        yes = F.lit(True)
        if isinstance(node, A.CodeAtom | A.EventAtom | A.ComparisonAtom):
            return [(atom_test(self.log, node), node, yes)]
        if isinstance(node, A.NotExpr):
            return [(yes, "all", ~self.any_of(self.mask(node.child)))]
        if isinstance(node, A.BinaryLogical):
            a, b = self.mask(node.left), self.mask(node.right)
            if node.op == "or":
                return a + b
            both = self.any_of(a) & self.any_of(b)
            return [(r, k, g & both) for r, k, g in a + b]
        if isinstance(node, A.PrefixExpr | A.RangePrefixExpr):
            x = self.mask(node.child)
            n = self.count_of(x)
            low = node.min_n if isinstance(node, A.RangePrefixExpr) else node.n
            if isinstance(node, A.RangePrefixExpr):
                held = n.between(node.min_n, node.max_n)
            elif node.kind in ("min", "max", "exactly"):
                held = {"min": n >= low, "max": n <= low, "exactly": n == low}[node.kind]
            else:
                raise NotImplementedError
            return [(r, k, g & held) for r, k, g in x] + ([(yes, "all", n == 0)] if low == 0 else [])
        if isinstance(node, A.TemporalExpr) and node.op != "simultaneously":
            (left, lq), (right, rq) = A.unquantified(node.left), A.unquantified(node.right)
            right, s = A.unshifted(right)
            l, r = self.mask(left), self.mask(right)
            held = F.coalesce(ordered(node.op, lq, rq, lambda last: self.day_of(l, last), lambda last: self.day_of(r, last) + s), F.lit(False))
            return [(row, k, g & held) for row, k, g in l]
        if isinstance(node, A.AggregateExpr):
            func = G.SYNONYMS.get(node.func, node.func)
            if func not in G.ORDERED:
                v = number(self.log, node.column)
                value = G.plain(func, v, relative(self.log, node), lambda c: self.part((node, len(self.parts)), c))
                return [(yes, "all", G.compared(value, node.op, node.value))]
        raise NotImplementedError

    def persons(self, node: A.Node, where: Column | None = None) -> DataFrame:
        """Persons and, as `match`, whether they have a row; where: rows that can matter."""
        match = self.any_of(self.mask(node))
        df = self.log.prepared(ordered=False)
        df = df if where is None else df.where(where)
        pid = self.log.pid
        return df.groupBy(pid.alias(self.log.config.pid)).agg(*[a.alias(n) for n, a in self.parts.values()]).select(pid, match.alias("match"))


def needed(log: EventLog, node: A.Node) -> Column | None:
    """A test of the rows that can matter to who matches, to be pushed to the scan; None if all can: where absence, places in the timeline, its first
    date, or numbers of any row count."""
    tests = []
    for n in node.walk():
        every_row = isinstance(n, A.EventAtom | A.NotExpr | A.AggregateExpr | A.InsideExpr)
        zero = isinstance(n, A.PrefixExpr) and n.n == 0 or isinstance(n, A.RangePrefixExpr) and n.min_n == 0
        if every_row or zero or isinstance(n, A.WithinExpr) and n.ref is None:
            return None
        if isinstance(n, A.CodeAtom | A.ComparisonAtom):
            tests.append(n)
    return reduce(or_, [atom_test(log, n, filtering=True) for n in dict.fromkeys(tests)]) if tests else None

"""Queries answered event by event in plain Python, from the rules alone: what the compiler is held against."""

from __future__ import annotations

import math
import statistics

from timelineql.plans import ast as A

OPS = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def fits(code, pattern):
    if code is None:
        return False
    if pattern.endswith("*"):
        return code.startswith(pattern[:-1])
    a, dash, b = pattern.partition("-")
    return a <= code <= b if dash and b else code == pattern


def aggregate(func, relative, values, empty_sum=0.0):
    v = [x for x in values if x is not None and not math.isnan(x)]
    if func == "sum":
        return math.fsum(v) if v else empty_sum
    if func in ("count", "n"):
        return float(len(v))
    if not v:
        return None
    if func in ("mean", "avg"):
        return math.fsum(v) / len(v)
    if func in ("min", "max"):
        return (min if func == "min" else max)(v)
    if func == "median":
        return statistics.median(v)
    if func in ("sd", "var"):
        return None if len(v) < 2 else (statistics.stdev if func == "sd" else statistics.variance)(v)
    if func == "range":
        return (((max(v) - min(v)) / min(v)) if min(v) > 0 else None) if relative else max(v) - min(v)
    best, base = None, None
    for x in v:
        base = x if base is None else (min if func == "rise" else max)(base, x)
        gap = x - base if func == "rise" else base - x
        if relative:
            gap = gap / base if base > 0 else 0.0
        best = gap if best is None else max(best, gap)
    return best


def passes(node, value):
    return value is not None and OPS[node.op](value, node.value)


class Person:
    """events: dicts in order, with day (or None), codes and numbers."""

    def __init__(self, events):
        self.e = events
        self.n = range(len(events))

    def days(self, mask, s=0):
        return [self.e[i]["day"] + s for i in self.n if mask[i] and self.e[i]["day"] is not None]

    def near(self, i, refs, node, s, own=False):
        q = self.e[i]["day"]
        if q is None:
            return False
        for j in self.n:
            t = self.e[j]["day"]
            if not refs[j] or t is None or (j == i and not own):
                continue
            gap = q - (t + s)
            lo, hi = node.min_days, node.days
            if node.direction == "after" and lo <= gap <= hi or node.direction == "before" and lo <= -gap <= hi:
                return True
            if node.direction == "around" and (lo <= gap <= hi if lo < 0 else lo <= abs(gap) <= hi):
                return True
        return False

    def mask(self, node):
        return getattr(self, type(node).__name__)(node)

    def CodeAtom(self, node):
        columns = node.columns or ("icd",)
        return [any(fits(e[c], p) for c in columns for p in node.codes) for e in self.e]

    def EventAtom(self, node):
        return [True for _ in self.e]

    def ComparisonAtom(self, node):
        return [passes(node, e[node.column]) for e in self.e]

    def AggregateExpr(self, node):
        ok = passes(node, aggregate(node.func, node.relative, [e[node.column] for e in self.e]))
        return [ok for _ in self.e]

    def NotExpr(self, node):
        ok = not any(self.mask(node.child))
        return [ok for _ in self.e]

    def BinaryLogical(self, node):
        a, b = self.mask(node.left), self.mask(node.right)
        ok = node.op == "or" or any(a) and any(b)
        return [ok and (x or y) for x, y in zip(a, b)]

    def PrefixExpr(self, node):
        x = self.mask(node.child)
        at = [i for i in self.n if x[i]]
        k, n = len(at), node.n
        if node.kind in ("min", "max", "exactly"):
            ok = {"min": k >= n, "max": k <= n, "exactly": k == n}[node.kind]
            return [True for _ in self.e] if n == 0 and k == 0 else [x[i] and ok for i in self.n]
        chosen = {"first": at[:n], "last": at[-n:] if n else [], "ordinal": at[n - 1 : n] if n > 0 else at[n : n + 1 or None] if -n <= k else []}[node.kind]
        return [i in chosen for i in self.n]

    def RangePrefixExpr(self, node):
        x = self.mask(node.child)
        k = sum(x)
        if node.min_n == 0 and k == 0:
            return [True for _ in self.e]
        return [v and node.min_n <= k <= node.max_n for v in x]

    def TemporalExpr(self, node):
        (left, lq), (right, rq) = A.unquantified(node.left), A.unquantified(node.right)
        right, s = A.unshifted(right)
        lm = self.mask(left)
        x, y = self.days(lm), self.days(self.mask(right), s)
        if not x or not y:
            ok = False
        elif node.op == "simultaneously":
            ok = bool(set(x) & set(y)) and (lq != "every" or set(x) <= set(y)) and (rq != "every" or set(y) <= set(x))
        else:
            every = "every" in (lq, rq)
            if node.op == "before":
                a = max(x) if lq == "every" else min(x)
                b = min(y) if lq == rq == "every" else max(y) if lq == "every" or not every and rq == "any" else min(y)
                ok = a < b
            else:
                b = max(y) if rq == "every" else min(y)
                a = min(x) if lq == rq == "every" else max(x) if rq == "every" or not every and lq == "any" else min(x)
                ok = a > b
        return [v and ok for v in lm]

    def WithinExpr(self, node):
        if isinstance(node.child, A.AggregateExpr):
            return self.days_aggregate(node)
        child, cq = A.unquantified(node.child)
        x = self.mask(child)
        dated = [e["day"] is not None for e in self.e]
        if node.ref is None:
            first = min((e["day"] for e in self.e if e["day"] is not None), default=None)
            hit = [x[i] and dated[i] and node.min_days <= abs(self.e[i]["day"] - first) <= node.days for i in self.n]
            ok = any(x)
            y = None
            if cq == "every":
                ok = any(x[i] and dated[i] for i in self.n) and all(hit[i] for i in self.n if x[i] and dated[i])
                hit = [v and ok for v in x]
        else:
            ref, rq = A.unquantified(node.ref)
            ref, s = A.unshifted(ref)
            y = self.mask(ref)
            hit = [x[i] and self.near(i, y, node, s) for i in self.n]
            if "every" in (cq, rq):
                ok = any(x) and any(y)
                if cq == "every":
                    ok = ok and any(x[i] and dated[i] for i in self.n) and all(hit[i] for i in self.n if x[i] and dated[i])
                if rq == "every":
                    rows = [j for j in self.n if y[j] and dated[j]]
                    ok = ok and bool(rows) and all(any(self.near(i, [k == j for k in self.n], node, s) for i in self.n if x[i]) for j in rows)
                hit = [v and ok for v in x]
        if not node.outside:
            return hit
        ok = self.evaluable(node)
        return [x[i] and not hit[i] and ok for i in self.n]

    def InsideExpr(self, node):
        if isinstance(node.child, A.AggregateExpr):
            return self.events_aggregate(node)
        x, y = self.mask(node.child), self.mask(node.ref)
        hit = [x[i] and any(y[j] and j != i and self.placed(i, j, node) for j in self.n) for i in self.n]
        return hit if node.inside else [x[i] and not hit[i] and any(y) for i in self.n]

    def placed(self, i, j, node):
        gap = j - i if node.direction == "before" else i - j
        return node.min_events <= gap <= node.max_events

    def bounded(self, node, x, low, high):
        hit = [x[i] and low is not None and high is not None and e["day"] is not None and low <= e["day"] <= high for i, e in enumerate(self.e)]
        if not node.outside:
            return hit
        ok = self.evaluable(node)
        return [x[i] and not hit[i] and ok for i in self.n]

    def BetweenExpr(self, node):
        (a, s), (b, t) = A.unshifted(node.bound_start), A.unshifted(node.bound_end)
        return self.bounded(node, self.mask(node.child), min(self.days(self.mask(a), s), default=None), max(self.days(self.mask(b), t), default=None))

    def WithinSpanExpr(self, node):
        y = self.days(self.mask(node.ref))
        return self.bounded(node, self.mask(node.child), min(y, default=None), max(y, default=None))

    def days_aggregate(self, node):
        agg = node.child
        v = lambda rows: [self.e[i][agg.column] for i in rows]
        if node.ref is None:
            ok = False
            for i in self.n:
                d = self.e[i]["day"]
                if d is not None:
                    ok |= passes(agg, aggregate(agg.func, agg.relative, v(j for j in self.n if self.e[j]["day"] is not None and d - node.days <= self.e[j]["day"] <= d), None))
            return [ok for _ in self.e]
        ref, rq = A.unquantified(node.ref)
        ref, s = A.unshifted(ref)
        y = self.mask(ref)
        if rq == "every":
            refs = [j for j in self.n if y[j] and self.e[j]["day"] is not None]
            ok = bool(refs) and all(passes(agg, aggregate(agg.func, agg.relative, v(i for i in self.n if self.near(i, [k == j for k in self.n], node, s, own=True)))) for j in refs)
        else:
            inside = [self.near(i, y, node, s, own=True) for i in self.n]
            ok = any(y) and passes(agg, aggregate(agg.func, agg.relative, v(i for i in self.n if inside[i] != node.outside)))
        return [ok for _ in self.e]

    def events_aggregate(self, node):
        agg = node.child
        v = lambda rows: [self.e[i][agg.column] for i in rows]
        if node.ref is None:
            ok = any(passes(agg, aggregate(agg.func, agg.relative, v(range(max(0, i - node.max_events + 1), i + 1)), None)) for i in self.n)
        else:
            y = self.mask(node.ref)
            inside = [any(y[j] and self.placed(i, j, node) for j in self.n) for i in self.n]
            ok = any(y) and passes(agg, aggregate(agg.func, agg.relative, v(i for i in self.n if inside[i] == node.inside)))
        return [ok for _ in self.e]

    def has(self, node):
        return any(self.mask(A.unshifted(A.unquantified(node)[0])[0]))

    def evaluable(self, node):
        if isinstance(node, A.PrefixExpr | A.RangePrefixExpr):
            return self.evaluable(node.child)
        if isinstance(node, A.ShiftExpr):
            return self.evaluable(node.child) and self.has(node)
        if isinstance(node, A.Quantifier):
            return self.has(node.child) if node.kind == "every" else True
        if isinstance(node, A.BinaryLogical):
            a, b = self.evaluable(node.left), self.evaluable(node.right)
            return a and b if node.op == "and" else a or b
        if isinstance(node, A.WithinExpr | A.InsideExpr):
            sides = [node.ref] if isinstance(node.child, A.AggregateExpr) else [node.child, node.ref]
            return all(self.evaluable(n) and self.has(n) for n in sides if n is not None)
        if isinstance(node, A.TemporalExpr):
            return all(self.evaluable(n) and self.has(n) for n in (node.left, node.right))
        if isinstance(node, A.BetweenExpr):
            return self.evaluable(node.child) and all(self.evaluable(n) and self.has(n) for n in (node.bound_start, node.bound_end))
        if isinstance(node, A.WithinSpanExpr):
            return self.evaluable(node.child) and self.evaluable(node.ref) and self.has(node.ref)
        return True

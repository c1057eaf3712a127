"""Templates of queries, counted in one job: `K5?[0,1,2] before K51`."""

from __future__ import annotations

import re
import warnings
from itertools import product

from pyspark.sql import functions as F

from ..errors import CodeError, QuerySyntaxError
from ..plans.compiler import PersonPlan, RowPlan, check
from ..plans.parser import parse
from ..sources.eventlog import EventLog

SLOT = re.compile(r"\?\[([^\]]+)\]")


def slot_values(content: str) -> list[str]:
    """`a,b`, `0-9`, `50-53` or `a-d`."""
    if m := re.fullmatch(r"\s*(\d+)-(\d+)\s*", content):
        return [str(i) for i in range(int(m[1]), int(m[2]) + 1)]
    if m := re.fullmatch(r"\s*([A-Za-z])-([A-Za-z])\s*", content):
        return [chr(i) for i in range(ord(m[1]), ord(m[2]) + 1)]
    return [x.strip() for x in content.split(",")]


def variants(template: str, max_combinations: int = 1000) -> list[str]:
    texts = SLOT.split(template)
    choices = [slot_values(x) for x in texts[1::2]]
    n = 1
    for c in choices:
        n *= len(c)
    if n > max_combinations:
        raise ValueError(f"the template has {n} variants; at most {max_combinations} are allowed")
    if n > 100:
        warnings.warn(f"the template has {n} variants", stacklevel=3)
    return ["".join(x for pair in zip(texts[::2], [*combo, ""]) for x in pair) for combo in product(*choices)]


def multi_query(log: EventLog, template: str, max_combinations: int = 1000) -> dict[str, int]:
    """Persons who match each variant; those that are no queries, or of unknown codes, have 0. All are counted together, with one shuffle."""
    texts = variants(template, max_combinations)
    nodes = {}
    for t in texts:
        try:
            node = parse(t)
            check(node)
            nodes[t] = node
        except (QuerySyntaxError, CodeError):
            if len(texts) == 1:
                raise
    pid = log.config.pid
    try:
        plan = PersonPlan(log)
        flags = [plan.any_of(plan.mask(n)).alias(f"q{i}") for i, n in enumerate(nodes.values())]
        people = log.prepared(ordered=False).groupBy(log.pid.alias(pid)).agg(*[a.alias(n) for n, a in plan.parts.values()] or [F.lit(1)]).select(pid, *flags)
    except NotImplementedError:
        plan = RowPlan(log)
        flags = [F.max(plan.mask(n)).alias(f"q{i}") for i, n in enumerate(nodes.values())]
        people = plan.df.groupBy(pid).agg(*flags)
    counts = people.where(F.col(f"`{pid}`").isNotNull()).agg(*[F.count(F.when(F.col(f"q{i}"), 1)).alias(f"q{i}") for i in range(len(nodes))] or [F.lit(0)]).collect()[0]
    found = dict(zip(nodes, counts))
    return {t: found.get(t, 0) for t in texts}

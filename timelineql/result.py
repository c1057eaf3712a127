"""What a query returns: lazy tables of rows and persons, and counts and percentages that run when asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import ast as A
from .plans.compiler import PersonPlan, RowPlan, check, needed
from .plans.parser import parse
from .sources.eventlog import EventLog


class Result:
    """One query over one log. Methods and properties named after tables are DataFrames; counts run a job each, once."""

    def __init__(self, log: EventLog, query: str | A.Node, lean: EventLog | None = None):
        self.log, self.query = log, query
        self.node = parse(query) if isinstance(query, str) else query
        #: The log with only the rows that matter to who matches, if that is another one.
        self.lean = lean or log
        check(self.node)

    @property
    def _pid(self) -> str:
        return self.log.config.pid

    def flagged(self, *more: A.Node, log: EventLog | None = None, evaluable: bool = False) -> DataFrame:
        """The events with a column `match`, then m0.. for more nodes, and `evaluable` if asked. Events of null ids are of no person, and match nothing."""
        log = log or self.log
        plan = RowPlan(log.of_persons())
        columns = [plan.mask(n) for n in (self.node, *more)]
        names = ["match", *(f"m{i}" for i in range(len(more)))]
        if evaluable:
            columns, names = [*columns, plan.evaluable(self.node)], [*names, "evaluable"]
        kept = [F.col(f"`{c}`") for c in self.log.df.columns if c not in names and c != "evaluable"]
        out = plan.df.select(*kept, *[c.alias(n) for c, n in zip(columns, names)])
        return out.union(log.df.where(log.pid.isNull()).select(*kept, *[F.lit(False).alias(n) for n in names]))

    @cached_property
    def rows(self) -> DataFrame:
        """All events, with `match`."""
        return self.flagged()

    @cached_property
    def persons(self) -> DataFrame:
        """All persons, with `match`; null ids are no persons."""
        return self._persons(self.log).where(F.col(f"`{self._pid}`").isNotNull())

    def _persons(self, log: EventLog, prune: bool = False) -> DataFrame:
        where = needed(log, self.node) if prune else None
        try:
            return PersonPlan(log).persons(self.node, where)
        except NotImplementedError:
            pruned = log if where is None else EventLog(log.df.where(where), log.config)
            return self.flagged(log=pruned).groupBy(self._pid).agg(F.max("match").alias("match"))

    @cached_property
    def pids(self) -> DataFrame:
        """The ids of persons who match. Rows that can't matter are filtered at the scan."""
        return self._persons(self.lean, prune=True).where("match").where(F.col(f"`{self._pid}`").isNotNull()).select(self._pid)

    @cached_property
    def count(self) -> int:
        return self.pids.count()

    @cached_property
    def total(self) -> int:
        return self.log.df.select(self._pid).where(F.col(f"`{self._pid}`").isNotNull()).distinct().count()

    @cached_property
    def event_counts(self) -> DataFrame:
        """How many rows match, for every person: 0 too."""
        return self.rows.where(F.col(f"`{self._pid}`").isNotNull()).groupBy(self._pid).agg(F.count(F.when(F.col("match"), 1)).alias("n"))

    @cached_property
    def _answers(self) -> DataFrame:
        return self.flagged(evaluable=True).where(F.col(f"`{self._pid}`").isNotNull()).groupBy(self._pid).agg(F.max("match").alias("match"), F.max("evaluable").alias("evaluable"))

    @cached_property
    def evaluable_pids(self) -> DataFrame:
        """The persons for whom the query has an answer."""
        return self._answers.where("evaluable").select(self._pid)

    @cached_property
    def _counts(self):
        return self._answers.agg(F.count("*").alias("total"), F.count(F.when(F.col("evaluable"), 1)).alias("evaluable"), F.count(F.when(F.col("match"), 1)).alias("count")).collect()[0]

    @cached_property
    def evaluable(self) -> int:
        return self._counts["evaluable"]

    def pct(self, dropna: bool = True) -> float:
        """The percentage of persons who match: of those with an answer, or of all."""
        c = self._counts
        of = c["evaluable"] if dropna else c["total"]
        return 100.0 * c["count"] / of if of else 0.0

    def mask(self, query: str | A.Node, level: str = "rows") -> DataFrame:
        """The events with m0 for another query, beside `match`; at level persons, whether the person has such a row."""
        if level not in ("rows", "persons"):
            raise ValueError(f"level is 'rows' or 'persons', not {level!r}")
        node = parse(query) if isinstance(query, str) else query
        check(node)
        if level == "rows":
            return self.flagged(node)
        plan = RowPlan(self.log.of_persons())
        match, other = plan.any_of(plan.mask(self.node)), plan.any_of(plan.mask(node))
        kept = [F.col(f"`{c}`") for c in self.log.df.columns]
        nobody = self.log.df.where(self.log.pid.isNull()).select(*kept, F.lit(False).alias("match"), F.lit(False).alias("m0"))
        return plan.df.select(*kept, match.alias("match"), other.alias("m0")).union(nobody)

    def filter(self, level: str = "persons") -> DataFrame:
        """The matching events, or all events of matching persons; none of null ids."""
        if level not in ("rows", "persons"):
            raise ValueError(f"level is 'rows' or 'persons', not {level!r}")
        plan = RowPlan(self.log.of_persons())
        m = plan.mask(self.node)
        if level == "persons":
            m = plan.any_of(m)
        return plan.df.where(m).select(*[F.col(f"`{c}`") for c in self.log.df.columns])

    def __repr__(self) -> str:
        return f"Result({self.query!r})"

    def summary(self) -> str:
        c = self._counts
        return f"{self.query}: {c['count']} of {c['evaluable']} persons with an answer ({self.pct():.1f} %), {c['total']} in all ({self.pct(False):.1f} %)"

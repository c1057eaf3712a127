"""Event logs: a table of events with a person, a date, codes and numbers, made ready for queries; and several of them as one."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, get_config
from ..errors import ColumnError
from ..functions.codes import code_columns

DAY, TIE = "__day", "__tie"


def day_of(df: DataFrame, column: str) -> Column:
    """The day of a column of dates, times or texts as a whole number; null where there's none, or a text is no date."""
    date = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.StringType):
        date = F.try_to_timestamp(date)
    return F.unix_date(F.to_date(date))


class EventLog:
    """A table and its settings. Events are ordered by day, then date, then the tie columns; without those, by their order as read, which holds for one
    plan over unchanged files but not for shuffled input: name tie columns where that matters."""

    def __init__(self, df: DataFrame, config: Config | None = None, **given):
        self.config = (config or get_config()).but(**given)
        self.df = df
        for c in (self.config.pid, self.config.date, *(self.config.tie or ())):
            if c not in df.columns:
                raise ColumnError(f"no column {c!r}; there are {df.columns}")
        if not isinstance(df.schema[self.config.date].dataType, T.DateType | T.TimestampType | T.TimestampNTZType | T.StringType):
            raise ColumnError(f"{self.config.date!r} is no date")
        cols = self.config.cols
        self.code_columns = code_columns(df, self.config.pid, self.config.date) if cols is None else [cols] if isinstance(cols, str) else list(cols)
        if missing := [c for c in self.code_columns if c not in df.columns]:
            raise ColumnError(f"no columns {missing}; there are {df.columns}")

    @property
    def pid(self) -> Column:
        return F.col(f"`{self.config.pid}`")

    def of_persons(self) -> EventLog:
        """The log without events of null ids, which belong to no person: they would all meet in one partition."""
        return EventLog(self.df.where(self.pid.isNotNull()), self.config)

    def day(self) -> Column:
        """The day as a whole number; null where there's no date."""
        return day_of(self.df, self.config.date)

    def prepared(self, ordered: bool = True) -> DataFrame:
        """The table with its day and, if ordered, a struct to order events of a day by."""
        out = self.df.withColumn(DAY, self.day())
        if not ordered:
            return out
        tie = [F.col(f"`{c}`") for c in self.config.tie] if self.config.tie else [F.monotonically_increasing_id()]
        return out.withColumn(TIE, F.struct(F.col(f"`{self.config.date}`").alias("date"), *[t.alias(f"t{i}") for i, t in enumerate(tie)]))

    def period(self, start: str | None = None, end: str | None = None) -> EventLog:
        """Only the events from start to end, both included; queries then know of no others. Events without a date are in no period."""
        df, text = self.df, isinstance(self.df.schema[self.config.date].dataType, T.StringType)
        date = F.date_from_unix_date(self.day()) if text else F.to_date(F.col(f"`{self.config.date}`"))
        if start is not None:
            df = df.where(date >= F.to_date(F.lit(start)))
        if end is not None:
            df = df.where(date <= F.to_date(F.lit(end)))
        return EventLog(df, self.config)

    def year(self, year: int) -> EventLog:
        return self.period(f"{year}-01-01", f"{year}-12-31")

    # -- what can be asked of a log; each is also a function of its module

    def query(self, expr, **given):
        from .. import query

        return query(self, expr, **given)

    def count(self, expr) -> int:
        return self.query(expr).count

    def pct(self, expr, dropna: bool = True) -> float:
        return self.query(expr).pct(dropna)

    def mask(self, expr, level: str = "rows") -> DataFrame:
        """The events with `match`: of the row, or of its person."""
        r = self.query(expr)
        return r.rows if level == "rows" else r.mask(expr, level).drop("m0")

    def event_counts(self, expr) -> DataFrame:
        return self.query(expr).event_counts

    def multi(self, template: str, max_combinations: int = 1000) -> dict[str, int]:
        from ..operators.batch import multi_query

        return multi_query(self, template, max_combinations)

    def labels(self, cols=None) -> DataFrame:
        from ..functions.codebook import labelled

        return labelled(self, cols)

    def count_codes(self, cols=None, per_person: bool = False, pattern: str | None = None) -> DataFrame:
        from ..functions.codebook import count_codes

        return count_codes(self, cols, per_person, pattern)

    def search_codes(self, keyword: str, system: str | None = None) -> list[dict]:
        from ..functions.codebook import get_codebook

        return get_codebook(*([self.config.codebooks_dir] if self.config.codebooks_dir else [])).search(keyword, system)

    def __getattr__(self, name: str):
        """Incidence, pattern strings and the cross-check of evaluators, as methods."""
        from ..operators import incidence, stringeval, stringify

        home = {
            **dict.fromkeys(("raw_incidence", "incidence", "washout_pattern", "singles_pattern"), incidence),
            **dict.fromkeys(("stringify_order", "stringify_time", "stringify_durations"), stringify),
            **dict.fromkeys(("string_query_auto", "cross_validate"), stringeval),
        }.get(name)
        if home is None:
            raise AttributeError(name)
        return partial(getattr(home, name), self)


def combine(tables: Sequence[DataFrame] | Mapping[str, DataFrame], names: Sequence[str] | None = None, *, pid: str | None = None, date: str | None = None, source_col: str = "__source__", config: Config | None = None) -> DataFrame:
    """The union of event tables by column names, each row with its source's name. Dates that aren't become null; person ids of mixed types, strings."""
    config = (config or get_config()).but(pid=pid, date=date)
    if isinstance(tables, Mapping):
        names, tables = list(tables), list(tables.values())
    tables = list(tables)
    if not tables:
        raise ValueError("there are no tables to combine")
    names = [f"source_{i}" for i in range(len(tables))] if names is None else list(names)
    if len(names) != len(tables):
        raise ValueError(f"{len(names)} names for {len(tables)} tables")
    for name, t in zip(names, tables):
        for c in (config.pid, config.date):
            if c not in t.columns:
                raise ColumnError(f"{name} has no column {c!r}")
    kinds = [t.schema[config.pid].dataType for t in tables]
    mixed = len({isinstance(k, T.StringType) for k in kinds}) > 1
    if len(set(map(str, kinds))) > 1:
        warnings.warn(f"{config.pid} has different types: {[k.simpleString() for k in kinds]}", stacklevel=2)

    def ready(name: str, t: DataFrame) -> DataFrame:
        date = F.col(f"`{config.date}`")
        if isinstance(t.schema[config.date].dataType, T.StringType):
            t = t.withColumn(config.date, F.try_to_timestamp(date))
        elif isinstance(t.schema[config.date].dataType, T.DateType | T.TimestampNTZType):
            t = t.withColumn(config.date, date.cast("timestamp"))
        if mixed:
            t = t.withColumn(config.pid, F.col(f"`{config.pid}`").cast("string"))
        return t.withColumn(source_col, F.lit(name))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [ready(n, t) for n, t in zip(names, tables)])


def make_test_data(spark: SparkSession, n_persons: int = 100, events_per_person: int = 10, codes: Sequence[str] = ("K50", "K50.1", "K51", "K52", "L04AB02", "X10"), start_year: int = 2015, end_year: int = 2023, seed: int = 42) -> DataFrame:
    """Made-up events: about so many per person, one at least, with dates over whole years, codes, and two numbers of which one is sparse."""
    days = (end_year - start_year + 1) * 365
    people = spark.range(n_persons).withColumnRenamed("id", "pid")
    many = people.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.rand(seed) * 2 * events_per_person).cast("int")))))
    out = many.select("pid", F.date_add(F.lit(f"{start_year}-01-01").cast("date"), (F.rand(seed + 1) * days).cast("int")).alias("start_date"), F.element_at(F.array(*map(F.lit, codes)), (F.rand(seed + 2) * len(codes)).cast("int") + 1).alias("icd"), F.round(F.rand(seed + 3) * 99 + 1, 2).alias("dose"))
    return out.withColumn("dose_k", F.when(F.col("icd").startswith("K"), F.col("dose")))

"""Treatment patterns as strings: one character per event in order, or tracks of one character per period of time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnError
from ..functions import stringops as S
from ..functions.codes import any_code, expand, label_of
from ..sources.eventlog import DAY, TIE, EventLog, day_of

Labels = Mapping[str, str | Sequence[str]]
Bound = str | dt.date | Mapping | None


def prepared(log: EventLog, codes: Labels, first_date: Bound = None, last_date: Bound = None) -> DataFrame:
    """The labelled events of known persons and days within the bounds, with columns __day, __tie and __label. A bound is a date, a column, or a date per person;
    events and persons whose bound is missing or no date are left out."""
    patterns = [p for v in codes.values() for p in expand([v] if isinstance(v, str) else v)]
    df = log.prepared().where(any_code(log.df, log.code_columns, patterns, log.config.sep)).where(log.pid.isNotNull() & F.col(DAY).isNotNull())
    for bound, last in ((first_date, False), (last_date, True)):
        if bound is None:
            continue
        if isinstance(bound, Mapping):
            given = df.sparkSession.createDataFrame([(k, str(v)[:10]) for k, v in bound.items()], f"`__p` {log.df.schema[log.config.pid].dataType.simpleString()}, __b string")
            df = df.join(given, log.pid == F.col("__p"), "left").withColumn("__b", F.unix_date(F.to_date("__b"))).drop("__p")
        else:
            edge = day_of(df, bound) if isinstance(bound, str) and bound in df.columns else F.unix_date(F.to_date(F.lit(str(bound))))
            df = df.withColumn("__b", edge)
        df = df.where(F.col(DAY) <= F.col("__b") if last else F.col(DAY) >= F.col("__b")).drop("__b")
    return df.withColumn("__label", label_of(log.df, codes, log.code_columns, log.config.sep)).where("__label is not null")


def stringify_order(log: EventLog, codes: Labels, *, keep_repeats: bool = True, only_unique: bool = False, first_date: Bound = None, last_date: Bound = None) -> DataFrame:
    """(pid, pattern): a label per event, in order."""
    events = prepared(log, codes, first_date, last_date).groupBy(log.config.pid).agg(F.array_sort(F.collect_list(F.struct(DAY, TIE, F.col("__label").alias("label")))).alias("e"))
    s = F.array_join(F.transform("e", lambda x: x["label"]), "")
    s = s if keep_repeats else S.del_repeats(s)
    return events.select(log.config.pid, (S.first_of_each(s) if only_unique else s).alias("pattern"))


def _tracks(log: EventLog, spans: DataFrame, codes: Labels, no_event: str, merge: bool) -> DataFrame:
    """From rows with __label, __from and __to (places): a string per label, or all interleaved."""
    pid, labels = log.config.pid, list(codes)
    n = F.greatest(F.max("__to"), F.lit(0)) + 1
    held = [F.array_distinct(F.flatten(F.collect_list(F.when((F.col("__label") == x) & (F.col("__to") >= F.greatest("__from", F.lit(0))), F.sequence(F.greatest("__from", F.lit(0)), F.greatest("__to", F.lit(0))))))).alias(f"__h{i}") for i, x in enumerate(labels)]
    seen = [F.max(F.col("__label") == x).alias(f"__s{i}") for i, x in enumerate(labels)]
    people = spans.groupBy(pid).agg(n.cast("int").alias("__n"), *held, *seen)

    def track(i: int, x: str) -> Column:
        line = F.array_join(F.transform(S.places(F.col("__n")), lambda k: F.when(F.array_contains(f"__h{i}", k - 1), x).otherwise(no_event)), "")
        return F.when(F.col(f"__s{i}"), line).otherwise(no_event)

    out = people.select(pid, *[track(i, x).alias(x) for i, x in enumerate(labels)])
    return out.select(pid, S.interleave(labels, no_event=no_event).alias("pattern")) if merge else out


def stringify_time(log: EventLog, codes: Labels, *, step: int = 90, no_event: str = " ", merge: bool = True, first_date: Bound = None, last_date: Bound = None) -> DataFrame:
    """Tracks with a label in each period of step days, from the person's first event, that has such an event: interleaved as (pid, pattern), or a column each."""
    events = prepared(log, codes, first_date, last_date)
    first = events.groupBy(log.config.pid).agg(F.min(DAY).alias("__first"))
    at = F.floor((F.col(DAY) - F.col("__first")) / step).cast("int")
    spans = events.join(first, log.config.pid).withColumns({"__from": at, "__to": at})
    return _tracks(log, spans, codes, no_event, merge)


def stringify_durations(log: EventLog, codes: Labels, *, event_end: str | None = None, event_duration: str | None = None, step: int = 120, no_event: str = " ", merge: bool = True, first_date: Bound = None, last_date: Bound = None) -> DataFrame:
    """Tracks with a label in all periods from an event's start to its end, by a column of end dates or of days."""
    end, days = event_end or log.config.event_end, event_duration or log.config.event_duration
    if end is None and days is None:
        raise ValueError("events need event_end or event_duration")
    for c in (end if end is not None else days,):
        if c not in log.df.columns:
            raise ColumnError(f"no column {c!r}; there are {log.df.columns}")
    events = prepared(log, codes, first_date, last_date)
    first = events.groupBy(log.config.pid).agg(F.min(DAY).alias("__first"))
    at = F.floor((F.col(DAY) - F.col("__first")) / step).cast("int")
    if end is not None:
        to = F.floor((day_of(events, end) - F.col("__first")) / step).cast("int")
    else:
        to = at + F.floor(F.col(f"`{days}`") / step).cast("int")
    return _tracks(log, events.join(first, log.config.pid).withColumns({"__from": at, "__to": to}), codes, no_event, merge)

"""Operations on pattern strings, as column expressions over one character per event or period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chars(s: Column) -> Column:
    """The characters of a string; none of an empty one."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def places(n: Column, step: int = 1) -> Column:
    """1, 1 + step, .. to n; empty where n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _tracks(cols: Sequence[str]) -> tuple[list[Column], Column]:
    tracks = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in cols]
    lengths = [F.length(t) for t in tracks]
    return tracks, F.greatest(*lengths) if len(lengths) > 1 else lengths[0]


def interleave(cols: Sequence[str], time_sep: str = "|", no_event: str = " ") -> Column:
    """Period by period the characters of all tracks, with a mark between periods; short tracks are filled."""
    tracks, n = _tracks(cols)
    return F.array_join(F.transform(places(n), lambda i: F.concat(*[F.when(i <= F.length(t), F.substring(t, i, F.lit(1))).otherwise(no_event) for t in tracks])), time_sep)


def overlay(cols: Sequence[str], collision: str = "x", no_event: str = " ") -> Column:
    """One character per period: that of the only track with an event, or the collision mark where they differ."""
    tracks, n = _tracks(cols)

    def one(i: Column) -> Column:
        found = F.array_distinct(F.filter(F.array(*[F.substring(t, i, F.lit(1)) for t in tracks]), lambda c: (c != no_event) & (c != "")))
        return F.when(F.size(found) == 0, no_event).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(collision)

    return F.array_join(F.transform(places(n), one), "")


def left_justify(df: DataFrame, column: str, fill: str = " ") -> DataFrame:
    """All strings padded at the right to the length of the longest of the table."""
    longest = df.agg(F.max(F.length(f"`{column}`")).alias("__n"))
    return df.crossJoin(F.broadcast(longest)).withColumn(column, F.rpad(F.col(f"`{column}`"), F.col("__n"), F.lit(fill))).drop("__n")


def shorten(s: Column, agg: int = 3, no_event: str = " ") -> Column:
    """The first event of every agg characters."""

    def one(i: Column) -> Column:
        return F.coalesce(F.get(F.filter(chars(F.substring(s, i, F.lit(agg))), lambda c: c != no_event), F.lit(0)), F.lit(no_event))

    return F.array_join(F.transform(places(F.length(s), agg), one), "")


def del_repeats(s: Column) -> Column:
    """Without characters that equal the one before."""
    return F.regexp_replace(s, r"(?s)(.)\1+", "$1")


def del_singles(s: Column) -> Column:
    """Without characters that equal neither neighbour."""
    c = chars(s)
    return F.array_join(F.filter(c, lambda x, i: F.coalesce(x == F.get(c, i - 1), F.lit(False)) | F.coalesce(x == F.get(c, i + 1), F.lit(False))), "")


def first_of_each(s: Column) -> Column:
    return F.array_join(F.array_distinct(chars(s)), "")


__all__ = ["chars", "del_repeats", "del_singles", "first_of_each", "interleave", "left_justify", "overlay", "places", "shorten"]

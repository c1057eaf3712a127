"""Code patterns as column expressions: exact codes, prefixes, ranges and variables, over plain or multi-code cells."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CodeError


def code_columns(df: DataFrame, *without: str) -> list[str]:
    """The columns that can hold codes: strings, and arrays of strings."""
    return [f.name for f in df.schema if f.name not in without and not f.name.startswith("__") and (isinstance(f.dataType, T.StringType) or isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType))]


def route_columns(patterns: Iterable[str], columns: list[str]) -> list[str]:
    """Columns that patterns name: `icd`, `icd*`, `icd1-icd9` (by alphabet), `icd1:icd9` (by place). Unknown ones are left out; each comes once."""
    found: list[str] = []
    for p in patterns:
        a, dash, b = p.partition("-")
        c, colon, d = p.partition(":")
        if p.endswith("*"):
            found += [x for x in columns if x.startswith(p[:-1])]
        elif colon and c in columns and d in columns:
            found += columns[columns.index(c) : columns.index(d) + 1]
        elif not colon and dash and a and b:
            found += [x for x in sorted(columns) if a <= x <= b]
        elif p in columns:
            found.append(p)
    return list(dict.fromkeys(found))


def expand(codes: Iterable[str], variables: Mapping | None = None) -> list[tuple[str, str, str]]:
    """Patterns as (kind, a, b): exact a, prefix a, or range a to b. Within variables a dash is literal."""
    out = []
    for code in codes:
        if code.startswith("@"):
            if code[1:] not in (variables or {}):
                raise CodeError(f"unknown variable {code}; known: {sorted(variables or {})}")
            value = variables[code[1:]]
            for item in [value] if isinstance(value, str) else value:
                out.append(("prefix", item[:-1], "") if item.endswith("*") else ("exact", item, ""))
            continue
        a, dash, b = code.partition("-")
        if code.endswith("*"):
            out.append(("prefix", code[:-1], ""))
        elif dash and a and b:
            out.append(("range", a, b))
        else:
            out.append(("exact", code, ""))
    return list(dict.fromkeys(out))


def matches(value: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """Whether one code matches any pattern; each form reaches a scan as a pushed filter. May be null."""
    exact = [a for kind, a, _ in patterns if kind == "exact"]
    tests = [value.isin(exact)] if exact else []
    tests += [value.startswith(a) if kind == "prefix" else value.between(a, b) for kind, a, b in patterns if kind != "exact"]
    return reduce(or_, tests) if tests else F.lit(False)


def cells(df: DataFrame, column: str, sep: str | None) -> Column | None:
    """The codes of a cell as an array, or None where a cell is one code."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(f"`{column}`")
    if sep:
        return F.transform(F.split(F.col(f"`{column}`"), F.lit("\\Q" + sep + "\\E"), -1), lambda x: F.trim(x))
    return None


def code_test(df: DataFrame, column: str, patterns: list[tuple[str, str, str]], sep: str | None) -> Column:
    many = cells(df, column, sep)
    value = F.col(f"`{column}`")
    if many is None and not isinstance(df.schema[column].dataType, T.StringType):
        value = value.cast("string")
    return matches(value, patterns) if many is None else F.exists(many, lambda x: matches(x, patterns))


def any_code(df: DataFrame, columns: list[str], patterns: list[tuple[str, str, str]], sep: str | None = None, filtering: bool = False) -> Column:
    """Whether any of the columns matches; never null, but when filtering, where null is as good as false and bare tests reach the scan."""
    tests = [code_test(df, c, patterns, sep) for c in columns]
    if filtering and tests:
        return reduce(or_, tests)
    return F.coalesce(reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)) if tests else F.lit(False)


def label_of(df: DataFrame, labels: Mapping[str, str | Iterable[str]], columns: list[str], sep: str | None = None) -> Column:
    """The label of the first column that has one, by the first pattern that fits; labels: label -> patterns. Null without."""
    found = []
    for c in columns:
        pick = None
        for label, patterns in labels.items():
            hit = code_test(df, c, expand([patterns] if isinstance(patterns, str) else patterns), sep)
            pick = F.when(hit, F.lit(label)) if pick is None else pick.when(hit, F.lit(label))
        if pick is not None:
            found.append(pick)
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def distinct_codes(df: DataFrame, columns: list[str], sep: str | None = None) -> DataFrame:
    """All codes, each once, sorted."""
    arrays = [m if (m := cells(df, c, sep)) is not None else F.array(F.col(f"`{c}`")) for c in columns]
    if not arrays:
        return df.sparkSession.createDataFrame([], "code string")
    return df.select(F.explode(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])).alias("code")).where("code is not null and code <> ''").distinct().orderBy("code")

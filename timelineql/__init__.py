"""Temporal questions of event logs, compiled to Spark DataFrames.

    import timelineql as tl
    r = tl.query(events, "sum(value) > 90 inside 7 days after error", pid="user_id", date="ts", cols="event_type", tie=["event_id"])
    r.pids, r.count, r.pct()
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from .config import Config, get_config, set_backend, use
from .errors import CodeError, ColumnError, PatternStringError, QueryError, QuerySyntaxError, UnsupportedError
from .functions.codebook import Codebook, count_codes, get_codebook, labelled, reset_codebook
from .operators import batch as _batch
from .operators.incidence import fit_decay, incidence, raw_incidence, singles_pattern, washout_pattern
from .operators.stringeval import StringEvaluator, cross_validate, string_query, string_query_auto
from .operators.stringify import stringify_durations, stringify_order, stringify_time
from .plans import ast
from .plans.ast import from_json, to_json
from .plans.parser import parse
from .plans.prefilter import united as _united
from .result import Result
from .sources.eventlog import EventLog, combine, make_test_data

__version__ = "0.1.0"


def log_of(df: DataFrame | Sequence[DataFrame] | Mapping[str, DataFrame] | EventLog, config: Config | None = None, **given) -> EventLog:
    """The table, the union of several, or the log itself, as a log."""
    if isinstance(df, EventLog):
        return EventLog(df.df, config or df.config, **given) if config or given else df
    config = (config or get_config()).but(**given)
    return EventLog(df if isinstance(df, DataFrame) else _united(df, config), config)


def query(df, expr: str | ast.Node, *, config: Config | None = None, strict: bool = True, **given) -> Result:
    """Asks a table of events, or several (a list, or a dict of names). Settings: see Config. strict: raise CodeError for a prefix or range that no code of
    the searched columns has. That takes a job for each, which ends at the first code that fits; queries of exact codes take none."""
    node = parse(expr) if isinstance(expr, str) else expr
    log = log_of(df, config, **given)
    if strict:
        _check_codes(log, node)
    lean = None
    if not isinstance(df, DataFrame | EventLog):
        lean = EventLog(_united(df, log.config, node), log.config)
    return Result(log, expr, lean)


def _check_codes(log: EventLog, node: ast.Node) -> None:
    from .functions import codes as C

    for atom in (n for n in node.walk() if isinstance(n, ast.CodeAtom)):
        columns = log.code_columns if atom.columns is None else C.route_columns(atom.columns, log.df.columns)
        for pattern in C.expand(atom.codes, log.config.variables):
            if pattern[0] != "exact" and log.df.where(C.any_code(log.df, columns, [pattern], log.config.sep)).isEmpty():
                raise CodeError(f"no code fits {pattern[1] + ('*' if pattern[0] == 'prefix' else '-' + pattern[2])}")


def count_persons(df, expr: str, **given) -> int:
    return query(df, expr, **given).count


def event_counts(df, expr: str, **given) -> DataFrame:
    return query(df, expr, **given).event_counts


def multi_query(df, template: str, *, max_combinations: int = 1000, config: Config | None = None, **given) -> dict[str, int]:
    return _batch.multi_query(log_of(df, config, **given), template, max_combinations)


__all__ = [
    "CodeError", "Codebook", "ColumnError", "Config", "EventLog", "PatternStringError", "QueryError", "QuerySyntaxError", "Result", "StringEvaluator", "UnsupportedError", "ast", "combine",
    "count_codes", "count_persons", "cross_validate", "event_counts", "fit_decay", "from_json", "get_codebook", "get_config", "incidence", "labelled", "log_of", "make_test_data", "multi_query",
    "parse", "query", "raw_incidence", "reset_codebook", "set_backend", "singles_pattern", "string_query", "string_query_auto", "stringify_durations", "stringify_order", "stringify_time", "to_json",
    "use", "washout_pattern",
]

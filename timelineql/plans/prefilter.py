"""Several tables as one log, each cut to the rows that a query can need before they are united."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..config import Config
from ..errors import CodeError
from ..sources.eventlog import EventLog, combine
from . import ast as A
from .compiler import needed


def united(tables: Sequence[DataFrame] | Mapping[str, DataFrame], config: Config, node: A.Node | None = None, source_col: str = "__source__") -> DataFrame:
    """The union; with a node, only of rows that matter to who matches it. Counts of all persons need the whole union."""
    if node is None:
        return combine(tables, source_col=source_col, config=config)
    names = list(tables) if isinstance(tables, Mapping) else [f"source_{i}" for i in range(len(tables))]
    parts = list(tables.values()) if isinstance(tables, Mapping) else list(tables)
    out = []
    for t in parts:
        cols = config.cols
        own = None if cols is None else [c for c in ([cols] if isinstance(cols, str) else cols) if c in t.columns]
        try:
            test = needed(EventLog(t, Config(**{**config.__dict__, "cols": own})), node)
        except (CodeError, KeyError):
            test = None
        except Exception as e:  # a column that only another table has: no row of this one is turned away
            if type(e).__name__ != "ColumnError" or config.pid not in t.columns or config.date not in t.columns:
                raise
            test = None
        out.append(t if test is None else t.where(test))
    return combine(out, names, source_col=source_col, config=config)

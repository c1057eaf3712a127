"""Settings of queries: names of columns and the like. What a call is given wins over its config, and that over the one in use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    pid: str = "pid"
    date: str = "start_date"
    event_end: str | None = None
    event_duration: str | None = None
    cols: str | Sequence[str] | None = None
    sep: str | None = None
    variables: Mapping[str, Any] | None = None
    codebooks_dir: str | None = None
    #: Columns that order events of one person and day.
    tie: Sequence[str] | None = None
    #: Whether changes in % divide by bases that aren't positive too, as SQL does, and not leave them out.
    any_base: bool = False
    name: str = "default"
    backend: str | None = None

    def __post_init__(self):
        if self.backend not in (None, "spark"):
            raise ValueError(f"backend must be None or 'spark', not {self.backend!r}")

    def but(self, **given: Any) -> Config:
        known = {f.name for f in fields(self)}
        if unknown := set(given) - known:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: v for k, v in given.items() if v is not None})


_used = Config()


def get_config() -> Config:
    return _used


def use(config: Config) -> None:
    """Makes this the config of all later calls that are given none."""
    global _used
    _used = config


def set_backend(backend: str | None) -> None:
    global _used
    _used = replace(_used, backend=backend)

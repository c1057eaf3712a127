"""Code books: what codes mean, with fall-back to shorter codes and to ranges; and counts of codes in a log."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.eventlog import EventLog
from .codes import cells, expand, matches, route_columns

HOME = Path(__file__).parent / "codebooks"
SYSTEMS = [("atc", re.compile(r"[A-Z]\d\d[A-Z]{0,2}\d{0,2}")), ("icd10", re.compile(r"[A-Z]\d{2,3}(\.\d+)?")), ("icd10", re.compile(r"[A-Z]\d\d-[A-Z]\d\d"))]


def system_of(code: str) -> str:
    return next((s for s, form in SYSTEMS if form.fullmatch(code.strip())), "unknown")


class Codebook:
    """entries: dicts with code and label, and maybe level and system. The first entry of a code counts."""

    def __init__(self, entries: Iterable[dict]):
        self.entries: list[dict] = []
        self.labels: dict[str, str] = {}
        for e in entries:
            if e["code"] not in self.labels:
                self.labels[e["code"]] = e["label"]
                self.entries.append({"code": e["code"], "label": e["label"], "level": e.get("level") or None, "system": e.get("system") or system_of(e["code"])})
        spans = [(c.split("-"), label) for c, label in self.labels.items() if "-" in c]
        self.ranges = [(a, b, label) for (a, b), label in spans]

    @classmethod
    def load(cls, *folders: str | Path) -> Codebook:
        """All csv files of these folders that have code and label; others are left out."""
        entries = []
        for folder in folders:
            for path in sorted(Path(folder).glob("*.csv")):
                with path.open(newline="", encoding="utf-8") as f:
                    rows = csv.DictReader(f)
                    if {"code", "label"} <= set(rows.fieldnames or ()):
                        entries += [r for r in rows if r["code"] and r["label"]]
        return cls(entries)

    def label(self, code: str | None) -> str | None:
        """The label of the code; of the longest shorter code; of the range that has its first three characters."""
        if code is None:
            return None
        short = code.replace(".", "")
        tries = [code, *(short[:n] for n in range(len(short) - 1, 0, -1))]
        found = next((self.labels[c] for c in tries if c in self.labels), None)
        return found or next((label for a, b, label in self.ranges if len(code) >= 3 and a <= code[:3] <= b), None)

    def column(self, code: Column) -> Column:
        """label() as an expression over a literal map, which is as large as the book."""
        if not self.labels:
            return F.lit(None).cast("string")
        book = F.create_map(*[F.lit(x) for pair in self.labels.items() for x in pair])
        short = F.regexp_replace(code, r"\.", "")
        n = F.length(short)
        shorter = F.when(n > 1, F.transform(F.sequence(n - 1, F.when(n > 1, F.lit(1)), F.lit(-1)), lambda k: F.try_element_at(book, F.substring(short, F.lit(1), k))))
        found = F.coalesce(F.try_element_at(book, code), F.get(F.filter(shorter, lambda x: x.isNotNull()), F.lit(0)))
        spans = None
        for a, b, label in self.ranges:
            hit = (F.length(code) >= 3) & F.substring(code, 1, 3).between(a, b)
            spans = F.when(hit, label) if spans is None else spans.when(hit, label)
        return found if spans is None else F.coalesce(found, spans)

    def search(self, keyword: str, system: str | None = None) -> list[dict]:
        """Entries whose label has the pattern, whatever the case."""
        form = re.compile(keyword, re.IGNORECASE)
        return [e for e in self.entries if form.search(e["label"]) and system in (None, e["system"])]

    def get(self, pattern: str) -> list[dict]:
        """Entries by exact code, prefix* or range a-b."""
        if pattern.endswith("*"):
            return [e for e in self.entries if e["code"].startswith(pattern[:-1])]
        a, dash, b = pattern.partition("-")
        return [e for e in self.entries if (a <= e["code"] <= b if dash else e["code"] == pattern)]


@lru_cache(maxsize=8)
def get_codebook(*extra: str) -> Codebook:
    """The books shipped and those of more folders, loaded once."""
    return Codebook.load(HOME, *extra)


def reset_codebook() -> None:
    get_codebook.cache_clear()


def labelled(log: EventLog, cols: str | Sequence[str] | None = None, book: Codebook | None = None) -> DataFrame:
    """The log with a column {name}_label for each code column."""
    if book is None:
        book = get_codebook(*([log.config.codebooks_dir] if log.config.codebooks_dir else []))
    columns = log.code_columns if cols is None else [cols] if isinstance(cols, str) else list(cols)
    return log.df.withColumns({f"{c}_label": book.column(F.col(f"`{c}`")) for c in columns})


def count_codes(log: EventLog, cols: str | Sequence[str] | None = None, per_person: bool = False, pattern: str | None = None) -> DataFrame:
    """(code, n), most frequent first: how often codes occur, or in how many persons."""
    columns = log.code_columns if cols is None else route_columns([cols] if isinstance(cols, str) else cols, log.df.columns)
    arrays = [m if (m := cells(log.df, c, log.config.sep)) is not None else F.array(F.col(f"`{c}`")) for c in columns]
    if not arrays:
        return log.df.sparkSession.createDataFrame([], "code string, n long")
    rows = log.df.select(log.pid.alias("pid"), F.explode(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])).alias("code")).where("code is not null")
    if pattern:
        rows = rows.where(matches(F.col("code"), expand([pattern])))
    n = F.countDistinct("pid") if per_person else F.count("*")
    return rows.groupBy("code").agg(n.alias("n")).orderBy(F.desc("n"), "code")

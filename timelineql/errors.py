"""The errors that queries can raise."""

from __future__ import annotations


class QueryError(Exception):
    """Base of all errors here."""


class QuerySyntaxError(QueryError):
    """The text is no query; shows where, if known."""

    def __init__(self, message: str, text: str = "", at: int = -1):
        self.message, self.text, self.at = message, text, at
        super().__init__(f"{message}\n  {text}\n  {' ' * at}^" if text and at >= 0 else message)


class ColumnError(QueryError):
    """A column is missing or of the wrong type."""


class CodeError(QueryError):
    """A code pattern or variable means nothing."""


class PatternStringError(QueryError):
    """A query has no meaning over pattern strings."""


class UnsupportedError(QueryError, TypeError):
    """A combination of operators has no meaning."""

"""Query trees: small frozen records, equal and hashable by content, without any Spark types."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields


class Node:
    """Base of all query nodes."""

    __slots__ = ()

    def parts(self) -> Iterator[Node]:
        for f in fields(self):
            if isinstance(value := getattr(self, f.name), Node):
                yield value

    def walk(self) -> Iterator[Node]:
        yield self
        for part in self.parts():
            yield from part.walk()


def _node(cls):
    return dataclass(frozen=True, slots=True)(cls)


@_node
class CodeAtom(Node):
    """Rows with any of these code patterns in any of these columns (default: all code columns)."""

    codes: tuple[str, ...]
    columns: tuple[str, ...] | None = None


@_node
class EventAtom(Node):
    """Every row."""


@_node
class ComparisonAtom(Node):
    column: str
    op: str
    value: float


@_node
class AggregateExpr(Node):
    """An aggregate of a numeric column held against a threshold; relative: of the base, as a fraction."""

    func: str
    column: str
    op: str
    value: float
    relative: bool = False


@_node
class PrefixExpr(Node):
    """kind: min, max, exactly (counts), ordinal (negative: from the end), first, last."""

    kind: str
    n: int
    child: Node


@_node
class RangePrefixExpr(Node):
    min_n: int
    max_n: int
    child: Node


@_node
class NotExpr(Node):
    child: Node


@_node
class BinaryLogical(Node):
    op: str
    left: Node
    right: Node


@_node
class TemporalExpr(Node):
    op: str
    left: Node
    right: Node


@_node
class WithinExpr(Node):
    """A window of days about reference events, or about the first event, or trailing where the child is an aggregate."""

    child: Node
    days: int
    min_days: int = 0
    direction: str | None = None
    ref: Node | None = None
    outside: bool = False


@_node
class InsideExpr(Node):
    """A window of events about reference events, or trailing where the child is an aggregate."""

    child: Node
    inside: bool
    min_events: int
    max_events: int
    direction: str | None
    ref: Node | None


@_node
class BetweenExpr(Node):
    child: Node
    bound_start: Node
    bound_end: Node
    outside: bool = False


@_node
class WithinSpanExpr(Node):
    child: Node
    ref: Node
    outside: bool = False


@_node
class ShiftExpr(Node):
    child: Node
    offset_days: int


@_node
class Quantifier(Node):
    """kind: every or any; the child is a CodeAtom."""

    kind: str
    child: Node


NODES = {c.__name__: c for c in Node.__subclasses__()}


def to_json(node: Node) -> dict:
    """A nested dict: the node's kind under _node, and its fields."""

    def plain(value):
        if isinstance(value, Node):
            return to_json(value)
        return list(value) if isinstance(value, tuple) else value

    return {"_node": type(node).__name__} | {f.name: plain(getattr(node, f.name)) for f in fields(node)}


def from_json(found: dict) -> Node:
    """The node that to_json made found of; fields that have defaults may be left out."""
    kind = NODES.get(found.get("_node", "")) if isinstance(found, dict) else None
    if kind is None:
        raise ValueError(f"no query node: {found!r}")

    def rich(value):
        if isinstance(value, dict):
            return from_json(value)
        return tuple(value) if isinstance(value, list) else value

    return kind(**{f.name: rich(found[f.name]) for f in fields(kind) if f.name in found})


def unshifted(node: Node) -> tuple[Node, int]:
    """The node below all shifts, and their sum in days."""
    days = 0
    while isinstance(node, ShiftExpr):
        node, days = node.child, days + node.offset_days
    return node, days


def unquantified(node: Node) -> tuple[Node, str | None]:
    return (node.child, node.kind) if isinstance(node, Quantifier) else (node, None)

"""Nodes of an expression."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    pass


@dataclass(frozen=True)
class Identity(Node):
    pass


@dataclass(frozen=True)
class Field(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    base: Node
    at: int


@dataclass(frozen=True)
class Slice(Node):
    base: Node
    start: int | None
    end: int | None


@dataclass(frozen=True)
class Iterate(Node):
    base: Node


@dataclass(frozen=True)
class Pipe(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Binary(Node):
    """Arithmetic, comparison, and, or, or the alternative."""

    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    inner: Node


@dataclass(frozen=True)
class If(Node):
    test: Node
    then: Node
    other: Node


@dataclass(frozen=True)
class Object(Node):
    """Keys are names, or expressions for computed keys."""

    fields: tuple[tuple[str | Node, Node], ...]


@dataclass(frozen=True)
class Array(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()


def stages(node: Node) -> list[Node]:
    """The parts of a pipe, in order."""
    return stages(node.left) + stages(node.right) if isinstance(node, Pipe) else [node]


def path_of(node: Node) -> tuple[str, ...] | None:
    """The names of a plain path .a.b, else None."""
    out: list[str] = []
    while isinstance(node, Field):
        out.append(node.name)
        node = node.base
    return tuple(reversed(out)) if isinstance(node, Identity) and out else None

"""The algebra that all front ends lower to.

Terms in plans are tuples: ("var", name), ("iri", iri), ("lit", lexical, datatype, language, direction),
("triple", s, p, o). Blank nodes of a pattern are variables whose names begin with "_:". Expressions are tuples
(operator, arguments...). Paths are tuples: ("iri", iri), ("inv", p), ("seq", a, b), ("alt", a, b), ("opt", p),
("star", p), ("plus", p), ("neg", forward iris, backward iris).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
STRING = XSD + "string"


class Node:
    pass


@dataclass(frozen=True)
class Bgp(Node):
    triples: tuple


@dataclass(frozen=True)
class Path(Node):
    s: tuple
    path: tuple
    o: tuple


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class LeftJoin(Node):
    left: Node
    right: Node
    condition: Any = None


@dataclass(frozen=True)
class Lateral(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Filter(Node):
    child: Node
    condition: tuple


@dataclass(frozen=True)
class Union(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Graph(Node):
    name: tuple
    child: Node


@dataclass(frozen=True)
class Extend(Node):
    child: Node
    name: str
    value: tuple


@dataclass(frozen=True)
class Minus(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Values(Node):
    names: tuple
    rows: tuple


@dataclass(frozen=True)
class OrderBy(Node):
    child: Node
    keys: tuple  # (expression, ascending)


@dataclass(frozen=True)
class Project(Node):
    child: Node
    names: tuple


@dataclass(frozen=True)
class Distinct(Node):
    child: Node


@dataclass(frozen=True)
class Reduced(Node):
    child: Node


@dataclass(frozen=True)
class Slice(Node):
    child: Node
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Group(Node):
    child: Node
    keys: tuple
    aggregates: tuple  # (name, (function, expression or None, distinct, separator))


@dataclass(frozen=True)
class Service(Node):
    name: tuple
    child: Node
    silent: bool = False
    text: str = ""


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    pattern: Node
    template: list = field(default_factory=list)
    described: list = field(default_factory=list)
    default_graphs: list | None = None
    named_graphs: list | None = None
    base: str | None = None


@dataclass
class Update:
    kind: str  # insert_data, delete_data, modify, load, clear, drop, create
    deletes: list = field(default_factory=list)
    inserts: list = field(default_factory=list)
    pattern: Node | None = None
    default_graphs: list | None = None
    named_graphs: list | None = None
    target: Any = None
    source: str | None = None
    silent: bool = False


def variables(node: Node) -> list[str]:
    """In-scope variables, in order of appearance; those of blank nodes are left out."""
    out: dict[str, None] = {}

    def term(t: tuple) -> None:
        if t[0] == "var":
            out[t[1]] = None
        elif t[0] == "triple":
            for x in t[1:]:
                term(x)

    def walk(n: Node) -> None:
        match n:
            case Bgp():
                for t in n.triples:
                    for x in t:
                        term(x)
            case Path():
                term(n.s)
                term(n.o)
            case Graph():
                term(n.name)
                walk(n.child)
            case Minus():
                walk(n.left)
            case Extend():
                walk(n.child)
                out[n.name] = None
            case Values():
                out.update(dict.fromkeys(n.names))
            case Project():
                out.update(dict.fromkeys(n.names))
            case Group():
                out.update(dict.fromkeys([*n.keys, *(a for a, _ in n.aggregates)]))
            case Join() | LeftJoin() | Lateral() | Union():
                walk(n.left)
                walk(n.right)
            case Service():
                term(n.name)
                walk(n.child)
            case _:
                walk(n.child)

    walk(node)
    return [v for v in out if not v.startswith("_:")]

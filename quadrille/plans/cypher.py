"""An openCypher subset, lowered to the algebra that SPARQL uses.

Nodes are terms, labels rdf:type triples, properties and relationships predicates in namespaces of their own, and
relationship properties annotations of quoted triples. Reads: MATCH, WHERE, RETURN [DISTINCT] .. AS, ORDER BY, SKIP,
LIMIT. Writes: CREATE, SET, REMOVE, [DETACH] DELETE. An undirected relationship counts as one to the right.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import algebra as A
from .algebra import RDF, STRING, XSD


class CypherError(ValueError):
    """The text is outside the subset."""


@dataclass
class Names:
    label: str = "urn:lpg:label/"
    prop: str = "urn:lpg:prop/"
    rel: str = "urn:lpg:rel/"
    node: str = "urn:lpg:node/"


_LEX = re.compile(r"""\s+|//[^\n]*|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<op><>|<=|>=|->|<-|\.\.|[-(){}\[\]:,.*=<>+/|])""")
REJECTED = frozenset("WITH MERGE OPTIONAL UNION UNWIND CALL".split())


class Cypher:
    def __init__(self, text: str, names: Names | None = None):
        self.toks, at = [], 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise CypherError(f"unexpected text at {at}")
            if m.lastgroup:
                self.toks.append((m.lastgroup, m[0]))
            at = m.end()
        self.toks.append(("end", ""))
        self.i, self.names = 0, names or Names()
        self.triples: list = []
        self.paths: list = []
        self.fresh = 0
        self.props: dict[tuple[str, str], str] = {}
        self.rels: dict[str, tuple] = {}

    def peek(self, k: int = 0) -> str:
        return self.toks[min(self.i + k, len(self.toks) - 1)][1]

    def kind(self) -> str:
        return self.toks[self.i][0]

    def next(self) -> str:
        self.i += 1
        return self.toks[self.i - 1][1]

    def word(self, w: str) -> bool:
        if self.kind() == "name" and self.peek().upper() == w:
            self.i += 1
            return True
        return False

    def take(self, op: str) -> bool:
        if self.kind() == "op" and self.peek() == op:
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise CypherError(f"{op!r} expected, found {self.peek()!r}")

    def name(self) -> str:
        if self.kind() != "name":
            raise CypherError(f"a name expected, found {self.peek()!r}")
        return self.next().strip("`")

    def new(self, hint: str) -> str:
        self.fresh += 1
        return f"_:{hint}{self.fresh}"

    def literal(self) -> tuple:
        if self.kind() == "num":
            x = self.next()
            return ("lit", x, XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"), None, None)
        if self.kind() == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), self.next()[1:-1]), STRING, None, None)
        if self.take("-"):
            k, x, *rest = self.literal()
            return (k, "-" + x, *rest)
        if self.word("TRUE"):
            return ("lit", "true", XSD + "boolean", None, None)
        if self.word("FALSE"):
            return ("lit", "false", XSD + "boolean", None, None)
        raise CypherError(f"a literal expected, found {self.peek()!r}")

    def prop_map(self) -> list[tuple[str, tuple]]:
        out = []
        if self.take("{"):
            while not self.take("}"):
                k = self.name()
                self.need(":")
                out.append((k, self.literal()))
                self.take(",")
        return out

    def node(self, make: bool = False) -> tuple:
        self.need("(")
        name = self.name() if self.kind() == "name" else self.new("n")
        labels = []
        while self.take(":"):
            labels.append(self.name())
        props = self.prop_map()
        self.need(")")
        v = ("var", name)
        for label in labels:
            self.triples.append((v, ("iri", RDF + "type"), ("iri", self.names.label + label)))
        for k, x in props:
            self.triples.append((v, ("iri", self.names.prop + k), x))
        return v

    def pattern(self, make: bool = False) -> None:
        while True:
            left = self.node(make)
            while self.peek() in ("-", "<-"):
                back = self.next() == "<-"
                kind, name, props, span = None, None, [], None
                if self.take("["):
                    if self.kind() == "name":
                        name = self.name()
                    if self.take(":"):
                        kind = self.name()
                    if self.take("*"):
                        low = high = None
                        if self.kind() == "num":
                            low = int(self.next())
                        ranged = self.take("..")
                        if self.kind() == "num":
                            high = int(self.next())
                        if not ranged and low is not None:
                            high = low
                        span = (1 if low is None else low, high)
                    props = self.prop_map()
                    self.need("]")
                if back:
                    self.need("-")
                else:
                    if not self.take("->"):
                        self.need("-")
                right = self.node(make)
                a, b = (right, left) if back else (left, right)
                if span is not None:
                    if span[1] is not None or span[0] not in (0, 1):
                        raise CypherError("only *, *0.. and *1.. are supported")
                    if kind is None:
                        raise CypherError("a variable-length relationship needs a type")
                    self.paths.append((a, ("star" if span[0] == 0 else "plus", ("iri", self.names.rel + kind)), b))
                else:
                    p = ("iri", self.names.rel + kind) if kind else ("var", name or self.new("r"))
                    self.triples.append((a, p, b))
                    if name:
                        self.rels[name] = (a, p, b)
                    for k, x in props:
                        self.triples.append((("triple", a, p, b), ("iri", self.names.prop + k), x))
                left = right
            if not self.take(","):
                return

    # -- expressions

    def expr(self) -> tuple:
        e = self.conj()
        while self.word("OR"):
            e = ("or", e, self.conj())
        return e

    def conj(self) -> tuple:
        e = self.negation()
        while self.word("AND"):
            e = ("and", e, self.negation())
        return e

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> tuple:
        e = self.sum()
        if self.kind() == "op" and self.peek() in ("=", "<>", "<", "<=", ">", ">="):
            op = self.next()
            e = ("!=" if op == "<>" else op, e, self.sum())
        return e

    def sum(self) -> tuple:
        e = self.product()
        while self.peek() in ("+", "-") and self.kind() == "op":
            e = (self.next(), e, self.product())
        return e

    def product(self) -> tuple:
        e = self.unary()
        while self.peek() in ("*", "/") and self.kind() == "op":
            e = (self.next(), e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("-"):
            return ("u-", self.unary())
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.kind() == "name" and self.peek().upper() not in ("TRUE", "FALSE"):
            if self.peek().upper() == "NULL":
                raise CypherError("NULL is not supported")
            name = self.name()
            if self.take("."):
                key = self.name()
                if self.peek() == ".":
                    raise CypherError("chained properties are not supported")
                return ("var", self.property(name, key))
            if self.peek() == "(":
                raise CypherError("functions are not supported")
            return ("var", name)
        return ("const", self.literal())

    def property(self, name: str, key: str) -> str:
        """The variable of a property; asking for it makes it required."""
        if (name, key) not in self.props:
            v = self.props[name, key] = f"{name}_{key}"
            subject = ("triple", *self.rels[name]) if name in self.rels else ("var", name)
            self.triples.append((subject, ("iri", self.names.prop + key), ("var", v)))
        return self.props[name, key]

    def start(self) -> tuple | None:
        if self.kind() == "name" and self.peek().upper() in REJECTED:
            raise CypherError(f"{self.peek().upper()} is not supported")
        condition = None
        if self.word("MATCH"):
            self.pattern()
            if self.kind() == "name" and self.peek().upper() in REJECTED | {"MATCH"}:
                raise CypherError(f"{self.peek().upper()} is not supported here")
            if self.word("WHERE"):
                condition = self.expr()
        return condition

    def body(self, condition: tuple | None) -> A.Node:
        node: A.Node = A.Bgp(tuple(self.triples))
        for s, p, o in self.paths:
            node = A.Path(s, p, o) if node == A.Bgp(()) else A.Join(node, A.Path(s, p, o))
        return A.Filter(node, condition) if condition else node

    def query(self) -> A.Query:
        condition = self.start()
        if not self.word("RETURN"):
            raise CypherError("RETURN expected")
        distinct = self.word("DISTINCT")
        items = []
        while True:
            first = self.i
            e = self.expr()
            text = "".join(x for _, x in self.toks[first : self.i])
            items.append((self.name() if self.word("AS") else (e[1] if e[0] == "var" and "." not in text else text.replace(".", "_")), e))
            if not self.take(","):
                break
        keys = []
        if self.word("ORDER"):
            if not self.word("BY"):
                raise CypherError("BY expected")
            while True:
                e = self.expr()
                down = self.word("DESC") or self.word("DESCENDING")
                if not down:
                    self.word("ASC") or self.word("ASCENDING")
                keys.append((e, not down))
                if not self.take(","):
                    break
        skip = int(self.next()) if self.word("SKIP") else 0
        limit = int(self.next()) if self.word("LIMIT") else None
        if self.kind() != "end":
            raise CypherError(f"unexpected {self.peek()!r}")
        node = self.body(condition)
        bound = set(A.variables(node))
        if any(e != ("var", name) and name in bound for name, e in items):
            # A name of the result hides the pattern's variable of that name, in ORDER BY too.
            for i, (_, e) in enumerate(items):
                node = A.Extend(node, f"result {i}", e)
            node = A.Project(node, tuple(f"result {i}" for i in range(len(items))))
            items = [(name, ("var", f"result {i}")) for i, (name, _) in enumerate(items)]
        for name, e in items:
            if e != ("var", name):
                node = A.Extend(node, name, e)
        if keys:
            node = A.OrderBy(node, tuple(keys))
        node = A.Project(node, tuple(n for n, _ in items))
        if distinct:
            node = A.Distinct(node)
        return A.Query("select", A.Slice(node, skip, limit) if skip or limit is not None else node)

    def update(self) -> list[A.Update]:
        import uuid

        condition = self.start()
        matched = set(A.variables(A.Bgp(tuple(self.triples)))) | {x[1] for s, _, o in self.paths for x in (s, o)}
        pattern = list(self.triples)
        out: list[A.Update] = []
        deletes, inserts, extra = [], [], []
        while self.kind() != "end":
            if self.word("CREATE"):
                mark = len(self.triples)
                self.pattern(make=True)
                made: dict[str, tuple] = {}

                def own(x: tuple, made=made) -> tuple:
                    if x[0] == "triple":
                        return ("triple", *(own(y) for y in x[1:]))
                    if x[0] == "var" and x[1] not in matched:
                        return made.setdefault(x[1], ("iri", self.names.node + uuid.uuid4().hex) if not pattern else ("var", "_:" + x[1].removeprefix("_:")))
                    return x

                for tr in self.triples[mark:]:
                    new = tuple(own(x) for x in tr)
                    inserts.append((None, *new))
                    if new[0][0] == "triple":
                        inserts.append((None, *new[0][1:]))
                del self.triples[mark:]
            elif self.word("SET"):
                while True:
                    name = self.name()
                    if self.take(":"):
                        inserts.append((None, ("var", name), ("iri", RDF + "type"), ("iri", self.names.label + self.name())))
                    else:
                        self.need(".")
                        key = ("iri", self.names.prop + self.name())
                        self.need("=")
                        value = self.expr()
                        old, new = ("var", self.new("old")[2:] + "_old"), ("var", self.new("v")[2:] + "_new")
                        extra.append(("optional", A.Bgp(((("var", name), key, old),))))
                        extra.append(("bind", new[1], value))
                        deletes.append((None, ("var", name), key, old))
                        inserts.append((None, ("var", name), key, new))
                    if not self.take(","):
                        break
            elif self.word("REMOVE"):
                while True:
                    name = self.name()
                    if self.take(":"):
                        deletes.append((None, ("var", name), ("iri", RDF + "type"), ("iri", self.names.label + self.name())))
                    else:
                        self.need(".")
                        key, old = ("iri", self.names.prop + self.name()), ("var", self.new("old")[2:] + "_old")
                        extra.append(("optional", A.Bgp(((("var", name), key, old),))))
                        deletes.append((None, ("var", name), key, old))
                    if not self.take(","):
                        break
            elif self.word("DETACH") or (self.kind() == "name" and self.peek().upper() == "DELETE"):
                detach = self.toks[self.i - 1][1].upper() == "DETACH"
                if not self.word("DELETE"):
                    raise CypherError("DELETE expected")
                while True:
                    name = self.name()
                    if name in self.rels:
                        deletes.append((None, *self.rels[name]))
                    else:
                        p, o, s = (("var", f"{name}_{x}") for x in ("dp", "do", "ds"))
                        extra.append(("optional", A.Bgp(((("var", name), p, o),))))
                        deletes.append((None, ("var", name), p, o))
                        if detach:
                            q = ("var", f"{name}_dq")
                            extra.append(("optional", A.Bgp(((s, q, ("var", name)),))))
                            deletes.append((None, s, q, ("var", name)))
                    if not self.take(","):
                        break
            else:
                raise CypherError(f"unexpected {self.peek()!r}")
        pattern_node = self.body(condition)
        for kind, *rest in extra:
            pattern_node = A.LeftJoin(pattern_node, rest[0]) if kind == "optional" else A.Extend(pattern_node, rest[0], rest[1])
        if not deletes and pattern_node == A.Bgp(()):
            out.append(A.Update("insert_data", inserts=inserts))
        else:
            out.append(A.Update("modify", deletes=deletes, inserts=inserts, pattern=pattern_node))
        return out


def parse_query(text: str, names: Names | None = None) -> A.Query:
    return Cypher(text, names).query()


def parse_update(text: str, names: Names | None = None) -> list[A.Update]:
    return Cypher(text, names).update()

"""SPARQL text to algebra: a tokenizer and a recursive-descent parser for queries and updates."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from .algebra import (
    RDF, STRING, XSD, Bgp, Distinct, Extend, Filter, Graph, Group, Join, Lateral, LeftJoin, Minus, Node, OrderBy, Path,
    Project, Query, Reduced, Service, Slice, Union, Update, Values, variables,
)


class SparqlError(ValueError):
    """The text is no valid query or update."""


_PN = r"[A-Za-z_\u00b7\u00c0-\U000effff][\w\-.\u00b7\u00c0-\U000effff]*"
_TOKENS = [
    ("ws", r"(?:\s|#[^\n\r]*)+"),
    ("iri", r"<[^<>\"{}|^`\\\x00-\x20]*>"),
    ("long", r'"""(?:(?:"|"")?(?:[^"\\]|\\.))*"""' + r"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''"),
    ("str", r'"(?:[^"\\\n\r]|\\.)*"' + r"|'(?:[^'\\\n\r]|\\.)*'"),
    ("var", r"[?$][\w\u00b7\u00c0-\U000effff]+"),
    ("lang", r"@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*(?:--(?:ltr|rtl))?"),
    ("bnode", r"_:[\w\u00c0-\U000effff](?:[\w\-.\u00b7\u00c0-\U000effff]*[\w\-\u00b7\u00c0-\U000effff])?"),
    ("pname", rf"(?:{_PN})?:(?:(?:[\w:\u00b7\u00c0-\U000effff]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%])(?:(?:[\w\-:.\u00b7\u00c0-\U000effff]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%])*(?:[\w\-:\u00b7\u00c0-\U000effff]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%]))?)?"),
    ("double", r"(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+"),
    ("decimal", r"\d*\.\d+"),
    ("integer", r"\d+"),
    ("op", r"<<\(|\)>>|<<|>>|\{\||\|\}|\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?~]"),
    ("word", r"[A-Za-z_][\w]*"),
]
_LEX = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _TOKENS), re.S)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

BUILTINS = frozenset(
    "STR LANG LANGMATCHES LANGDIR DATATYPE BOUND IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT STRLEN UCASE LCASE ENCODE_FOR_URI CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1 SHA256 SHA384 SHA512 COALESCE IF STRLANG STRLANGDIR STRDT SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC REGEX SUBSTR REPLACE TRIPLE SUBJECT PREDICATE OBJECT ISTRIPLE HASLANG HASLANGDIR ADJUST".split()
)
AGGREGATES = frozenset("COUNT SUM MIN MAX AVG SAMPLE GROUP_CONCAT".split())


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" else _ESCAPES[x]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


class Parser:
    def __init__(self, text: str, base: str | None = None, prefixes: dict[str, str] | None = None):
        text = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), text)
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            if not (m := _LEX.match(text, at)):
                raise SparqlError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.i, self.base, self.prefixes, self.fresh = 0, base, dict(prefixes or {}), 0
        self.aggregates: list | None = None

    # -- tokens

    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)][1]

    def kind(self, k: int = 0) -> str:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)][0]

    def next(self) -> str:
        t = self.tokens[self.i]
        self.i += 1
        return t[1]

    def fail(self, what: str) -> SparqlError:
        return SparqlError(f"{what} expected at {self.tokens[self.i][2]}, found {self.peek()!r}")

    def is_word(self, *words: str) -> bool:
        return self.kind() == "word" and self.peek().upper() in words

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
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
            raise self.fail(repr(op))

    def need_word(self, w: str) -> None:
        if not self.word(w):
            raise self.fail(w)

    def new_bnode(self) -> tuple:
        self.fresh += 1
        return ("var", f"_:{self.fresh}")

    # -- terms

    def resolve(self, iri: str) -> str:
        iri = unescape(iri)
        return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][\w+.\-]*:", iri) else iri

    def at_iri(self) -> bool:
        return self.kind() in ("iri", "pname")

    def iri(self) -> str:
        if self.kind() == "iri":
            return self.resolve(self.next()[1:-1])
        if self.kind() == "pname":
            prefix, local = self.next().split(":", 1)
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise self.fail("an IRI")

    def string(self) -> str:
        kind = self.kind()
        if kind == "long":
            return unescape(self.next()[3:-3])
        if kind == "str":
            return unescape(self.next()[1:-1])
        raise self.fail("a string")

    def literal(self) -> tuple:
        kind = self.kind()
        if kind in ("str", "long"):
            lex = self.string()
            if self.kind() == "lang":
                tag = self.next()[1:]
                tag, _, way = tag.partition("--")
                return ("lit", lex, RDF + ("dirLangString" if way else "langString"), tag.lower(), way or None)
            if self.take("^^"):
                return ("lit", lex, self.iri(), None, None)
            return ("lit", lex, STRING, None, None)
        sign = self.next() if self.peek() in ("+", "-") else ""
        if self.kind() in ("integer", "decimal", "double"):
            kind = self.kind()
            return ("lit", sign + self.next(), XSD + kind, None, None)
        if self.is_word("TRUE", "FALSE"):
            return ("lit", self.next().lower(), XSD + "boolean", None, None)
        raise self.fail("a literal")

    def term(self, triples: list | None = None) -> tuple:
        """A node; triples collects what collections, property lists and reifiers add."""
        kind = self.kind()
        if kind == "var":
            return ("var", self.next()[1:])
        if self.at_iri():
            return ("iri", self.iri())
        if kind == "bnode":
            return ("var", self.next())
        if self.take("["):
            node = self.new_bnode()
            if not self.take("]"):
                self.property_list(node, triples)
                self.need("]")
            return node
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.term(triples))
            nodes = [self.new_bnode() for _ in items] + [("iri", RDF + "nil")]
            for i, x in enumerate(items):
                triples.append((nodes[i], ("iri", RDF + "first"), x))
                triples.append((nodes[i], ("iri", RDF + "rest"), nodes[i + 1]))
            return nodes[0]
        if self.take("<<("):
            t = ("triple", self.term(triples), self.verb_term(), self.term(triples))
            self.need(")>>")
            return t
        if self.take("<<"):
            s, p, o = self.term(triples), self.verb_term(), self.term(triples)
            node = self.reifier() if self.take("~") else self.new_bnode()
            self.need(">>")
            triples.append((node, ("iri", RDF + "reifies"), ("triple", s, p, o)))
            return node
        return self.literal()

    def reifier(self) -> tuple:
        if self.kind() == "var" or self.kind() == "bnode" or self.at_iri():
            return self.term([])
        return self.new_bnode()

    def verb_term(self) -> tuple:
        if self.kind() == "word" and self.peek() == "a":
            self.next()
            return ("iri", RDF + "type")
        return ("var", self.next()[1:]) if self.kind() == "var" else ("iri", self.iri())

    # -- triples

    def property_list(self, subject: tuple, out: list) -> None:
        while True:
            if self.peek() in (".", "}", "]", ")", "|}") or self.kind() == "end":
                return
            if self.kind() == "var":
                verb: tuple = ("var", self.next()[1:])
                path = None
            else:
                path = self.path()
                verb = path if path[0] == "iri" else ()
            while True:
                obj = self.term(out)
                out.append((subject, verb, obj) if verb else (subject, ("path", path), obj))
                while self.peek() in ("~", "{|"):
                    node = self.reifier() if self.take("~") else None
                    if node is None or self.peek() == "{|":
                        node = node or self.new_bnode()
                        out.append((node, ("iri", RDF + "reifies"), ("triple", subject, verb, obj)))
                        if self.take("{|"):
                            self.property_list(node, out)
                            self.need("|}")
                    else:
                        out.append((node, ("iri", RDF + "reifies"), ("triple", subject, verb, obj)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass

    def triples_block(self) -> list:
        out: list = []
        while True:
            if self.peek() == "}" or self.kind() == "end" or self.is_word("OPTIONAL", "MINUS", "GRAPH", "SERVICE", "FILTER", "BIND", "VALUES", "LATERAL", "UNION") or self.peek() == "{":
                return out
            alone = self.peek() in ("[", "<<")
            subject = self.term(out)
            if not (alone and self.peek() in (".", "}")):
                self.property_list(subject, out)
            if not self.take("."):
                return out

    def path(self) -> tuple:
        p = self.path_sequence()
        while self.take("|"):
            p = ("alt", p, self.path_sequence())
        return p

    def path_sequence(self) -> tuple:
        p = self.path_elt()
        while self.take("/"):
            p = ("seq", p, self.path_elt())
        return p

    def path_elt(self) -> tuple:
        if self.take("^"):
            return ("inv", self.path_elt())
        if self.take("!"):
            fwd, back = [], []
            items = []
            if self.take("("):
                while not self.take(")"):
                    items.append(self.path_one())
                    self.take("|")
            else:
                items.append(self.path_one())
            for inverse, iri in items:
                (back if inverse else fwd).append(iri)
            p: tuple = ("neg", tuple(fwd), tuple(back))
        elif self.take("("):
            p = self.path()
            self.need(")")
        elif self.kind() == "word" and self.peek() == "a":
            self.next()
            p = ("iri", RDF + "type")
        else:
            p = ("iri", self.iri())
        while self.peek() in ("?", "*", "+") and self.kind() == "op":
            p = ({"?": "opt", "*": "star", "+": "plus"}[self.next()], p)
        return p

    def path_one(self) -> tuple[bool, str]:
        inverse = self.take("^")
        if self.kind() == "word" and self.peek() == "a":
            self.next()
            return inverse, RDF + "type"
        return inverse, self.iri()

    # -- patterns

    @staticmethod
    def join(left: Node | None, right: Node) -> Node:
        if left is None or left == Bgp(()):
            return right
        if isinstance(left, Bgp) and isinstance(right, Bgp):
            return Bgp(left.triples + right.triples)
        return Join(left, right)

    def basic(self, triples: list) -> Node:
        node: Node | None = None
        plain: list = []
        for t in triples:
            if t[1][0] == "path":
                node = self.join(node, Path(t[0], t[1][1], t[2]))
            else:
                plain.append(t)
        if plain or node is None:
            node = Bgp(tuple(plain)) if node is None else Join(Bgp(tuple(plain)), node)
        return node

    def group(self) -> Node:
        self.need("{")
        if self.is_word("SELECT"):
            node: Node = self.sub_select()
            self.need("}")
            return node
        node, filters = Bgp(()), []
        while not self.take("}"):
            if self.kind() == "end":
                raise self.fail("'}'")
            if self.word("OPTIONAL"):
                right = self.group()
                condition = None
                if isinstance(right, Filter):
                    right, condition = right.child, right.condition
                node = LeftJoin(node, right, condition)
            elif self.word("MINUS"):
                node = Minus(node, self.group())
            elif self.word("LATERAL"):
                node = Lateral(node, self.group())
            elif self.word("GRAPH"):
                name = ("var", self.next()[1:]) if self.kind() == "var" else ("iri", self.iri())
                node = self.join(node, Graph(name, self.group()))
            elif self.word("SERVICE"):
                silent = self.word("SILENT")
                name = ("var", self.next()[1:]) if self.kind() == "var" else ("iri", self.iri())
                start = self.tokens[self.i][2]
                child = self.group()
                node = self.join(node, Service(name, child, silent, self.text[start : self.tokens[self.i - 1][2] + 1]))
            elif self.word("FILTER"):
                filters.append(self.constraint())
            elif self.word("BIND"):
                self.need("(")
                value = self.expression()
                self.need_word("AS")
                name = self.next()[1:]
                self.need(")")
                if name in variables(node):
                    raise SparqlError(f"?{name} is bound already")
                node = Extend(node, name, value)
            elif self.word("VALUES"):
                node = self.join(node, self.values())
            elif self.peek() == "{":
                part = self.group()
                while self.word("UNION"):
                    part = Union(part, self.group())
                node = self.join(node, part)
            else:
                before = self.i
                node = self.join(node, self.basic(self.triples_block()))
                if self.i == before:
                    raise self.fail("a pattern")
            self.take(".")
        for f in filters:
            node = Filter(node, ("and", node.condition, f)) if isinstance(node, Filter) and f is not filters[0] else Filter(node, f)
        return node

    def values(self) -> Values:
        names, rows = [], []
        if self.kind() == "var":
            names = [self.next()[1:]]
            self.need("{")
            while not self.take("}"):
                rows.append((self.value(),))
        else:
            self.need("(")
            while not self.take(")"):
                names.append(self.next()[1:])
            self.need("{")
            while not self.take("}"):
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(self.value())
                if len(row) != len(names):
                    raise SparqlError("a VALUES row differs in length from its variables")
                rows.append(tuple(row))
        return Values(tuple(names), tuple(rows))

    def value(self) -> tuple | None:
        return None if self.word("UNDEF") else self.term([])

    # -- expressions

    def constraint(self) -> tuple:
        if self.peek() == "(":
            self.need("(")
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.take("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.relational()
        while self.take("&&"):
            e = ("and", e, self.relational())
        return e

    def relational(self) -> tuple:
        e = self.additive()
        if self.kind() == "op" and self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            return (self.next(), e, self.additive())
        negated = self.is_word("NOT") and self.peek(1).upper() == "IN"
        if negated:
            self.next()
        if self.word("IN"):
            return ("notin" if negated else "in", e, tuple(self.arguments()))
        return e

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            if not self.take(",") and self.peek() != ")":
                raise self.fail("','")
        return out

    def additive(self) -> tuple:
        e = self.multiplicative()
        while self.kind() == "op" and self.peek() in ("+", "-"):
            e = (self.next(), e, self.multiplicative())
        return e

    def multiplicative(self) -> tuple:
        e = self.unary()
        while self.kind() == "op" and self.peek() in ("*", "/"):
            e = (self.next(), e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.kind() == "op" and self.peek() in ("+", "-"):
            return ("u" + self.next(), self.unary())
        return self.primary()

    def primary(self) -> tuple:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind() == "var":
            return ("var", self.next()[1:])
        if self.at_iri():
            iri = self.iri()
            if self.peek() == "(":
                if self.peek(1) == "" or self.word("DISTINCT"):
                    pass
                return ("fn", iri, tuple(self.arguments()))
            return ("const", ("iri", iri))
        if self.peek() == "<<(":
            return ("const_triple", self.term([]))
        if self.kind() == "word":
            w = self.peek().upper()
            if w == "EXISTS":
                self.next()
                return ("exists", self.group())
            if w == "NOT" and self.peek(1).upper() == "EXISTS":
                self.i += 2
                return ("not", ("exists", self.group()))
            if w in AGGREGATES:
                return self.aggregate()
            if w in BUILTINS:
                self.next()
                return ("call", w, tuple(self.arguments()))
        return ("const", self.literal())

    def aggregate(self) -> tuple:
        if self.aggregates is None:
            raise SparqlError("an aggregate stands where none may")
        name = self.next().upper()
        self.need("(")
        distinct = self.word("DISTINCT")
        value, separator = None, " "
        if not (name == "COUNT" and self.take("*")):
            value = self.expression()
        if self.take(";"):
            self.need_word("SEPARATOR")
            self.need("=")
            separator = self.string()
        self.need(")")
        spec = (name, value, distinct, separator)
        for var, known in self.aggregates:
            if known == spec:
                return ("var", var)
        var = f"_:agg{len(self.aggregates)}_{self.i}"
        self.aggregates.append((var, spec))
        return ("var", var)

    # -- queries

    def prologue(self) -> None:
        while True:
            if self.word("PREFIX"):
                name = self.next()
                self.prefixes[name[:-1]] = self.resolve(self.next()[1:-1])
            elif self.word("BASE"):
                self.base = self.resolve(self.next()[1:-1])
            elif self.word("VERSION"):
                self.string()
            else:
                return

    def sub_select(self) -> Node:
        self.need_word("SELECT")
        distinct, reduced = self.word("DISTINCT"), self.word("REDUCED")
        outer, self.aggregates = self.aggregates, []
        items: list[tuple[str, tuple | None]] = []
        star = self.take("*")
        while not star and (self.kind() == "var" or self.peek() == "("):
            if self.kind() == "var":
                items.append((self.next()[1:], None))
            else:
                self.need("(")
                e = self.expression()
                self.need_word("AS")
                items.append((self.next()[1:], e))
                self.need(")")
        if not star and not items:
            raise self.fail("what to select")
        self.dataset()
        self.word("WHERE")
        node = self.modifiers(self.group(), items, star)
        self.aggregates = outer
        return self.wrap(node, distinct, reduced)

    def wrap(self, node: Node, distinct: bool, reduced: bool) -> Node:
        child, offset, limit = node
        if distinct:
            child = Distinct(child)
        elif reduced:
            child = Reduced(child)
        return Slice(child, offset, limit) if offset or limit is not None else child

    def modifiers(self, pattern: Node, items: list, star: bool) -> tuple:
        keys, grouped, extends = [], False, []
        if self.word("GROUP"):
            self.need_word("BY")
            grouped = True
            while self.kind() == "var" or self.peek() == "(" or self.at_iri() or (self.kind() == "word" and self.peek().upper() in BUILTINS):
                if self.kind() == "var":
                    keys.append(self.next()[1:])
                elif self.take("("):
                    e = self.expression()
                    name = f"_:key{self.i}"
                    if self.word("AS"):
                        name = self.next()[1:]
                    self.need(")")
                    extends.append((name, e))
                    keys.append(name)
                else:
                    name = f"_:key{self.i}"
                    extends.append((name, self.primary()))
                    keys.append(name)
        having = []
        if self.word("HAVING"):
            while self.peek() == "(" or self.at_iri() or (self.kind() == "word" and self.peek().upper() in BUILTINS | AGGREGATES):
                having.append(self.constraint())
        order = []
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                if self.is_word("ASC", "DESC"):
                    up = self.next().upper() == "ASC"
                    order.append((self.constraint(), up))
                elif self.kind() == "var" or self.peek() == "(" or self.at_iri() or (self.kind() == "word" and self.peek().upper() in BUILTINS | AGGREGATES):
                    order.append((self.constraint(), True))
                else:
                    break
        offset, limit = 0, None
        while self.is_word("LIMIT", "OFFSET"):
            if self.next().upper() == "LIMIT":
                limit = int(self.next())
            else:
                offset = int(self.next())
        if self.word("VALUES"):
            pattern = self.join(pattern, self.values())
        node = pattern
        if grouped or self.aggregates:
            for name, e in extends:
                node = Extend(node, name, e)
            node = Group(node, tuple(keys), tuple(self.aggregates))
            if star:
                raise SparqlError("SELECT * cannot be grouped")
            free = set(keys) | {v for v, _ in self.aggregates}
            for v, e in items:
                if e is None and v not in free:
                    raise SparqlError(f"?{v} is neither grouped nor aggregated")
        for e in having:
            node = Filter(node, e)
        seen = set(variables(node))
        for name, e in items:
            if e is not None:
                if name in seen:
                    raise SparqlError(f"?{name} is bound already")
                node = Extend(node, name, e)
                seen.add(name)
        if order:
            node = OrderBy(node, tuple(order))
        names = variables(node) if star else [n for n, _ in items]
        return Project(node, tuple(names)), offset, limit

    def dataset(self) -> tuple[list | None, list | None]:
        default, named = None, None
        while self.word("FROM"):
            if self.word("NAMED"):
                named = [*(named or []), self.iri()]
            else:
                default = [*(default or []), self.iri()]
        return default, named

    def query(self) -> Query:
        self.prologue()
        if self.is_word("SELECT"):
            # The dataset clause stands inside; it is read again from its place.
            mark = self.i
            pattern = self.sub_select()
            end, self.i = self.i, mark
            depth = 0
            clause: tuple = (None, None)
            while self.i < end and not (self.peek() == "{" and depth == 0):
                if self.is_word("FROM"):
                    clause = self.dataset()
                    break
                depth += (self.peek() == "(") - (self.peek() == ")")
                self.i += 1
            self.i = end
            q = Query("select", pattern, default_graphs=clause[0], named_graphs=clause[1], base=self.base)
        elif self.word("ASK"):
            d, n = self.dataset()
            self.word("WHERE")
            q = Query("ask", self.plain_modifiers(self.group()), default_graphs=d, named_graphs=n, base=self.base)
        elif self.word("CONSTRUCT"):
            if self.peek() == "{":
                self.need("{")
                template = self.triples_block()
                self.need("}")
                d, n = self.dataset()
                self.word("WHERE")
                pattern = self.plain_modifiers(self.group())
            else:
                d, n = self.dataset()
                self.need_word("WHERE")
                self.need("{")
                template = self.triples_block()
                self.need("}")
                pattern = self.plain_modifiers(self.basic(template))
            q = Query("construct", pattern, template, default_graphs=d, named_graphs=n, base=self.base)
        elif self.word("DESCRIBE"):
            what = []
            star = self.take("*")
            while not star and (self.kind() == "var" or self.at_iri()):
                what.append(self.term([]))
            d, n = self.dataset()
            pattern = Bgp(())
            if self.word("WHERE") or self.peek() == "{":
                pattern = self.group()
            pattern = self.plain_modifiers(pattern)
            what = [("var", v) for v in variables(pattern)] if star else what
            q = Query("describe", pattern, described=what, default_graphs=d, named_graphs=n, base=self.base)
        else:
            raise self.fail("SELECT, ASK, CONSTRUCT or DESCRIBE")
        if self.kind() != "end":
            raise self.fail("the end")
        return q

    def plain_modifiers(self, pattern: Node) -> Node:
        self.aggregates = []
        child, offset, limit = self.modifiers(pattern, [], True)
        self.aggregates = None
        return Slice(child, offset, limit) if offset or limit is not None else child

    # -- updates

    def updates(self) -> list[Update]:
        out = []
        while True:
            self.prologue()
            if self.kind() == "end":
                return out
            out += self.update()
            if not self.take(";"):
                if self.kind() != "end":
                    raise self.fail("';'")
                return out

    def quads(self, variables_allowed: bool = True) -> list:
        """Quad templates (graph or None, s, p, o)."""
        out: list = []
        self.need("{")
        while not self.take("}"):
            if self.word("GRAPH"):
                g = ("var", self.next()[1:]) if self.kind() == "var" else ("iri", self.iri())
                self.need("{")
                out += [(g, *t) for t in self.triples_block()]
                self.need("}")
            else:
                out += [(None, *t) for t in self.triples_block()]
            self.take(".")
        if not variables_allowed and any(x and x[0] == "var" and not x[1].startswith("_:") for t in out for x in t):
            raise SparqlError("data may hold no variables")
        return out

    def target(self) -> tuple:
        if self.word("DEFAULT"):
            return ("default",)
        if self.word("NAMED"):
            return ("named",)
        if self.word("ALL"):
            return ("all",)
        self.word("GRAPH")
        return ("graph", self.iri())

    def update(self) -> list[Update]:
        if self.word("LOAD"):
            silent = self.word("SILENT")
            source = self.iri()
            target = ("default",)
            if self.word("INTO"):
                self.need_word("GRAPH")
                target = ("graph", self.iri())
            return [Update("load", source=source, target=target, silent=silent)]
        for kind in ("CLEAR", "DROP", "CREATE"):
            if self.word(kind):
                silent = self.word("SILENT")
                return [Update(kind.lower(), target=self.target(), silent=silent)]
        for kind in ("COPY", "MOVE", "ADD"):
            if self.word(kind):
                silent = self.word("SILENT")
                a = self.target()
                self.need_word("TO")
                return self.transfer(kind, a, self.target(), silent)
        if self.is_word("INSERT", "DELETE") and self.peek(1).upper() == "DATA":
            kind = self.next().upper()
            self.next()
            quads = self.quads(variables_allowed=False)
            return [Update("insert_data", inserts=quads) if kind == "INSERT" else Update("delete_data", deletes=quads)]
        if self.is_word("DELETE") and self.peek(1).upper() == "WHERE":
            self.i += 2
            quads = self.quads()
            return [Update("modify", deletes=quads, pattern=self.quads_pattern(quads))]
        graph = None
        if self.word("WITH"):
            graph = ("iri", self.iri())
        deletes, inserts = [], []
        if self.word("DELETE"):
            deletes = self.quads()
        if self.word("INSERT"):
            inserts = self.quads()
        default = named = None
        while self.word("USING"):
            if self.word("NAMED"):
                named = [*(named or []), self.iri()]
            else:
                default = [*(default or []), self.iri()]
        self.need_word("WHERE")
        pattern = self.group()
        if graph:
            deletes, inserts = ([(t[0] or graph, *t[1:]) for t in part] for part in (deletes, inserts))
            if default is None and named is None:
                default = [graph[1]]
        return [Update("modify", deletes=list(deletes), inserts=list(inserts), pattern=pattern, default_graphs=default, named_graphs=named)]

    def quads_pattern(self, quads: list) -> Node:
        node: Node = Bgp(())
        by: dict = {}
        for g, *t in quads:
            by.setdefault(g, []).append(tuple(t))
        for g, triples in by.items():
            part = self.basic(triples)
            node = self.join(node, Graph(g, part) if g else part)
        return node

    def transfer(self, kind: str, a: tuple, b: tuple, silent: bool) -> list[Update]:
        if a == b:
            return []
        v = (("var", "s"), ("var", "p"), ("var", "o"))
        ga, gb = (("iri", x[1]) if x[0] == "graph" else None for x in (a, b))
        pattern: Node = Bgp((v,))
        copy = Update("modify", inserts=[(gb, *v)], pattern=Graph(ga, pattern) if ga else pattern, silent=silent)
        out = [] if kind == "ADD" else [Update("clear", target=b, silent=True)]
        return [*out, copy, *([Update("drop", target=a, silent=True)] if kind == "MOVE" else [])]


def parse_query(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, base, prefixes).query()


def parse_update(text: str, base: str | None = None, prefixes: dict[str, str] | None = None) -> list[Update]:
    return Parser(text, base, prefixes).updates()

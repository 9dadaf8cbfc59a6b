"""SPARQL expressions as columns. A type error and an unbound variable are both null.

A compiled expression is a Value, which holds whichever of its forms it was made in (term, boolean, number, text) and
derives the others when asked, so that comparing a variable with a number never builds terms in between.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import RDF, STRING, XSD
from . import terms as t
from .terms import BNODE, DEC, INTEGERS, IRI, LITERAL, TRIPLE


@dataclass
class Value:
    as_term: Column | None = None
    as_bool: Column | None = None
    rank: Column | None = None  # 1 integer, 2 decimal, 3 float, 4 double
    dec: Column | None = None
    dbl: Column | None = None
    as_text: Column | None = None  # a plain xsd:string

    def term(self) -> Column:
        if self.as_term is not None:
            return self.as_term
        if self.as_bool is not None:
            return F.when(self.as_bool.isNotNull(), t.literal(self.as_bool.cast("string"), XSD + "boolean"))
        if self.as_text is not None:
            return F.when(self.as_text.isNotNull(), t.literal(self.as_text))
        lex = F.when(self.rank == 1, self.dec.cast("decimal(38,0)").cast("string")).when(self.rank == 2, t.decimal_text(self.dec)).otherwise(t.double_text(self.dbl))
        dt = F.when(self.rank == 1, XSD + "integer").when(self.rank == 2, XSD + "decimal").when(self.rank == 3, XSD + "float").otherwise(XSD + "double")
        return F.when(self.rank.isNotNull() & lex.isNotNull(), t.literal(lex, dt))

    def bool(self) -> Column:
        """Effective boolean value."""
        if self.as_bool is not None:
            return self.as_bool
        if self.as_text is not None:
            return self.as_text != ""
        if self.rank is not None:
            return F.when(self.rank <= 2, self.dec != 0).otherwise((self.dbl != 0) & ~F.isnan(self.dbl))
        x = self.as_term
        number = x["lex"].try_cast("double")
        return (
            F.when(t.is_type(x, XSD + "boolean"), x["lex"].isin("true", "1"))
            .when(t.is_type(x, STRING), x["lex"] != "")
            .when(t.is_type(x, t.NUMERIC), F.coalesce((number != 0) & ~F.isnan(number), F.lit(False)))
            .when((x["k"] == LITERAL) & ~x["dt"].startswith(XSD) & x["lang"].isNull(), x["lex"] != "")
        )

    def num(self) -> Value:
        if self.rank is not None:
            return self
        if self.as_bool is not None or self.as_text is not None:
            return Value(rank=F.lit(None).cast("int"), dec=F.lit(None).cast(DEC), dbl=F.lit(None).cast("double"))
        x = self.as_term
        kind = F.when(x["k"] != LITERAL, None).when(x["dt"].isin(*INTEGERS), 1).when(x["dt"] == XSD + "decimal", 2).when(x["dt"] == XSD + "float", 3).when(x["dt"] == XSD + "double", 4)
        dbl = F.when(kind.isNotNull(), F.trim(x["lex"]).try_cast("double"))
        dec = F.when(kind <= 2, F.trim(x["lex"]).try_cast(DEC))
        ok = F.when(kind <= 2, dec.isNotNull()).otherwise(dbl.isNotNull())
        return Value(rank=F.when(ok, kind), dec=dec, dbl=dbl)

    def text(self) -> Column:
        """Lexical form of a string literal, plain or with a language."""
        if self.as_text is not None:
            return self.as_text
        x = self.term()
        return F.when((x["k"] == LITERAL) & ((x["dt"] == STRING) | x["lang"].isNotNull()), x["lex"])

    def like(self, lex: Column) -> Value:
        """A literal with this one's language and datatype."""
        if self.as_text is not None:
            return Value(as_text=lex)
        x = self.term()
        return Value(as_term=F.when(lex.isNotNull() & self.text().isNotNull(), t.literal(lex, x["dt"], x["lang"], x["dir"])))


@dataclass
class Context:
    """What expressions of one query share."""

    base: str | None = None
    now: str = ""
    functions: dict[str, Callable] = field(default_factory=dict)


def integer(c: Column) -> Value:
    return Value(rank=F.when(c.isNotNull(), 1), dec=c.cast(DEC), dbl=c.cast("double"))


def number(rank: Column, dec: Column, dbl: Column) -> Value:
    """A number whose lane may have failed (overflow, division by zero): then it is an error."""
    ok = F.when(rank <= 2, dec.isNotNull()).otherwise(dbl.isNotNull())
    return Value(rank=F.when(ok, rank), dec=dec, dbl=dbl)


def both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def equals(a: Value, b: Value) -> Column:
    if a.as_bool is not None and b.as_bool is not None:
        return a.as_bool == b.as_bool
    m, n = a.num(), b.num()
    by_number = F.when((m.rank <= 2) & (n.rank <= 2), m.dec == n.dec).otherwise((m.dbl == n.dbl) & ~F.isnan(m.dbl))
    numbers = both(m.rank, n.rank)
    if a.rank is not None and b.rank is not None:
        return F.when(numbers, by_number)
    if a.rank is not None or b.rank is not None:  # a number beside a term: anything but a literal differs from it
        return F.when(numbers, by_number).when((b if a.rank is not None else a).term()["k"] != LITERAL, False)
    if a.as_text is not None or b.as_text is not None:
        x, y = (a, b) if a.as_text is not None else (b, a)
        if y.as_text is not None:
            return x.as_text == y.as_text
        z = y.term()
        return F.when(t.is_type(z, STRING), z["lex"] == x.as_text).when((z["k"] != LITERAL) | z["lang"].isNotNull(), F.when(x.as_text.isNotNull(), False))
    x, y = a.term(), b.term()
    truth = lambda v: F.when(t.is_type(v, XSD + "boolean") & v["lex"].isin("true", "1", "false", "0"), v["lex"].isin("true", "1"))
    literals = (x["k"] == LITERAL) & (y["k"] == LITERAL)
    stringy = (x["dt"] == STRING) | x["lang"].isNotNull()
    stringy_y = (y["dt"] == STRING) | y["lang"].isNotNull()
    return F.when(both(x, y), (
        F.when(numbers, by_number)
        .when(x.eqNullSafe(y), True)
        .when(~literals, False)
        .when(both(truth(x), truth(y)), truth(x) == truth(y))
        .when(both(t.moment(x), t.moment(y)) & (x["dt"] == y["dt"]), t.moment(x) == t.moment(y))
        .when(stringy & stringy_y, False)
        # The same datatype compares by its text; different ones can't be told apart: an error.
        .when((x["dt"] == y["dt"]) & ~x["dt"].isin(*t.NUMERIC), False)
    ))


def compare(op: str, a: Value, b: Value) -> Column:
    def apply(p: Column, q: Column) -> Column:
        return {"<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]

    m, n = a.num(), b.num()
    nan = F.isnan(m.dbl) | F.isnan(n.dbl)
    by_number = F.when((m.rank <= 2) & (n.rank <= 2), apply(m.dec, n.dec)).otherwise(apply(m.dbl, n.dbl) & ~nan)
    numbers = both(m.rank, n.rank)
    if a.rank is not None or b.rank is not None:
        return F.when(numbers, by_number)
    if a.as_text is not None or b.as_text is not None:
        p, q = (v.as_text if v.as_text is not None else F.when(t.is_type(v.term(), STRING), v.term()["lex"]) for v in (a, b))
        return apply(p, q)
    x, y = a.term(), b.term()
    ta, tb = t.moment(x), t.moment(y)
    literals = (x["k"] == LITERAL) & (y["k"] == LITERAL)
    return (
        F.when(numbers, by_number)
        .when(both(ta, tb), apply(ta, tb))
        .when(literals & (x["dt"] == y["dt"]) & x["lang"].eqNullSafe(y["lang"]) & ~x["dt"].isin(*t.NUMERIC), apply(x["lex"], y["lex"]))
        .when((x["k"] == y["k"]) & x["k"].isin(BNODE, IRI), apply(x["lex"], y["lex"]))
    )


def arithmetic(op: str, a: Value, b: Value) -> Value:
    m, n = a.num(), b.num()
    rank = F.greatest(m.rank, n.rank)
    rank = F.when(both(m.rank, n.rank), rank)
    if op == "/":
        rank = F.when(rank == 1, 2).otherwise(rank)
        # An exact quotient keeps 18 digits; division by zero is an error for exact numbers only.
        dec = F.try_divide(m.dec.try_cast("decimal(38,10)"), n.dec.try_cast("decimal(28,10)")).try_cast(DEC)
        return number(rank, dec, F.when((n.dbl != 0) | F.isnan(n.dbl), F.try_divide(m.dbl, n.dbl)).otherwise(F.when((m.dbl == 0) | F.isnan(m.dbl), float("nan")).otherwise(F.signum(m.dbl) * float("inf"))))
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    if op == "*":
        dec = F.when(rank == 1, f(m.dec.try_cast("decimal(38,0)"), n.dec.try_cast("decimal(38,0)")).try_cast(DEC)).otherwise(f(m.dec, n.dec).try_cast(DEC))
    else:
        dec = f(m.dec, n.dec).try_cast(DEC)
    return number(rank, dec, {"+": m.dbl + n.dbl, "-": m.dbl - n.dbl, "*": m.dbl * n.dbl}[op])


def _regex(flags: Value | None, pattern: tuple, compiled: Value, extra: str = "") -> Column:
    if flags is None:
        return compiled.text()
    f = flags.text()
    return F.concat(F.when(f == "", "").otherwise(F.concat(F.lit("(?"), f, F.lit(")"))), compiled.text())


def _valid_pattern(e: tuple) -> bool:
    if e[0] == "const" and e[1][0] == "lit":
        try:
            re.compile(e[1][1])
        except re.error:
            return False
    return True


_DATE = r"^(-?\d{4,})-(\d\d)-(\d\d)"
_TIME = r"(?:^|T)(\d\d):(\d\d):(\d\d(?:\.\d+)?)"


class Compiler:
    """Compiles expressions against a set of variable columns; exists() comes from the pattern compiler."""

    def __init__(self, columns: dict[str, Column], context: Context, flags: dict | None = None, steps: list | None = None):
        """steps: where it is given, computed arguments become columns of their own, (name, column) in order of need."""
        self.columns, self.context, self.flags, self.steps = columns, context, flags or {}, steps

    def _step(self, c: Column) -> Column:
        name = f"__e{len(self.steps)}"
        # The guard always holds; as it isn't deterministic, the optimizer won't expand the column into its uses again.
        self.steps.append((name, F.when(F.monotonically_increasing_id() >= 0, c)))
        return F.col(name)

    def arg(self, e: tuple) -> Value:
        """An argument; what is computed is computed once, however often the form that uses it names it."""
        v = self.value(e)
        if self.steps is None or e[0] in ("var", "const"):
            return v
        if v.rank is not None:
            return Value(rank=self._step(v.rank), dec=self._step(v.dec), dbl=self._step(v.dbl))
        if v.as_bool is not None:
            return Value(as_bool=self._step(v.as_bool))
        if v.as_text is not None:
            return Value(as_text=self._step(v.as_text))
        return Value(as_term=self._step(v.as_term))

    def value(self, e: tuple) -> Value:
        op, args = e[0], e[1:]
        match op:
            case "var":
                return Value(as_term=self.columns.get(args[0], t.null_term()))
            case "const":
                return self.constant(args[0])
            case "const_triple":
                return self.triple(*(self.value(("var", x[1]) if x[0] == "var" else ("const_triple", x) if x[0] == "triple" else ("const", x)) for x in args[0][1:]))
            case "or":
                return Value(as_bool=self.arg(args[0]).bool() | self.arg(args[1]).bool())
            case "and":
                return Value(as_bool=self.arg(args[0]).bool() & self.arg(args[1]).bool())
            case "not":
                return Value(as_bool=~self.arg(args[0]).bool())
            case "=":
                return Value(as_bool=equals(self.arg(args[0]), self.arg(args[1])))
            case "!=":
                return Value(as_bool=~equals(self.arg(args[0]), self.arg(args[1])))
            case "<" | ">" | "<=" | ">=":
                return Value(as_bool=compare(op, self.arg(args[0]), self.arg(args[1])))
            case "in" | "notin":
                own = self.arg(args[0])
                found = reduce(lambda p, q: p | q, (equals(own, self.arg(x)) for x in args[1]), F.when(own.term().isNotNull(), False))
                return Value(as_bool=found if op == "in" else ~found)
            case "+" | "-" | "*" | "/":
                return arithmetic(op, self.arg(args[0]), self.arg(args[1]))
            case "u-":
                n = self.arg(args[0]).num()
                return Value(rank=n.rank, dec=-n.dec, dbl=-n.dbl)
            case "u+":
                return self.arg(args[0]).num()
            case "exists":
                return Value(as_bool=self.flags[id(e)])
            case "fn":
                return self.named(args[0], args[1])
            case "call":
                return self.call(args[0], args[1])
        raise ValueError(f"unknown expression {op}")

    def constant(self, x: tuple) -> Value:
        if x[0] == "lit" and x[2] == STRING:
            return Value(as_text=F.lit(x[1]))
        if x[0] == "lit" and x[2] == XSD + "boolean" and x[1] in ("true", "false"):
            return Value(as_bool=F.lit(x[1] == "true"))
        if x[0] == "lit" and x[2] in (XSD + "integer", XSD + "decimal", XSD + "double"):
            try:
                dbl = float(x[1])
                rank = {"integer": 1, "decimal": 2, "double": 4}[x[2][len(XSD) :]]
                dec = F.lit(x[1].strip()).cast(DEC) if rank <= 2 and len(x[1]) < 19 else F.lit(None).cast(DEC)
                if rank == 4 or len(x[1]) < 19:
                    return Value(as_term=t.constant(x), rank=F.lit(rank), dec=dec, dbl=F.lit(dbl))
            except ValueError:
                pass
        return Value(as_term=t.constant(x))

    def triple(self, s: Value, p: Value, o: Value) -> Value:
        a, b, c = s.term(), p.term(), o.term()
        text = F.concat(F.lit("<<( "), t.text_of(a), F.lit(" "), t.text_of(b), F.lit(" "), t.text_of(c), F.lit(" )>>"))
        return Value(as_term=F.when((a["k"] != LITERAL) & (b["k"] == IRI) & c.isNotNull(), t.term(TRIPLE, text)))

    def named(self, name: str, args: tuple) -> Value:
        """Casts, text search, geometry and registered functions."""
        values = [self.arg(a) for a in args]
        if name.startswith(XSD):
            return cast(name, values[0])
        if name in self.context.functions:
            return self.context.functions[name](*values)
        if name.endswith(("fn/text#query", "fn/text#contains")):
            from ..operators.fulltext import matches

            return Value(as_bool=matches(values[0].term(), args[1][1][1], phrase=name.endswith("contains")))
        if name.startswith("http://www.opengis.net/def/function/geosparql/"):
            from . import geo

            return geo.call(name, values)
        return Value(as_term=t.null_term())

    def call(self, name: str, args: tuple) -> Value:
        if name == "BOUND":
            return Value(as_bool=self.columns[args[0][1]].isNotNull() if args[0][1] in self.columns else F.lit(False))
        if name == "IF":
            c, a, b = (self.arg(x) for x in args)
            cond = c.bool()
            if a.as_text is not None and b.as_text is not None:
                return Value(as_text=F.when(cond, a.as_text).when(~cond, b.as_text))
            return Value(as_term=F.when(cond, a.term()).when(~cond, b.term()))
        if name == "COALESCE":
            return Value(as_term=F.coalesce(*(self.arg(x).term() for x in args)) if args else t.null_term())
        v = [self.arg(x) for x in args]
        if name in ("REGEX", "REPLACE"):
            if not _valid_pattern(args[1]):
                return Value(as_term=t.null_term())
            flags = v[3 if name == "REPLACE" else 2] if len(v) > (3 if name == "REPLACE" else 2) else None
            pattern = _regex(flags, args[1], v[1])
            if name == "REGEX":
                return Value(as_bool=F.rlike(v[0].text(), pattern))
            return v[0].like(F.regexp_replace(v[0].text(), pattern, v[2].text()))
        method = getattr(self, "f_" + name.lower(), None)
        return method(*v) if method else Value(as_term=t.null_term())

    # -- terms

    def f_str(self, a: Value) -> Value:
        x = a.term()
        return Value(as_text=F.when(x["k"].isin(IRI, LITERAL), x["lex"]))

    def f_lang(self, a: Value) -> Value:
        x = a.term()
        return Value(as_text=F.when(x["k"] == LITERAL, F.coalesce(x["lang"], F.lit(""))))

    def f_langdir(self, a: Value) -> Value:
        x = a.term()
        return Value(as_text=F.when(x["k"] == LITERAL, F.coalesce(x["dir"], F.lit(""))))

    def f_langmatches(self, a: Value, b: Value) -> Value:
        tag, wanted = F.lower(a.text()), F.lower(b.text())
        return Value(as_bool=F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))

    def f_haslang(self, a: Value) -> Value:
        x = a.term()
        return Value(as_bool=F.when(x.isNotNull(), x["lang"].isNotNull()))

    def f_haslangdir(self, a: Value) -> Value:
        x = a.term()
        return Value(as_bool=F.when(x.isNotNull(), x["dir"].isNotNull()))

    def f_datatype(self, a: Value) -> Value:
        x = a.term()
        return Value(as_term=F.when(x["k"] == LITERAL, t.iri(x["dt"])))

    def f_iri(self, a: Value) -> Value:
        x = a.term()
        lex = F.when((x["k"] == IRI) | (x["dt"] == STRING), x["lex"])
        if self.context.base:
            from urllib.parse import urljoin

            base = self.context.base
            resolve = F.pandas_udf(lambda s: s.map(lambda i: None if i is None else urljoin(base, i)).astype(object), "string", F.PandasUDFType.SCALAR)
            lex = F.when(lex.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), lex).when(lex.isNotNull(), resolve(lex))
        return Value(as_term=F.when((lex != "") & ~lex.rlike('[<>"{}|^`\\\\\\x00-\\x20]'), t.iri(lex)))

    f_uri = f_iri

    def f_bnode(self, a: Value | None = None) -> Value:
        if a is None:
            return Value(as_term=t.term(BNODE, F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit("")))))
        row = F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(self.columns.values())))) if self.columns else F.lit("")
        return Value(as_term=F.when(a.text().isNotNull(), t.term(BNODE, F.concat(F.lit("b"), F.substring(F.sha2(F.concat(a.text(), F.lit("\x00"), row), 256), 1, 32)))))

    def f_strlang(self, a: Value, b: Value) -> Value:
        x = a.term()
        return Value(as_term=F.when(t.is_type(x, STRING) & (b.text() != ""), t.literal(x["lex"], RDF + "langString", F.lower(b.text()))))

    def f_strlangdir(self, a: Value, b: Value, c: Value) -> Value:
        x = a.term()
        return Value(as_term=F.when(t.is_type(x, STRING) & (b.text() != "") & c.text().isin("ltr", "rtl"), t.literal(x["lex"], RDF + "dirLangString", F.lower(b.text()), c.text())))

    def f_strdt(self, a: Value, b: Value) -> Value:
        x, y = a.term(), b.term()
        return Value(as_term=F.when(t.is_type(x, STRING) & (y["k"] == IRI), t.literal(x["lex"], y["lex"])))

    def f_sameterm(self, a: Value, b: Value) -> Value:
        x, y = a.term(), b.term()
        return Value(as_bool=F.when(both(x, y), x.eqNullSafe(y)))

    def _kind(self, a: Value, k: int) -> Value:
        return Value(as_bool=a.term()["k"] == k)

    def f_isiri(self, a: Value) -> Value:
        return self._kind(a, IRI)

    f_isuri = f_isiri

    def f_isblank(self, a: Value) -> Value:
        return self._kind(a, BNODE)

    def f_isliteral(self, a: Value) -> Value:
        return self._kind(a, LITERAL)

    def f_istriple(self, a: Value) -> Value:
        return self._kind(a, TRIPLE)

    def f_isnumeric(self, a: Value) -> Value:
        x = a.term()
        return Value(as_bool=F.when(x.isNotNull(), F.coalesce(t.is_type(x, t.NUMERIC), F.lit(False))))

    def f_triple(self, s: Value, p: Value, o: Value) -> Value:
        return self.triple(s, p, o)

    def _part(self, a: Value, n: str) -> Value:
        return Value(as_term=t.triple_parts(a.term())[n])

    def f_subject(self, a: Value) -> Value:
        return self._part(a, "s")

    def f_predicate(self, a: Value) -> Value:
        return self._part(a, "p")

    def f_object(self, a: Value) -> Value:
        return self._part(a, "o")

    # -- numbers

    def _round(self, a: Value, f: Callable[[Column], Column]) -> Value:
        n = a.num()
        return number(n.rank, f(n.dec).try_cast(DEC), F.when(F.isnan(n.dbl) | (F.abs(n.dbl) >= 2.0**52), n.dbl).otherwise(f(n.dbl).cast("double")))

    def f_abs(self, a: Value) -> Value:
        return self._round(a, F.abs)

    def f_ceil(self, a: Value) -> Value:
        return self._round(a, F.ceil)

    def f_floor(self, a: Value) -> Value:
        return self._round(a, F.floor)

    def f_round(self, a: Value) -> Value:
        n = a.num()
        half = F.lit(0.5).cast("decimal(2,1)")
        return number(n.rank, F.floor(n.dec + half).try_cast(DEC), F.when(F.isnan(n.dbl) | (F.abs(n.dbl) >= 2.0**52), n.dbl).otherwise(F.floor(n.dbl + 0.5).cast("double")))

    def f_rand(self) -> Value:
        r = F.rand()
        return Value(as_term=t.literal(t.double_text(r), XSD + "double"))

    # -- strings

    def f_concat(self, *v: Value) -> Value:
        if not v:
            return Value(as_text=F.lit(""))
        text = F.concat(*(x.text() for x in v))
        if all(x.as_text is not None for x in v):
            return Value(as_text=text)
        ts = [x.term() for x in v]
        same = reduce(lambda p, q: p & q, (ts[0]["lang"].eqNullSafe(x["lang"]) & ts[0]["dir"].eqNullSafe(x["dir"]) for x in ts[1:]), ts[0]["lang"].isNotNull())
        return Value(as_term=F.when(text.isNotNull(), F.when(same, t.literal(text, ts[0]["dt"], ts[0]["lang"], ts[0]["dir"])).otherwise(t.literal(text))))

    def f_strlen(self, a: Value) -> Value:
        return integer(F.length(a.text()))

    def f_ucase(self, a: Value) -> Value:
        return a.like(F.upper(a.text()))

    def f_lcase(self, a: Value) -> Value:
        return a.like(F.lower(a.text()))

    def f_substr(self, a: Value, b: Value, c: Value | None = None) -> Value:
        start = F.floor(b.num().dbl + 0.5).cast("int")
        begin = F.greatest(start, F.lit(1))
        if c is None:
            return a.like(F.when(start.isNotNull(), F.substr(a.text(), begin)))
        end = start + F.floor(c.num().dbl + 0.5).cast("int")
        return a.like(F.when(end.isNotNull(), F.substr(a.text(), begin, F.greatest(end - begin, F.lit(0)))))

    def f_contains(self, a: Value, b: Value) -> Value:
        return Value(as_bool=F.contains(a.text(), b.text()))

    def f_strstarts(self, a: Value, b: Value) -> Value:
        return Value(as_bool=F.startswith(a.text(), b.text()))

    def f_strends(self, a: Value, b: Value) -> Value:
        return Value(as_bool=F.endswith(a.text(), b.text()))

    def _cut(self, a: Value, b: Value, before: bool) -> Value:
        x, y = a.text(), b.text()
        at = F.instr(x, y) if not isinstance(y, str) else None
        lex = F.when(at > 0, F.substr(x, F.lit(1), at - 1) if before else F.substr(x, at + F.length(y)))
        found = a.like(lex).term()
        empty = t.literal("")
        p, q = a.term(), b.term()
        fits = q["lang"].isNull() | p["lang"].eqNullSafe(q["lang"])
        return Value(as_term=F.when(both(x, y) & fits, F.coalesce(found, empty)))

    def f_strbefore(self, a: Value, b: Value) -> Value:
        return self._cut(a, b, True)

    def f_strafter(self, a: Value, b: Value) -> Value:
        return self._cut(a, b, False)

    def f_encode_for_uri(self, a: Value) -> Value:
        x = F.url_encode(a.text())
        for p, q in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            x = F.replace(x, F.lit(p), F.lit(q))
        return Value(as_text=x)

    def _hash(self, a: Value, f: Callable[[Column], Column]) -> Value:
        return Value(as_text=f(a.text()))

    def f_md5(self, a: Value) -> Value:
        return self._hash(a, F.md5)

    def f_sha1(self, a: Value) -> Value:
        return self._hash(a, F.sha1)

    def f_sha256(self, a: Value) -> Value:
        return self._hash(a, lambda x: F.sha2(x, 256))

    def f_sha384(self, a: Value) -> Value:
        return self._hash(a, lambda x: F.sha2(x, 384))

    def f_sha512(self, a: Value) -> Value:
        return self._hash(a, lambda x: F.sha2(x, 512))

    def f_uuid(self) -> Value:
        return Value(as_term=t.iri(F.concat(F.lit("urn:uuid:"), F.uuid())))

    def f_struuid(self) -> Value:
        return Value(as_text=F.uuid())

    # -- times

    def _field(self, a: Value, types: tuple[str, ...], pattern: str, group: int) -> Column:
        x = a.term()
        found = F.regexp_extract(x["lex"], pattern, group)
        return F.when(t.is_type(x, tuple(XSD + n for n in types)) & (found != ""), found)

    def f_year(self, a: Value) -> Value:
        return integer(self._field(a, ("dateTime", "date"), _DATE, 1).try_cast("int"))

    def f_month(self, a: Value) -> Value:
        return integer(self._field(a, ("dateTime", "date"), _DATE, 2).try_cast("int"))

    def f_day(self, a: Value) -> Value:
        return integer(self._field(a, ("dateTime", "date"), _DATE, 3).try_cast("int"))

    def f_hours(self, a: Value) -> Value:
        return integer(self._field(a, ("dateTime", "time"), _TIME, 1).try_cast("int"))

    def f_minutes(self, a: Value) -> Value:
        return integer(self._field(a, ("dateTime", "time"), _TIME, 2).try_cast("int"))

    def f_seconds(self, a: Value) -> Value:
        d = self._field(a, ("dateTime", "time"), _TIME, 3).try_cast(DEC)
        return Value(rank=F.when(d.isNotNull(), 2), dec=d, dbl=d.cast("double"))

    def f_tz(self, a: Value) -> Value:
        x = a.term()
        timed = t.is_type(x, (XSD + "dateTime", XSD + "date", XSD + "time"))
        return Value(as_text=F.when(timed, F.regexp_extract(x["lex"], r"(Z|[+-]\d\d:\d\d)$", 1)))

    def f_timezone(self, a: Value) -> Value:
        zone = self.f_tz(a).as_text
        h, m = F.regexp_extract(zone, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(zone, r":(\d\d)", 1).try_cast("int")
        text = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
        lex = F.when(zone == "", None).when((zone == "Z") | ((h == 0) & (m == 0)), "PT0S").otherwise(text)
        return Value(as_term=F.when(lex.isNotNull(), t.literal(lex, XSD + "dayTimeDuration")))

    def f_now(self) -> Value:
        return Value(as_term=t.literal(self.context.now, XSD + "dateTime"))


def cast(name: str, a: Value) -> Value:
    x, n = a.term(), a.num()
    kind = name[len(XSD) :]
    plain = t.is_type(x, STRING)
    lex = F.trim(x["lex"])
    truth = F.when(t.is_type(x, XSD + "boolean"), x["lex"].isin("true", "1"))
    numeric = n.rank.isNotNull()
    match kind:
        case "boolean":
            text = F.when(plain & lex.isin("true", "1"), True).when(plain & lex.isin("false", "0"), False)
            return Value(as_bool=F.when(truth.isNotNull(), truth).when(numeric, F.when(n.rank <= 2, n.dec != 0).otherwise((n.dbl != 0) & ~F.isnan(n.dbl))).otherwise(text))
        case "string":
            return Value(as_text=F.when(x["k"].isin(IRI, LITERAL), x["lex"]))
        case "integer" | "int" | "long" | "short" | "byte":
            cut = F.when(n.rank <= 2, F.when(n.dec < 0, F.ceil(n.dec)).otherwise(F.floor(n.dec)).try_cast("decimal(38,0)")).otherwise(F.when(n.dbl < 0, F.ceil(n.dbl)).otherwise(F.floor(n.dbl)).try_cast("decimal(38,0)"))
            d = F.when(truth.isNotNull(), truth.cast("int").cast("decimal(38,0)")).when(numeric, cut).when(plain & lex.rlike(r"^[+-]?\d+$"), lex.try_cast("decimal(38,0)"))
            if kind == "integer":
                return Value(rank=F.when(d.isNotNull(), 1), dec=d.try_cast(DEC), dbl=d.cast("double"))
            return Value(as_term=F.when(d.isNotNull(), t.literal(d.cast("string"), name)))
        case "decimal":
            d = F.when(truth.isNotNull(), truth.cast("int").cast(DEC)).when(n.rank <= 2, n.dec).when(numeric, n.dbl.try_cast(DEC)).when(plain & lex.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), lex.try_cast(DEC))
            return Value(rank=F.when(d.isNotNull(), 2), dec=d, dbl=d.cast("double"))
        case "double" | "float":
            d = F.when(truth.isNotNull(), truth.cast("int").cast("double")).when(numeric, n.dbl).when(plain, lex.try_cast("double"))
            d = d.cast("float").cast("double") if kind == "float" else d
            return Value(rank=F.when(d.isNotNull(), 4 if kind == "double" else 3), dec=F.lit(None).cast(DEC), dbl=d)
        case "dateTime" | "date" | "time":
            day = r"-?\d{4,}-\d\d-\d\d"
            time, zone = r"\d\d:\d\d:\d\d(\.\d+)?", r"(Z|[+-]\d\d:\d\d)?"
            shape = {"dateTime": f"^{day}T{time}{zone}$", "date": f"^{day}{zone}$", "time": f"^{time}{zone}$"}[kind]
            source = x["lex"]
            if kind == "date":
                source = F.when(t.is_type(x, XSD + "dateTime"), F.regexp_replace(source, r"T\d\d:\d\d:\d\d(\.\d+)?", "")).otherwise(source)
            elif kind == "time":
                source = F.when(t.is_type(x, XSD + "dateTime"), F.regexp_replace(source, r"^[^T]*T", "")).otherwise(source)
            elif kind == "dateTime":
                source = F.when(t.is_type(x, XSD + "date"), F.regexp_replace(source, f"^({day})", "$1T00:00:00")).otherwise(source)
            ok = (plain | t.is_type(x, (XSD + "dateTime", XSD + "date", XSD + "time"))) & source.rlike(shape)
            return Value(as_term=F.when(ok, t.literal(source, name)))
    return Value(as_term=t.null_term())

"""Terms as struct columns, and the lanes (number, boolean, time) that expressions work on.

term := struct<k tinyint, lex string, dt string, lang string, dir string>; k is 0 for blank nodes, 1 for IRIs,
2 for literals and 3 for quoted triples, whose lex is their canonical N-Triples text. A null struct is unbound.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.algebra import RDF, STRING, XSD

TERM = T.StructType([T.StructField("k", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("dir", T.StringType())])
QUAD = T.StructType([T.StructField("g", T.StringType()), T.StructField("s", TERM), T.StructField("p", T.StringType()), T.StructField("o", TERM)])
BNODE, IRI, LITERAL, TRIPLE = 0, 1, 2, 3
#: The integer type and those derived from it.
INTEGERS = tuple(XSD + t for t in "integer int long short byte nonNegativeInteger positiveInteger negativeInteger nonPositiveInteger unsignedLong unsignedInt unsignedShort unsignedByte".split())
NUMERIC = (*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double")
DEC = "decimal(38,18)"


def term(k, lex, dt=None, lang=None, direction=None) -> Column:
    def c(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    return F.struct(F.lit(k).cast("tinyint").alias("k") if not isinstance(k, Column) else k.cast("tinyint").alias("k"), c(lex).alias("lex"), c(dt).alias("dt"), c(lang).alias("lang"), c(direction).alias("dir"))


def null_term() -> Column:
    return F.lit(None).cast(TERM)


def iri(lex) -> Column:
    return term(IRI, lex)


def literal(lex, dt=STRING, lang=None, direction=None) -> Column:
    return term(LITERAL, lex, dt, lang, direction)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


def canonical(t: tuple) -> str:
    """N-Triples text of a ground plan term."""
    match t[0]:
        case "iri":
            return f"<{t[1]}>"
        case "var":
            return t[1]
        case "triple":
            return f"<<( {canonical(t[1])} {canonical(t[2])} {canonical(t[3])} )>>"
    _, lex, dt, lang, way = t
    tail = f"@{lang}" + (f"--{way}" if way else "") if lang else ("" if dt == STRING else f"^^<{dt}>")
    return f'"{escape(lex)}"{tail}'


def constant(t: tuple) -> Column:
    """A plan term as a column; a blank node's label is kept."""
    match t[0]:
        case "iri":
            return iri(t[1])
        case "triple":
            return term(TRIPLE, canonical(t))
        case "var":
            return term(BNODE, t[1].removeprefix("_:"))
    return literal(*t[1:])


def text_of(t: Column) -> Column:
    """Canonical N-Triples text of a term column."""
    lex = t["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    tail = F.when(t["lang"].isNotNull(), F.concat(F.lit("@"), t["lang"], F.coalesce(F.concat(F.lit("--"), t["dir"]), F.lit("")))).when(t["dt"] == STRING, "").otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["k"] == IRI, F.concat(F.lit("<"), t["lex"], F.lit(">"))).when(t["k"] == BNODE, F.concat(F.lit("_:"), t["lex"])).when(t["k"] == TRIPLE, t["lex"]).otherwise(F.concat(F.lit('"'), lex, F.lit('"'), tail))


def double_text(d: Column) -> Column:
    """Canonical XSD text of a double: one digit before the point, and an exponent."""
    s = F.abs(d).cast("string")
    whole, frac = F.substring_index(s, ".", 1), F.substring_index(s, ".", -1)
    lead = F.regexp_replace(F.concat(F.substring(whole, 2, 400), frac), "0+$", "")
    tiny = F.regexp_replace(frac, "^0+", "")
    big = F.concat(F.substring(whole, 1, 1), F.lit("."), F.when(lead == "", "0").otherwise(lead), F.lit("E"), (F.length(whole) - 1).cast("string"))
    small = F.concat(F.substring(tiny, 1, 1), F.lit("."), F.when(F.length(tiny) < 2, "0").otherwise(F.substring(tiny, 2, 400)), F.lit("E-"), (F.length(frac) - F.length(tiny) + 1).cast("string"))
    body = F.when(s.contains("E"), s).when(whole != "0", big).otherwise(small)
    return F.when(F.isnan(d), "NaN").when(d == float("inf"), "INF").when(d == float("-inf"), "-INF").when(d == 0, "0.0E0").otherwise(F.concat(F.when(d < 0, "-").otherwise(""), body))


def decimal_text(d: Column) -> Column:
    """Shortest text of a decimal: no trailing zeros, and no point before nothing."""
    return F.regexp_replace(d.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")


def is_type(t: Column, types) -> Column:
    return (t["k"] == LITERAL) & (t["dt"].isin(*types) if not isinstance(types, str) else t["dt"] == types)


def moment(t: Column) -> Column:
    """Timestamp of a dateTime or date; without a zone it is taken as UTC."""
    lex = F.when(t["lex"].rlike(r"(Z|[+-]\d\d:\d\d)$"), t["lex"]).otherwise(F.concat(t["lex"], F.lit("Z")))
    day = F.regexp_replace(lex, r"^(-?\d{4,}-\d\d-\d\d)(Z|[+-]\d\d:\d\d)$", "$1T00:00:00$2")
    return F.when(is_type(t, (XSD + "dateTime", XSD + "date")), day.try_cast("timestamp"))


def sort_key(t: Column) -> list[Column]:
    """Columns that order terms: blank nodes, IRIs, literals, quoted triples; numbers and times by value."""
    number = F.when(is_type(t, NUMERIC), t["lex"].try_cast("double"))
    family = F.when(t["k"] != LITERAL, 0).when(t["dt"].isin(*NUMERIC), 1).when(t["dt"] == XSD + "boolean", 2).when(t["dt"].isin(XSD + "dateTime", XSD + "date"), 3).otherwise(4)
    return [t["k"], family, number, moment(t), t["lex"], t["dt"], t["lang"], t["dir"]]


_TERM_TEXT = re.compile(r'<<\(|\)>>|<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?')


def parse_terms(text: str) -> list[tuple]:
    """Plan terms from N-Triples text; quoted triples nest. Blank nodes come as ("bnode", label)."""
    from ..plans.sparql import unescape

    out: list[list] = [[]]
    for m in _TERM_TEXT.finditer(text):
        x = m[0]
        if x == "<<(":
            out.append([])
        elif x == ")>>":
            inner = out.pop()
            out[-1].append(("triple", *inner))
        elif x[0] == "<":
            out[-1].append(("iri", unescape(x[1:-1])))
        elif x[0] == "_":
            out[-1].append(("bnode", x[2:]))
        else:
            end = x.rindex('"')
            lex, tail = unescape(x[1:end]), x[end + 1 :]
            if tail.startswith("@"):
                lang, _, way = tail[1:].partition("--")
                out[-1].append(("lit", lex, RDF + ("dirLangString" if way else "langString"), lang.lower(), way or None))
            else:
                out[-1].append(("lit", lex, tail[3:-1] if tail else STRING, None, None))
    return out[0]


def as_row(t: tuple | None) -> tuple | None:
    """A plan term as a tuple of the struct's fields."""
    if t is None:
        return None
    match t[0]:
        case "iri":
            return (IRI, t[1], None, None, None)
        case "bnode":
            return (BNODE, t[1], None, None, None)
        case "var":
            return (BNODE, t[1].removeprefix("_:"), None, None, None)
        case "triple":
            return (TRIPLE, text(t), None, None, None)
    return (LITERAL, *t[1:])


def text(t: tuple) -> str:
    if t[0] == "bnode":
        return f"_:{t[1]}"
    if t[0] == "triple":
        return f"<<( {' '.join(text(x) for x in t[1:])} )>>"
    return canonical(t)


def triple_parts(t: Column) -> Column:
    """Struct (s, p, o) of a quoted triple's parts; null for any other term. Decoding nested text needs Python, in Arrow batches."""
    import pandas as pd

    def decoded(texts):
        rows = []
        for x in texts:
            found = parse_terms(x)[0][1:] if x else (None, None, None)
            rows.append([dict(zip(("k", "lex", "dt", "lang", "dir"), as_row(y), strict=True)) if y else None for y in found])
        return pd.DataFrame(rows, columns=list("spo"))

    parts = F.pandas_udf(decoded, T.StructType([T.StructField(n, TERM) for n in "spo"]), F.PandasUDFType.SCALAR)
    quoted = F.when(t["k"] == TRIPLE, t["lex"])
    return F.when(quoted.isNotNull(), parts(quoted))

"""Full-text search over literals as plain column expressions: no index to keep, filters reach the scan.

Query syntax: terms (any must match, as an OR), AND, OR, NOT, +must, -must not, "phrases", prefix*, parentheses.
Tokens are runs of letters and digits, lower-cased.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t

_TOKEN = re.compile(r'"[^"]*"|\(|\)|[^\s()"]+')


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _phrase(text: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(False)
    flat = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return flat.contains(f" {' '.join(words)} ")


def _words(s: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", s.lower()) if w]


class _Query:
    def __init__(self, text: Column, query: str):
        self.text, self.items, self.i = text, _TOKEN.findall(query), 0

    def peek(self) -> str:
        return self.items[self.i] if self.i < len(self.items) else ""

    def either(self) -> Column:
        must: list[Column] = []
        may: list[Column] = []
        last = None
        while self.peek() and self.peek() != ")":
            if self.peek() == "OR":
                self.i += 1
                continue
            if self.peek() == "AND":
                self.i += 1
                c = self.one()[1]
                if last is may and may:
                    may[-1] = may[-1] & c
                else:
                    must.append(c)
                continue
            kind, c = self.one()
            last = must if kind else may
            last.append(c)
        some = None
        for c in may:
            some = c if some is None else some | c
        out = None
        for c in must:
            out = c if out is None else out & c
        if out is None:
            return some if some is not None else F.lit(False)
        return out

    def one(self) -> tuple[bool, Column]:
        """(must match or not, condition)"""
        x = self.peek()
        self.i += 1
        if x == "NOT":
            return True, ~self.one()[1]
        if x in ("+", "-"):
            c = self.one()[1]
            return True, c if x == "+" else ~c
        if x == "(":
            c = self.either()
            self.i += 1
            return False, c
        if x.startswith('"'):
            return False, _phrase(self.text, _words(x))
        if x[0] in "+-" and len(x) > 1:
            self.items.insert(self.i, x[1:])
            c = self.one()[1]
            return True, c if x[0] == "+" else ~c
        if x.endswith("*") and len(x) > 1:
            head = "".join(_words(x[:-1]))
            return False, F.exists(tokens(self.text), lambda w: w.startswith(head))
        words = _words(x)
        return False, _phrase(self.text, words)


def condition(text: Column, query: str) -> Column:
    return _Query(text, query).either()


def matches(term: Column, query: str, phrase: bool = False) -> Column:
    text = F.when(term["k"] == t.LITERAL, term["lex"])
    return _phrase(text, _words(query)) if phrase else condition(text, query)


#: Fixed values of the BM25 ranking.
K1, B = 1.2, 0.75


def wanted(query: str) -> list[str]:
    """The words of a query that a match is ranked by: all but those after NOT or -, and the connectives."""
    out, skip = [], False
    for item in _TOKEN.findall(query):
        if item == "NOT" or item == "-":
            skip = True
        elif item not in ("AND", "OR", "+", "(", ")"):
            if not skip and not item.startswith("-"):
                out += [w for w in _words(item) if not item.endswith("*")]
            skip = False
    return list(dict.fromkeys(out))


def _is(word: str):
    return lambda x: x == F.lit(word)


def search(quads: DataFrame, query: str, predicate: str | None = None, limit: int | None = None) -> DataFrame:
    """Quads whose literal object matches, with their BM25 score over the literals searched, best first.

    Word counts and document frequencies are one aggregate over the literals; ties are ordered by subject.
    """
    rows = quads if predicate is None else quads.where(F.col("p") == predicate)
    rows = rows.where(F.col("o")["k"] == t.LITERAL)
    words = wanted(query)
    rows = rows.withColumn("_w", tokens(F.col("o")["lex"]))
    rows = rows.withColumns({"_n": F.size("_w"), **{f"_f{i}": F.size(F.filter("_w", _is(w))) for i, w in enumerate(words)}}).drop("_w")
    total = rows.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *(F.sum((F.col(f"_f{i}") > 0).cast("int")).alias(f"_d{i}") for i in range(len(words)))).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        held = total[f"_d{i}"] or 0
        rare = math.log(1 + (total["_docs"] - held + 0.5) / (held + 0.5))
        f = F.col(f"_f{i}")
        score = score + rare * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / max(total["_mean"] or 0.0, 1e-9)))
    found = rows.where(matches(F.col("o"), query)).withColumn("score", score).select("g", "s", "p", "o", "score")
    found = found.orderBy(F.desc("score"), F.col("s")["lex"])
    return found if limit is None else found.limit(limit)

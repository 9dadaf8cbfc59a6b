"""The SPARQL engine on small graphs; T-numbers name cases where standard semantics were chosen on purpose."""

import pytest

from quadrille.plans.compiler import Options
from quadrille.plans.engine import TooManyResults, run
from quadrille.plans.sparql import SparqlError, parse_query, parse_update
from quadrille.sources import turtle
from quadrille.sources.dataset import Dataset

P = "PREFIX : <http://ex/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
DATA = """@prefix : <http://ex/> .
:alice :name "Alice" ; :age 30 ; :knows :bob .
:bob :name "Bob" ; :age 25 ; :knows :carol .
:carol :name "Carol"@en ; :knows :alice .
:g1 { :x :name "Named" . }
"""


@pytest.fixture(scope="module")
def people(spark):
    return Dataset(turtle.frame(spark, turtle.parse(DATA)).cache())


def rows(ds, text, **kw):
    return sorted((tuple(r) for r in run(ds, P + text, **kw).decode().collect()), key=repr)


CASES = [
    ("SELECT ?n { ?x :name ?n ; :age ?a FILTER(?a > 26) }", [("Alice",)]),
    ("SELECT ?n ?a { ?x :name ?n OPTIONAL { ?x :age ?a FILTER(?a > 26) } }", [("Alice", "30"), ("Bob", None), ("Carol", None)]),
    ("SELECT ?n { { ?x :name ?n . ?x :age 30 } UNION { ?x :name ?n . ?x :age 25 } }", [("Alice",), ("Bob",)]),
    ("SELECT ?x { ?x :name ?n MINUS { ?x :age 30 } }", [("http://ex/bob",), ("http://ex/carol",)]),
    ("SELECT ?n { ?x :name ?n MINUS { ?y :age ?b } }", [("Alice",), ("Bob",), ("Carol",)]),
    ("SELECT ?x { ?x :name ?n FILTER NOT EXISTS { ?x :age ?a } }", [("http://ex/carol",)]),
    ("SELECT ?x { ?x :age ?a FILTER EXISTS { ?y :age ?b FILTER(?b > ?a) } }", [("http://ex/bob",)]),  # T3
    ("SELECT ?x ?a { VALUES (?x ?a) { (:alice UNDEF) (UNDEF 25) } ?x :age ?a }", [("http://ex/alice", "30"), ("http://ex/bob", "25")]),
    ("SELECT ?g ?n { GRAPH ?g { ?x :name ?n } }", [("http://ex/g1", "Named")]),
    ("SELECT ?n FROM :g1 { ?x :name ?n }", [("Named",)]),
    ("SELECT ?g FROM NAMED :g2 { GRAPH ?g { ?x :name ?n } }", []),  # T18
    ("SELECT (COUNT(*) AS ?c) (SUM(?a) AS ?s) (AVG(?a) AS ?m) (MIN(?a) AS ?l) { ?x :age ?a }", [("2", "55", "27.5", "25")]),
    ("SELECT (SUM(?a) AS ?s) (AVG(?a) AS ?m) { ?x :no ?a }", [("0", "0")]),
    ("SELECT (GROUP_CONCAT(DISTINCT ?n; SEPARATOR=',') AS ?g) { ?x :age ?a ; :name ?n }", [("Alice,Bob",)]),
    ("SELECT ?b { :alice :knows/:knows ?b }", [("http://ex/carol",)]),
    ("SELECT ?b { :alice ^:knows ?b }", [("http://ex/carol",)]),
    ("SELECT ?b { ?b :knows+ :alice }", [("http://ex/alice",), ("http://ex/bob",), ("http://ex/carol",)]),  # T6, T7
    ("SELECT ?b { :nobody :knows* ?b }", [("http://ex/nobody",)]),
    ("SELECT ?o { :alice !(:name|:age) ?o }", [("http://ex/bob",)]),
    ("SELECT (CONCAT(STRBEFORE('abc', 'c'), UCASE('x'), STR(1.5 + 2)) AS ?r) {}", [("abX3.5",)]),
    ("SELECT (10 / 4 AS ?q) (1 / 0 AS ?z) (ROUND(2.5) AS ?r) {}", [("2.5", None, "3")]),
    ("SELECT (SUBSTR('hello', 0, 3) AS ?a) (LANGMATCHES('eng', 'en') AS ?b) {}", [("he", "false")]),  # T9, T10
    ("SELECT (YEAR('2020-05-06T10:11:12.5-08:00'^^xsd:dateTime) AS ?y) (TIMEZONE('2020-05-06T10:11:12.5-08:00'^^xsd:dateTime) AS ?z) {}", [("2020", "-PT8H")]),
    ("SELECT (xsd:integer('12') + 1 AS ?i) (xsd:integer('x') AS ?e) (xsd:double(2) AS ?d) {}", [("13", None, "2.0E0")]),
    ("SELECT (ENCODE_FOR_URI('a b~*') AS ?e) (MD5('a') AS ?m) {}", [("a%20b~%2A", "0cc175b9c0f1b6a831c399e269772661")]),
    ("SELECT ?s ?o { BIND(<<( :a :b 'c' )>> AS ?t) BIND(SUBJECT(?t) AS ?s) BIND(OBJECT(?t) AS ?o) }", [("http://ex/a", "c")]),
    ("SELECT ?x ?y { ?x :age ?a LATERAL { SELECT ?y { ?x :knows ?y } LIMIT 1 } }", [("http://ex/alice", "http://ex/bob"), ("http://ex/bob", "http://ex/carol")]),  # T4
    ("SELECT ?x { ?x :name ?n FILTER(?n = 'Bob' || ?n = 'Carol'@en) }", [("http://ex/bob",), ("http://ex/carol",)]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_select(people, text, expected):
    assert rows(people, text) == expected


def test_order_puts_unbound_first(people):  # T1
    got = [tuple(r) for r in run(people, P + "SELECT ?n ?a { ?x :name ?n OPTIONAL { ?x :age ?a } } ORDER BY ?a").decode().collect()]
    assert got == [("Carol", None), ("Bob", "25"), ("Alice", "30")]


def test_ask_construct_describe(people):
    assert run(people, P + "ASK { :alice :age 30 }").boolean() is True
    assert rows(people, "CONSTRUCT { ?x :called ?n } WHERE { ?x :name ?n ; :age 30 }") == [("http://ex/alice", "http://ex/called", "Alice")]
    assert len(rows(people, "DESCRIBE :alice")) == 3


def test_union_default_graph_and_limits(people):
    assert len(rows(people, "SELECT ?n { ?x :name ?n }", options=Options(union_default_graph=True))) == 4
    with pytest.raises(TooManyResults):  # T2
        run(people, P + "SELECT ?n { ?x :name ?n }", Options(max_results=2))


def test_service(people, spark):
    from quadrille.functions import terms as t

    def handler(name, node):
        if name.endswith("down"):
            raise RuntimeError("down")
        return spark.createDataFrame([(t.as_row(("iri", "http://ex/alice")),)], t.T.StructType([t.T.StructField("x", t.TERM)]))

    options = Options(service=handler)
    assert rows(people, "SELECT ?n { ?x :name ?n SERVICE :up { ?x :p ?q } }", options=options) == [("Alice",)]
    assert len(rows(people, "SELECT ?n { ?x :name ?n SERVICE SILENT :down { ?x :p ?q } }", options=options)) == 3  # T20
    with pytest.raises(RuntimeError):
        rows(people, "SELECT ?n { ?x :name ?n SERVICE :down { ?x :p ?q } }", options=options)


def test_syntax_errors():
    for bad in ("SELECT", "SELECT ?x { ?x ?y }", "SELECT ?x WHERE { ?x <p> <o> ", "SELECT ?x { BIND(1 AS ?x) BIND(2 AS ?x) }", "ASK { FILTER(COUNT(*) > 1) }", "SELECT ?a ?b { ?a <p> ?b } GROUP BY ?a"):
        with pytest.raises(SparqlError):
            parse_query(bad)
    with pytest.raises(SparqlError):
        parse_update("INSERT DATA { ?x <p> <o> }")

"""Correlation, join orders and scans."""

import pytest

from quadrille import queries
from quadrille.plans.compiler import PatternCompiler
from quadrille.plans.sparql import parse_query
from quadrille.sources.dataset import table_dataset
from quadrille.store import Store

SF = "/root/testdata/sf0.001"
DATA = """PREFIX : <urn:> INSERT DATA { :a :item 1, 2 . :b :item 3 . :a :tag 'x' . :c :tag 'y' . :a :v 1 . :b :v 2 . :c :v 3 .
  :a :lim 1 . :b :lim 5 . :a :nb :b . :b :nb :c . GRAPH :g { :a :tag 'in g' } }"""


@pytest.fixture(scope="module")
def store(spark):
    s = Store(spark)
    s.update(DATA)
    return s


def rows(store, text):
    found = store.query("PREFIX : <urn:> " + text).decode().collect()
    return sorted((tuple(x.replace("urn:", "") if isinstance(x, str) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize("text, expected", [
    ("SELECT ?x ?k { VALUES ?x { :a :b :z } LATERAL { SELECT (COUNT(?i) AS ?k) { ?x :item ?i } } }", [("a", "2"), ("b", "1"), ("z", "0")]),
    ("SELECT ?x ?t { VALUES ?x { :a :b } LATERAL { SELECT DISTINCT ?t { ?x :item ?i BIND('s' AS ?t) } } }", [("a", "s"), ("b", "s")]),
    ("SELECT ?x ?y { VALUES ?x { :a :b } LATERAL { BIND(?x AS ?y) } }", [("a", "a"), ("b", "b")]),
    ("SELECT ?x ?i { VALUES ?x { :a :b } LATERAL { SELECT ?i { ?x :item ?i } ORDER BY DESC(?i) LIMIT 1 } }", [("a", "2"), ("b", "3")]),
    ("SELECT ?x ?i { VALUES ?x { :a :b } LATERAL { SELECT ?i { ?x :item ?i } ORDER BY ?i OFFSET 1 } }", [("a", "2")]),
    ("SELECT ?x ?t { VALUES ?x { :a :b } LATERAL { { ?x :tag ?t } UNION { ?x :nb ?y LATERAL { SELECT (MAX(?i) AS ?t) { ?y :item ?i } } } } }", [("a", "3"), ("a", "x"), ("b", None)]),
    ("SELECT ?x ?t { VALUES ?x { :a :b } LATERAL { GRAPH ?g { ?x :tag ?t } } }", [("a", "in g")]),
    ("SELECT ?x { ?x :v ?n FILTER EXISTS { { ?x :tag ?t FILTER(?n = 1) } UNION { ?x :lim ?l FILTER(?l > ?n + 2) } } }", [("a",), ("b",)]),
    ("SELECT ?x { ?x :v ?n FILTER NOT EXISTS { ?x :nb ?y FILTER NOT EXISTS { ?y :v ?m FILTER(?m > ?n + 5) } } }", [("c",)]),
    ("SELECT ?x { ?x :v ?n FILTER EXISTS { ?x :nb ?y BIND(?n + 1 AS ?m) ?y :v ?m } }", [("a",), ("b",)]),
    ("SELECT ?x ?t { ?x :v ?n OPTIONAL { ?x :tag ?t FILTER EXISTS { ?x :item ?n } } FILTER(BOUND(?t)) }", [("a", "x")]),
    ("SELECT ?x ?i ?t { ?x :v ?n OPTIONAL { ?x :item ?i } OPTIONAL { ?y :tag ?t ; :item ?i } FILTER(?x = :c) }", [("c", "1", "x"), ("c", "2", "x")]),
    ("SELECT ?x ?e { ?x :v ?n BIND(EXISTS { ?x :item ?i } && EXISTS { ?x :tag ?t } AS ?e) }", [("a", "true"), ("b", "false"), ("c", "false")]),
    ("SELECT ?x { ?x :v ?n MINUS { ?y :lim ?l OPTIONAL { ?x :tag ?t } } }", [("b",)]),
])
def test_correlation(store, text, expected):
    assert rows(store, text) == expected


def test_optional_keeps_unmatched(store):
    found = rows(store, "SELECT ?x (COALESCE(?t, 'none') AS ?u) { ?x :v ?n OPTIONAL { ?x :tag ?t FILTER(?n > 1) } }")
    assert found == [("a", "none"), ("b", "none"), ("c", "y")]


def test_construct_blank_nodes_are_new_for_each_solution(store):
    found = store.query("PREFIX : <urn:> CONSTRUCT { _:n :of :thing } { VALUES ?z { 1 1 } }").df.collect()
    assert len(found) == 2


def test_substitutions_and_dataset_arguments(store):
    q = "PREFIX : <urn:> SELECT ?x ?i { ?x :item ?i FILTER(?i != ?not) }"
    three = ("lit", "1", "http://www.w3.org/2001/XMLSchema#integer", None, None)
    assert [tuple(r) for r in store.query(q, substitutions={"x": ("iri", "urn:a"), "not": three}).decode().collect()] == [("urn:a", "2")]
    tags = store.query("PREFIX : <urn:> SELECT ?t { :a :tag ?t }", default_graphs=["urn:g"]).decode().collect()
    assert [tuple(r) for r in tags] == [("in g",)]


def test_result_names_hide_variables(spark):
    s = Store(spark)
    s.cypher_update("CREATE (a:P {name: 'Ann', age: 40})-[:KNOWS]->(b:P {name: 'Ben', age: 20})")
    assert [tuple(r) for r in s.cypher("MATCH (n:P) RETURN n.name AS n, n.age AS age ORDER BY n DESC").decode().collect()] == [("Ben", "20"), ("Ann", "40")]


def test_join_order(spark):
    """The small tables' many-to-many join on nations comes last, after the keys that lead there."""
    text = "SELECT * { ?s :s_nationkey ?k . ?c :c_nationkey ?k . ?o :o_custkey ?c . ?l :l_orderkey ?o ; :l_suppkey ?s }"
    bgp = parse_query(text, None, queries.PREFIXES).pattern
    while not hasattr(bgp, "triples"):
        bgp = bgp.child
    order = [tr[1][1].rsplit("/", 1)[-1] for tr in PatternCompiler(table_dataset(spark, "/root/testdata/sf0.1")).ordered(list(bgp.triples))]
    done: set[str] = set()
    for p in order:
        assert not {"s_nationkey", "c_nationkey"} <= done | {p} or {"l_suppkey", "l_orderkey", "o_custkey"} <= done | {p}, order
        done.add(p)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_bound_subject_reads_one_table(spark):
    text = plan(queries.QUERIES["scan_bound_subject"](spark, SF))
    assert "nation.parquet" in text and "lineitem.parquet" not in text and "PushedFilters: [IsNotNull(n_nationkey), EqualTo(n_nationkey,3)]" in text


def test_star_is_one_scan(spark):
    text = plan(queries.QUERIES["bgp_star3"](spark, SF)).split("== Physical Plan ==")[1]
    assert "Join" not in text and text.count("FileScan") == 1


def test_bound_path_end_reads_no_other_table(spark):
    text = plan(queries.QUERIES["path_opt_bound"](spark, SF)).split("== Physical Plan ==")[1]
    assert "lineitem.parquet" not in text and "nation.parquet" in text

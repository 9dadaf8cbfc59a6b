"""What queries read and join: their work grows no faster than their input."""

import pytest

from quadrille import queries
from quadrille.store import Store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(store, text):
    found = store.query("PREFIX : <urn:> " + text).decode().collect()
    return sorted((tuple(x.replace("urn:", "") if isinstance(x, str) else x for x in r) for r in found), key=repr)


@pytest.fixture(scope="module")
def store(spark):
    s = Store(spark)
    s.update("PREFIX : <urn:> INSERT DATA { :a :p :b . :b :p :c . :a :tag 1 . :b :tag 2 . :c :q :a . :x :q :c }")
    return s


def test_negated_set_reads_only_tables_of_its_subjects(spark):
    text = plan(queries.QUERIES["path_neg_set"](spark, SF))
    assert "nation.parquet" in text and "lineitem.parquet" not in text


def test_negated_set_beside_patterns(store):
    assert rows(store, "SELECT ?a ?b { ?a :tag ?t . ?a !(:tag) ?b }") == [("a", "b"), ("b", "c")]
    assert rows(store, "SELECT ?a ?b { ?a :tag ?t . ?a !(^:p) ?b }") == [("a", "c")]
    assert rows(store, "SELECT ?a ?b { ?x :q ?a . ?a !(:tag) ?b }") == [("a", "b"), ("c", "a")]


@pytest.mark.parametrize("name, own", [("path_star", "conversations"), ("path_opt", "nation")])
def test_zero_length_steps_read_only_what_is_joined(spark, name, own):
    text = plan(queries.QUERIES[name](spark, SF))
    assert f"{own}.parquet" in text and "lineitem.parquet" not in text


def test_zero_length_steps_beside_patterns(store):
    assert rows(store, "SELECT ?a ?b { ?a :tag ?t ; :p? ?b }") == [("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")]
    assert rows(store, "SELECT ?a ?b { ?x :q ?b . ?a :p* ?b }") == [("a", "a"), ("a", "c"), ("b", "c"), ("c", "c")]
    # A name that a sub-query keeps to itself says nothing of the path's end.
    assert rows(store, "SELECT ?a ?b { ?a :q? ?b { SELECT ?t { ?a :tag ?t } } FILTER(?t = 1 && ?a = :x) }") == [("x", "c"), ("x", "x")]
    # VALUES make no node: a path of no steps holds on nodes of the graph only.
    assert rows(store, "SELECT ?a { VALUES ?a { :a :nowhere } ?a :p* ?a }") == [("a",)]


def test_describe_looks_up_what_is_named(spark, monkeypatch):
    from quadrille.sources.dataset import TableDataset

    read, scan = [], TableDataset.scan
    monkeypatch.setattr(TableDataset, "scan", lambda self, p=None, subject=None, like=None: read.append(subject) or scan(self, p, subject, like))
    assert queries.QUERIES["describe"](spark, SF).count() == 3
    assert read == ["urn:t/region/1"]


def test_describe_named_and_found(spark):
    s = Store(spark)
    s.update("PREFIX : <urn:> INSERT DATA { :a :p _:x . _:x :p _:y . _:y :q 1 . :b :p :a . :c :p 3 . _:z :p 4 }")
    found = lambda text: sorted(x[2] for x in s.query("PREFIX : <urn:> DESCRIBE " + text).decode().collect() if x[2].isdigit() or x[2] == "urn:a")
    assert found(":a") == ["1"]
    assert found(":a :c :a :none") == ["1", "3"]
    assert found(":a ?x { ?x :p :a }") == ["1", "urn:a"]
    assert found(":none") == []


def test_comparing_exists_joins_extremes_only(spark):
    """All suppliers beside all customers, or those of a nation, need not meet."""
    for name, least in (("exists_correlated", 1), ("exists_nested", 1)):
        assert plan(queries.QUERIES[name](spark, SF)).split("== Physical Plan ==")[1].count("max_by") >= least


MIXED = """PREFIX : <urn:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> INSERT DATA {
  :a :l 1, 2.5, 1e1, 'NaN'^^xsd:double, 'x'^^xsd:integer, 'b', 'b'@en, true, :a, '2020-01-02'^^xsd:date, '2020-01-01T10:00:00Z'^^xsd:dateTime, 'bad'^^xsd:dateTime .
  :b :l 'INF'^^xsd:float, 0.00000000000000000001, 'a'^^:t, '2021-01-01T00:00:00+14:00'^^xsd:dateTime . :c :l -1, '1'^^:t .
  :d :r 2, 1.5, 1e0, 'NaN'^^xsd:double, 'c', 'a'@en, false, :z, '2020-01-03'^^xsd:date, '2020-01-01T12:00:00Z'^^xsd:dateTime, '3bad'^^xsd:dateTime ; :of :a .
  :e :r 0.0, 'b'^^:t, '2020-12-31T11:00:00Z'^^xsd:dateTime, '2020-12-31T23:00:00-05:00'^^xsd:dateTime ; :of :b . :f :r -2, 'zz' ; :of :c, :a }"""


@pytest.mark.parametrize("condition", ["?r > ?l", "?l >= ?r", "?l * 2 >= ?r - 0.5 && isNUMERIC(?r)", "STR(?r) < STR(?l)"])
def test_comparing_exists_equals_all_pairs(spark, monkeypatch, condition):
    from quadrille.plans.compiler import PatternCompiler

    s = Store(spark)
    s.update(MIXED)
    texts = [f"SELECT ?x ?l {{ ?x :l ?l FILTER {word} {{ ?y :r ?r {of} FILTER({condition}) }} }}" for word in ("NOT EXISTS",) for of in ("", "; :of ?x")]
    few = [rows(s, x) for x in texts]
    monkeypatch.setattr(PatternCompiler, "extremes", lambda *_: None)
    assert few == [rows(s, x) for x in texts]


def test_many_quads_are_dealt_out_before_they_are_distinct(spark):
    from quadrille.sources.dataset import DISTINCT_ROWS, distinct, table_dataset

    data = table_dataset(spark, SF, ["nation", "region"])
    assert data.most == 25 * 5 + 5 * 3
    twice = data.quads.union(data.quads)
    dealt = distinct(twice, 3 * DISTINCT_ROWS)
    before = plan(dealt).split("== Physical Plan ==")[1]
    # One shuffle into as many tasks as the rows ask for; no rows are held in a task before it.
    assert before.count("Exchange") == 1 and "REPARTITION_BY_NUM" in before and before.index("REPARTITION_BY_NUM") > before.rindex("Aggregate")
    assert dealt.count() == distinct(twice, None).count() == 25 * 5 + 5 * 3

"""Queries over a store of the tables' quads: updates, Cypher, reasoning, shapes, text and services, with their SQL.

Each store holds the whole tables that its query names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.shacl import SH
from .plans.compiler import Options
from .plans.cypher import Names
from .sources import turtle
from .sources.dataset import BASE, table_dataset
from .store import Store

PREFIX = f"PREFIX : <{BASE}> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX owl: <http://www.w3.org/2002/07/owl#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
NAMES = Names(label=BASE, prop=BASE, rel=BASE, node=BASE)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _store(spark: SparkSession, sf_dir: str, tables: str, **options) -> Store:
    s = Store(spark, names=NAMES, **options)
    s.dataset = table_dataset(spark, sf_dir, tables.split())
    return s


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    make.__name__ = name
    QUERIES[name], ORACLES[name] = make, sql


def updated(name: str, tables: str, update: str, query: str, sql: str, reasoning: bool = False, **types: str) -> None:
    """The rows of a query after an update, with or without inferences."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _store(spark, sf_dir, tables, reasoning=reasoning)
        s.update(PREFIX + update)
        return s.query(PREFIX + query).decode(types)

    _add(name, make, sql)


def cypher(name: str, tables: str, query: str, sql: str, update: str | None = None, **types: str) -> None:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _store(spark, sf_dir, tables)
        if update:
            s.cypher_update(update)
        return s.cypher(query).decode(types)

    _add(name, make, sql)


def shaped(name: str, tables: str, shape: str, sql: str, update: str | None = None) -> None:
    """The focus nodes and values that a shape reports."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _store(spark, sf_dir, tables)
        if update:
            s.update(PREFIX + update)
        text = f"@prefix : <{BASE}> . @prefix sh: <{SH}> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . :Shape a sh:NodeShape ; {shape} ."
        found = s.validate(turtle.frame(spark, turtle.parse(text)))
        return found.select("focus_node", "path", F.regexp_extract("source_constraint_component", "#(.*)ConstraintComponent", 1).alias("component"), "value")

    _add(name, make, sql)


I, D = "bigint", "double"

# -- updates

updated(
    "update_insert", "customer", "INSERT { ?c :tier 'high' } WHERE { ?c :c_acctbal ?b FILTER(?b > 5000) }", "SELECT ?c { ?c :tier 'high' }",
    "SELECT 'urn:t/customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 5000",
)
updated(
    "update_delete_insert", "part", "DELETE { ?p :p_size ?z } INSERT { ?p :p_size ?y } WHERE { ?p :p_size ?z BIND(?z + 1 AS ?y) }", "SELECT ?p ?z { ?p :p_size ?z }",
    "SELECT 'urn:t/part/' || p_partkey AS p, p_size::BIGINT + 1 AS z FROM part", z=I,
)
updated(
    "update_delete_where", "supplier", "DELETE WHERE { ?s :s_nationkey <urn:t/nation/3> }", "SELECT ?s ?n { ?s :s_nationkey ?n }",
    "SELECT 'urn:t/supplier/' || s_suppkey AS s, 'urn:t/nation/' || s_nationkey AS n FROM supplier WHERE s_nationkey <> 3",
)
updated(
    "update_data", "nation", "INSERT DATA { <urn:t/nation/1> :note 'seen' . GRAPH <urn:g/n> { <urn:t/nation/1> :note 'apart' } } ; DELETE DATA { <urn:t/nation/2> :n_name 'NATION_2' }",
    "SELECT ?n ?o { { ?n :n_name ?o } UNION { ?n :note ?o } }",
    "SELECT 'urn:t/nation/' || n_nationkey AS n, n_name AS o FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT 'urn:t/nation/1', 'seen'",
)
updated(
    "update_clear", "events", "CLEAR GRAPH <urn:g/click>", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?e :value ?v } } GROUP BY ?g",
    "SELECT 'urn:g/' || event_type AS g, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1", n=I,
)
updated(
    "update_copy", "events", "COPY <urn:g/click> TO <urn:g/view>", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?e :value ?v } } GROUP BY ?g",
    "SELECT 'urn:g/' || g AS g, count(*) AS n FROM (SELECT event_type AS g FROM events WHERE event_type <> 'view' UNION ALL SELECT 'view' FROM events WHERE event_type = 'click') GROUP BY 1", n=I,
)
updated(
    "update_move", "events", "MOVE <urn:g/click> TO DEFAULT", "SELECT ?t (COUNT(*) AS ?n) { ?e :event_type ?t } GROUP BY ?t",
    "SELECT event_type AS t, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1", n=I,
)
updated(
    "update_add_graph", "events", "ADD <urn:g/click> TO <urn:g/view> ; DROP GRAPH <urn:g/click>", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?e :value ?v } } GROUP BY ?g",
    "SELECT 'urn:g/' || CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS g, count(*) AS n FROM events GROUP BY 1", n=I,
)
updated(
    "update_using", "events customer", "INSERT { ?e :copied ?v } USING <urn:g/purchase> WHERE { ?e :value ?v FILTER(?v > 10) }", "SELECT ?e ?v { ?e :copied ?v }",
    "SELECT 'urn:t/event/' || event_id AS e, value AS v FROM events WHERE event_type = 'purchase' AND value > 10", v=D,
)
updated(
    "bgp_repeated_var", "nation", "INSERT { ?n :twin ?n . ?n :twin ?r } WHERE { ?n :n_regionkey ?r }", "SELECT ?x { ?x ?p ?x }",
    "SELECT 'urn:t/nation/' || n_nationkey AS x FROM nation",
)

# -- Cypher

cypher(
    "cypher_match", "orders customer", "MATCH (o:Orders)-[:o_custkey]->(c:Customer) WHERE c.c_acctbal > 5000 RETURN o.o_totalprice AS p, c.c_name AS n",
    "SELECT o_totalprice AS p, c_name AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000", p=D,
)
cypher(
    "cypher_varlen", "conversations", "MATCH (a)-[:next*]->(b) RETURN a, b",
    "SELECT 'urn:t/turn/' || x.conv_id || '/' || x.turn AS a, 'urn:t/turn/' || y.conv_id || '/' || y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn > x.turn",
)
cypher(
    "cypher_order", "customer", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS m ORDER BY m DESC SKIP 1 LIMIT 3",
    "SELECT m FROM (SELECT DISTINCT c_mktsegment AS m FROM customer) ORDER BY m DESC LIMIT 3 OFFSET 1",
)
cypher(
    "cypher_left", "nation customer", "MATCH (n:Nation)<-[:c_nationkey]-(c:Customer {c_mktsegment: 'BUILDING'}) RETURN n.n_name AS n, c.c_acctbal + 1 AS b",
    "SELECT n_name AS n, c_acctbal + 1 AS b FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'", b=D,
)
cypher(
    "cypher_write", "part", "MATCH (p:Part) RETURN p, p.p_size AS z", "SELECT 'urn:t/part/' || p_partkey AS p, CASE WHEN p_size < 10 THEN 10 ELSE p_size END::BIGINT AS z FROM part",
    update="MATCH (p:Part) WHERE p.p_size < 10 SET p.p_size = 10", z=I,
)
cypher(
    "cypher_delete", "supplier", "MATCH (s:Supplier) RETURN s.s_name AS n", "SELECT s_name AS n FROM supplier WHERE s_acctbal >= 0",
    update="MATCH (s:Supplier) WHERE s.s_acctbal < 0 DETACH DELETE s",
)

# -- reasoning

updated(
    "rl_subclass", "nation region customer", "INSERT { ?c a ?n } WHERE { ?c :c_nationkey ?n }", "SELECT ?c ?r { ?r :r_name ?name . ?c a ?r }",
    "SELECT 'urn:t/customer/' || c_custkey AS c, 'urn:t/region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey", reasoning=True,
)
updated(
    "rl_domain_range", "supplier", "INSERT DATA { :s_nationkey rdfs:domain :Seller ; rdfs:range :Land }", "SELECT ?x ?k { VALUES ?k { :Seller :Land } ?x a ?k }",
    "SELECT 'urn:t/supplier/' || s_suppkey AS x, 'urn:t/Seller' AS k FROM supplier UNION ALL SELECT DISTINCT 'urn:t/nation/' || s_nationkey, 'urn:t/Land' FROM supplier", reasoning=True,
)
updated(
    "rl_transitive_prop", "conversations", "INSERT DATA { :next a owl:TransitiveProperty }", "SELECT ?a ?b { ?a :next ?b }",
    "SELECT 'urn:t/turn/' || x.conv_id || '/' || x.turn AS a, 'urn:t/turn/' || y.conv_id || '/' || y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn > x.turn", reasoning=True,
)
updated(
    "rl_symmetric", "nation", "INSERT DATA { :n_regionkey a owl:SymmetricProperty }", "SELECT ?a ?b { ?a :n_regionkey ?b }",
    "SELECT 'urn:t/nation/' || n_nationkey AS a, 'urn:t/region/' || n_regionkey AS b FROM nation UNION ALL SELECT 'urn:t/region/' || n_regionkey, 'urn:t/nation/' || n_nationkey FROM nation", reasoning=True,
)
updated(
    "rl_inverse", "supplier", "INSERT DATA { :s_nationkey owl:inverseOf :sells }", "SELECT ?n ?s { ?n :sells ?s }",
    "SELECT 'urn:t/nation/' || s_nationkey AS n, 'urn:t/supplier/' || s_suppkey AS s FROM supplier", reasoning=True,
)
updated(
    "rl_equivalent", "nation", "INSERT DATA { :n_name owl:equivalentProperty :label . :Nation owl:equivalentClass :Country }", "SELECT ?x ?l { ?x a :Country ; :label ?l }",
    "SELECT 'urn:t/nation/' || n_nationkey AS x, n_name AS l FROM nation", reasoning=True,
)
updated(
    "rl_subproperty", "supplier region", "INSERT DATA { :s_name rdfs:subPropertyOf :name . :r_name rdfs:subPropertyOf :name }", "SELECT ?x ?n { ?x :name ?n }",
    "SELECT 'urn:t/supplier/' || s_suppkey AS x, s_name AS n FROM supplier UNION ALL SELECT 'urn:t/region/' || r_regionkey, r_name FROM region", reasoning=True,
)
updated(
    "rl_sameas", "nation", "INSERT DATA { <urn:t/region/0> owl:sameAs <urn:x/south> . <urn:y/far> owl:sameAs <urn:x/south> }", "SELECT ?n ?r { ?n :n_regionkey ?r }",
    "SELECT 'urn:t/nation/' || n_nationkey AS n, r FROM (SELECT n_nationkey, unnest(CASE n_regionkey WHEN 0 THEN ['urn:t/region/0', 'urn:x/south', 'urn:y/far'] ELSE ['urn:t/region/' || n_regionkey] END) AS r FROM nation)", reasoning=True,
)


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir, "customer nation")
    s.update(PREFIX + "INSERT DATA { :Customer owl:disjointWith :Debtor . :twin a owl:IrreflexiveProperty . :c_nationkey a owl:AsymmetricProperty }")
    s.update(PREFIX + "INSERT { ?c a :Debtor } WHERE { ?c :c_acctbal ?b FILTER(?b < 0) } ; INSERT { ?n :twin ?n . ?n :c_nationkey ?c } WHERE { ?c :c_nationkey ?n ; :c_acctbal ?b FILTER(?b > 9900) }")
    return s.diagnostics().groupBy("rule", "severity").agg(F.count("*").alias("n"))


_add("rl_violations", _violations, "SELECT 'cax-dw' AS rule, 'Violation' AS severity, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'prp-irp', 'Violation', count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 'prp-asyp', 'Violation', count(*) FROM customer WHERE c_acctbal > 9900")

# -- shapes

shaped(
    "shacl_min_count", "customer", "sh:targetClass :Customer ; sh:property [ sh:path :c_name ; sh:minCount 1 ]",
    "SELECT 'urn:t/customer/' || c_custkey AS focus_node, 'urn:t/c_name' AS path, 'MinCount' AS component, NULL::VARCHAR AS value FROM customer WHERE c_acctbal < 0",
    update="DELETE { ?c :c_name ?n } WHERE { ?c :c_name ?n ; :c_acctbal ?b FILTER(?b < 0) }",
)
shaped(
    "shacl_max_count", "supplier", "sh:targetClass :Supplier ; sh:property [ sh:path :s_name ; sh:maxCount 1 ]",
    "SELECT 'urn:t/supplier/' || s_suppkey AS focus_node, 'urn:t/s_name' AS path, 'MaxCount' AS component, NULL::VARCHAR AS value FROM supplier WHERE s_acctbal > 5000",
    update="INSERT { ?s :s_name 'second' } WHERE { ?s :s_acctbal ?b FILTER(?b > 5000) }",
)
shaped(
    "shacl_datatype", "part", "sh:targetClass :Part ; sh:property [ sh:path :p_size ; sh:datatype xsd:integer ]",
    "SELECT 'urn:t/part/' || p_partkey AS focus_node, 'urn:t/p_size' AS path, 'Datatype' AS component, 'large' AS value FROM part WHERE p_size > 40",
    update="DELETE { ?p :p_size ?z } INSERT { ?p :p_size 'large' } WHERE { ?p :p_size ?z FILTER(?z > 40) }",
)
shaped(
    "shacl_class", "customer nation", "sh:targetClass :Customer ; sh:property [ sh:path :c_nationkey ; sh:class :Coastal ]",
    "SELECT 'urn:t/customer/' || c_custkey AS focus_node, 'urn:t/c_nationkey' AS path, 'Class' AS component, 'urn:t/nation/' || c_nationkey AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1",
    update="INSERT { ?n a :Coastal } WHERE { ?n :n_regionkey <urn:t/region/1> }",
)
shaped(
    "shacl_in", "customer", "sh:targetClass :Customer ; sh:property [ sh:path :c_mktsegment ; sh:in ( 'BUILDING' 'MACHINERY' ) ]",
    "SELECT 'urn:t/customer/' || c_custkey AS focus_node, 'urn:t/c_mktsegment' AS path, 'In' AS component, c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
)
shaped(
    "shacl_has_value", "customer", "sh:targetClass :Customer ; sh:property [ sh:path :c_mktsegment ; sh:hasValue 'BUILDING' ]",
    "SELECT 'urn:t/customer/' || c_custkey AS focus_node, 'urn:t/c_mktsegment' AS path, 'HasValue' AS component, NULL::VARCHAR AS value FROM customer WHERE c_mktsegment <> 'BUILDING'",
)
shaped(
    "shacl_node_kind", "nation", "sh:targetNode <urn:t/nation/3>, <urn:t/nation/4> ; sh:property [ sh:path :n_regionkey ; sh:nodeKind sh:Literal ] ; sh:property [ sh:path :n_name ; sh:nodeKind sh:Literal ]",
    "SELECT 'urn:t/nation/' || n_nationkey AS focus_node, 'urn:t/n_regionkey' AS path, 'NodeKind' AS component, 'urn:t/region/' || n_regionkey AS value FROM nation WHERE n_nationkey IN (3, 4)",
)

# -- text and services

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
updated(
    "text_query", "documents", "INSERT DATA { :a :b :c }", "SELECT ?d { ?d :text ?t FILTER(<urn:fn/text#query>(?t, '+that -with eren*')) }",
    f"SELECT 'urn:t/doc/' || doc_id AS d FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE list_contains(w, 'that') AND NOT list_contains(w, 'with')",
)
updated(
    "text_contains", "documents", "INSERT DATA { :a :b :c }", "SELECT ?d { ?d :text ?t FILTER(<urn:fn/text#contains>(?t, 'of the')) }",
    f"SELECT 'urn:t/doc/' || doc_id AS d FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS w FROM documents) WHERE contains(w, ' of the ')",
)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _store(spark, sf_dir, "documents").text_search("that with", f"{BASE}text", 25)
    return found.select(F.col("s")["lex"].alias("d"), F.round("score", 6).alias("score"))


_add("text_search_ranked", _ranked, f"""
WITH d AS (SELECT 'urn:t/doc/' || doc_id AS d, {_WORDS} AS w FROM documents),
  f AS (SELECT d, len(w) AS n, len(list_filter(w, lambda x: x = 'that')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b FROM d),
  t AS (SELECT count(*) AS docs, avg(n) AS mean, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM f)
SELECT d, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM f, t WHERE a > 0 OR b > 0 ORDER BY score DESC, d LIMIT 25""")


def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler that answers with the names of the regions, joined with local nations; a silent failure adds nothing."""

    def handler(iri: str, node) -> DataFrame:
        if iri != "urn:remote":
            raise ConnectionError(iri)
        return Store.over(table_dataset(spark, sf_dir, ["region"])).query(PREFIX + "SELECT ?r ?name { ?r :r_name ?name }").df

    s = _store(spark, sf_dir, "nation")
    text = "SELECT ?n ?name { ?n :n_regionkey ?r SERVICE <urn:remote> { ?r :r_name ?name } SERVICE SILENT <urn:gone> { ?r :x ?y } }"
    return s.query(PREFIX + text, Options(service=handler)).decode()


_add("service_mock", _service, "SELECT 'urn:t/nation/' || n_nationkey AS n, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")

"""Queries over the tables' quads, one per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.compiler import Options
from .plans.engine import run
from .sources.dataset import table_dataset

PREFIXES = {"": "urn:t/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "geo": "http://www.opengis.net/ont/geosparql#", "geof": "http://www.opengis.net/def/function/geosparql/"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def sparql(name: str, text: str, sql: str | None, options: Options | None = None, **types: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(table_dataset(spark, sf_dir), text, options, prefixes=PREFIXES).decode(types)

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


I, D, TS = "bigint", "double", "timestamp"
T = "'urn:t/"
LI = "'urn:t/lineitem/' || sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))"

sparql(
    "group_count_by_nation",
    "SELECT ?n (COUNT(*) AS ?cnt) WHERE { ?c :c_nationkey ?k . ?k :n_name ?n } GROUP BY ?n",
    "SELECT n_name AS n, count(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    cnt=I,
)
sparql(
    "scan_pattern",
    "SELECT ?s ?o WHERE { ?s :o_totalprice ?o }",
    f"SELECT {T}orders/' || o_orderkey AS s, o_totalprice AS o FROM orders",
    o=D,
)
sparql(
    "scan_constant_object",
    "SELECT ?s WHERE { ?s :c_mktsegment 'BUILDING' }",
    f"SELECT {T}customer/' || c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING'",
)
sparql(
    "scan_bound_subject",
    "SELECT ?p ?o WHERE { <urn:t/nation/3> ?p ?o }",
    "SELECT * FROM (SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:t/Nation' AS o UNION ALL SELECT 'urn:t/n_nationkey', n_nationkey::VARCHAR FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'urn:t/n_name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'urn:t/n_regionkey', 'urn:t/region/' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#subClassOf', 'urn:t/region/' || n_regionkey FROM nation WHERE n_nationkey = 3)",
)
sparql(
    "bgp_join2",
    "SELECT ?n ?r WHERE { ?x :n_name ?n ; :n_regionkey ?y . ?y :r_name ?r }",
    "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
)
sparql(
    "bgp_star3",
    "SELECT ?c ?n ?b WHERE { ?c :c_name ?n ; :c_acctbal ?b ; :c_mktsegment 'MACHINERY' }",
    f"SELECT {T}customer/' || c_custkey AS c, c_name AS n, c_acctbal AS b FROM customer WHERE c_mktsegment = 'MACHINERY'",
    b=D,
)
sparql(
    "bgp_chain3",
    "SELECT ?o ?r WHERE { ?o :o_custkey ?c . ?c :c_nationkey ?n . ?n :n_regionkey ?r }",
    f"SELECT {T}orders/' || o_orderkey AS o, {T}region/' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
sparql(
    "bgp_two_hop",
    "SELECT ?a ?b ?c WHERE { ?a :next ?b . ?b :next ?c }",
    "WITH e AS (SELECT conv_id, turn a, lead(turn) OVER w b, lead(turn, 2) OVER w c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT 'urn:t/turn/' || conv_id || '/' || a AS a, 'urn:t/turn/' || conv_id || '/' || b AS b, 'urn:t/turn/' || conv_id || '/' || c AS c FROM e WHERE c IS NOT NULL",
)
sparql(
    "bgp_wedge",
    "SELECT (COUNT(*) AS ?n) WHERE { ?s :s_nationkey ?k . ?c :c_nationkey ?k . ?o :o_custkey ?c . ?l :l_orderkey ?o ; :l_suppkey ?s }",
    "SELECT count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey",
    n=I,
)
sparql(
    "bgp_triangle",
    "SELECT ?a ?b ?r WHERE { ?a :n_regionkey ?r . ?b :n_regionkey ?r . ?a rdfs:subClassOf ?r FILTER(STR(?a) < STR(?b)) }",
    f"SELECT {T}nation/' || a.n_nationkey AS a, {T}nation/' || b.n_nationkey AS b, {T}region/' || a.n_regionkey AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE {T}nation/' || a.n_nationkey < {T}nation/' || b.n_nationkey",
)
sparql(
    "filter_compare",
    "SELECT ?o ?p WHERE { ?o :o_totalprice ?p FILTER(?p > 400000 && ?p <= 450000.5) }",
    f"SELECT {T}orders/' || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 400000 AND o_totalprice <= 450000.5",
    p=D,
)
sparql(
    "filter_3vl",
    "SELECT ?n WHERE { ?x :n_name ?n FILTER(?n > 5 || STRENDS(?n, '1') || STRSTARTS(?n, 'NATION_2')) }",
    "SELECT n_name AS n FROM nation WHERE n_name LIKE '%1' OR n_name LIKE 'NATION_2%'",
)
sparql(
    "bind_extend",
    "SELECT ?c ?d WHERE { ?c :c_acctbal ?b BIND(?b * 2 AS ?d) }",
    f"SELECT {T}customer/' || c_custkey AS c, c_acctbal * 2 AS d FROM customer",
    d=D,
)
sparql(
    "optional_plain",
    "SELECT ?c ?o WHERE { ?c :c_mktsegment 'BUILDING' OPTIONAL { ?o :o_custkey ?c } }",
    f"SELECT {T}customer/' || c_custkey AS c, {T}orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
)
sparql(
    "optional_filter",
    "SELECT ?c ?o WHERE { ?c :c_nationkey ?k OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 300000) } }",
    f"SELECT {T}customer/' || c_custkey AS c, {T}orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000",
)
sparql(
    "optional_chain",
    "SELECT ?n ?s ?x WHERE { ?n :n_name ?m OPTIONAL { ?s :s_nationkey ?n ; :s_acctbal ?b FILTER(?b > 9000) } OPTIONAL { ?s :s_name ?x } }",
    f"WITH j AS (SELECT n_nationkey AS k, s_suppkey, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000) "
    f"SELECT {T}nation/' || k AS n, {T}supplier/' || s_suppkey AS s, s_name AS x FROM j "
    f"UNION ALL SELECT {T}nation/' || n_nationkey, {T}supplier/' || s_suppkey, s_name FROM nation, supplier WHERE n_nationkey NOT IN (SELECT k FROM j)",
)
sparql(
    "union_bag",
    "SELECT ?x WHERE { { ?s :s_nationkey ?x } UNION { ?c :c_nationkey ?x } }",
    f"SELECT {T}nation/' || s_nationkey AS x FROM supplier UNION ALL SELECT {T}nation/' || c_nationkey FROM customer",
)
sparql(
    "minus_shared",
    "SELECT ?c WHERE { ?c :c_name ?n MINUS { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 400000) } }",
    f"SELECT {T}customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
sparql(
    "minus_unbound",
    "SELECT ?s WHERE { ?s :s_nationkey ?k MINUS { ?c :c_acctbal ?b FILTER(?b > 9900) OPTIONAL { ?c :c_nationkey ?k FILTER(?b > 9950) } } }",
    f"SELECT {T}supplier/' || s_suppkey AS s FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)",
)
sparql(
    "minus_disjoint",
    "SELECT ?n WHERE { ?x :n_name ?n MINUS { ?o :r_name ?m } }",
    "SELECT n_name AS n FROM nation",
)
sparql(
    "exists_semi",
    "SELECT ?c WHERE { ?c :c_name ?n FILTER EXISTS { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 480000) } }",
    f"SELECT {T}customer/' || c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)",
)
sparql(
    "exists_correlated",
    "SELECT ?s WHERE { ?s :s_acctbal ?b FILTER EXISTS { ?c :c_acctbal ?d FILTER(?d > ?b + 9000) } }",
    f"SELECT {T}supplier/' || s_suppkey AS s FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > s_acctbal + 9000)",
)
sparql(
    "not_exists_anti",
    "SELECT ?p WHERE { ?p :p_size ?z FILTER NOT EXISTS { ?l :l_partkey ?p ; :l_quantity ?q FILTER(?q > 48) } }",
    f"SELECT {T}part/' || p_partkey AS p FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
)
sparql(
    "exists_union",
    "SELECT ?c WHERE { ?c :c_acctbal ?b FILTER EXISTS { { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > ?b * 60) } UNION { ?c :c_mktsegment 'BUILDING' FILTER(?b < 0) } } }",
    f"SELECT {T}customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60) OR (c_mktsegment = 'BUILDING' AND c_acctbal < 0)",
)
sparql(
    "exists_nested",
    "SELECT ?n WHERE { ?n :n_regionkey ?r FILTER NOT EXISTS { ?s :s_nationkey ?n ; :s_acctbal ?b FILTER NOT EXISTS { ?c :c_nationkey ?n ; :c_acctbal ?d FILTER(?d > ?b + 500) } } }",
    f"SELECT {T}nation/' || n_nationkey AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > s_acctbal + 500))",
)
sparql(
    "exists_value",
    "SELECT ?n ?e WHERE { ?n :n_name ?m BIND(EXISTS { ?s :s_nationkey ?n ; :s_acctbal ?b FILTER(?b > 9000) } AS ?e) }",
    f"SELECT {T}nation/' || n_nationkey AS n, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS e FROM nation",
    e="boolean",
)
sparql(
    "values_join",
    "SELECT ?n ?r WHERE { VALUES ?r { 'ASIA' 'EUROPE' } ?y :r_name ?r . ?x :n_regionkey ?y ; :n_name ?n }",
    "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')",
)
sparql(
    "values_undef",
    "SELECT ?x ?n WHERE { VALUES (?x ?n) { (<urn:t/nation/1> UNDEF) (UNDEF 'FRANCE') } ?x :n_name ?n }",
    f"SELECT {T}nation/' || n_nationkey AS x, n_name AS n FROM nation WHERE n_nationkey = 1 UNION ALL SELECT {T}nation/' || n_nationkey, n_name FROM nation WHERE n_name = 'FRANCE'",
)
sparql(
    "in_not_in",
    "SELECT ?p ?z WHERE { ?p :p_size ?z FILTER(?z IN (1, 2, 3.0) && ?z NOT IN (2)) }",
    f"SELECT {T}part/' || p_partkey AS p, p_size AS z FROM part WHERE p_size IN (1, 3)",
    z="int",
)
sparql(
    "lateral_join",
    "SELECT ?c ?o WHERE { ?c :c_name ?n LATERAL { SELECT ?o WHERE { ?o :o_custkey ?c ; :o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 2 } }",
    f"SELECT c, o FROM (SELECT {T}customer/' || c_custkey AS c, {T}orders/' || o_orderkey AS o, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, {T}orders/' || o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey) WHERE k <= 2",
)
sparql(
    "lateral_agg",
    "SELECT ?c ?k WHERE { ?c :c_name ?n LATERAL { SELECT (COUNT(?o) AS ?k) WHERE { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 300000) } } }",
    f"SELECT {T}customer/' || c_custkey AS c, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1",
    k=I,
)
sparql(
    "lateral_distinct",
    "SELECT ?n ?m WHERE { ?n :n_name ?x LATERAL { SELECT DISTINCT ?m WHERE { ?c :c_nationkey ?n ; :c_mktsegment ?m } } }",
    f"SELECT DISTINCT {T}nation/' || c_nationkey AS n, c_mktsegment AS m FROM customer",
)
sparql(
    "lateral_bind",
    "SELECT ?s ?y WHERE { ?s :s_acctbal ?b LATERAL { BIND(?b + 1 AS ?y) } }",
    f"SELECT {T}supplier/' || s_suppkey AS s, s_acctbal + 1 AS y FROM supplier",
    y=D,
)
sparql(
    "subselect",
    "SELECT ?n ?m WHERE { ?x :n_name ?n { SELECT ?x (COUNT(?c) AS ?m) WHERE { ?c :c_nationkey ?x } GROUP BY ?x } }",
    "SELECT n_name AS n, count(*) AS m FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    m=I,
)
sparql(
    "distinct",
    "SELECT DISTINCT ?m WHERE { ?c :c_mktsegment ?m }",
    "SELECT DISTINCT c_mktsegment AS m FROM customer",
)
sparql(
    "slice_order",
    "SELECT ?o ?p WHERE { ?o :o_totalprice ?p } ORDER BY DESC(?p) ?o OFFSET 5 LIMIT 10",
    f"SELECT {T}orders/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o LIMIT 10 OFFSET 5",
    p=D,
)
sparql(
    "graph_iri",
    "SELECT ?e ?v WHERE { GRAPH <urn:g/click> { ?e :value ?v } }",
    "SELECT 'urn:t/event/' || event_id AS e, value AS v FROM events WHERE event_type = 'click'",
    v=D,
)
sparql(
    "graph_var",
    "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?e :value ?v } } GROUP BY ?g",
    "SELECT 'urn:g/' || event_type AS g, count(*) AS n FROM events GROUP BY 1",
    n=I,
)
sparql(
    "from_merge",
    "SELECT (COUNT(*) AS ?n) FROM <urn:g/click> FROM <urn:g/view> WHERE { ?e :event_type ?t }",
    "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view')",
    n=I,
)
sparql(
    "union_default",
    "SELECT ?t (COUNT(*) AS ?n) WHERE { ?e :event_type ?t } GROUP BY ?t",
    "SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1",
    Options(union_default_graph=True), n=I,
)
sparql(
    "count_star",
    "SELECT (COUNT(*) AS ?n) WHERE { ?l :l_quantity ?q }",
    "SELECT count(*) AS n FROM lineitem",
    n=I,
)
sparql(
    "count_distinct",
    "SELECT (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o :o_custkey ?c }",
    "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    n=I,
)
sparql(
    "sum_promote",
    "SELECT ?m (SUM(?b) AS ?s) (COUNT(?b) AS ?n) WHERE { ?c :c_mktsegment ?m ; :c_acctbal ?b } GROUP BY ?m HAVING(COUNT(?b) > 1)",
    "SELECT c_mktsegment AS m, round(sum(c_acctbal), 2) AS s, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
    n=I, s="rounded",
)
sparql(
    "sum_integer",
    "SELECT ?b (SUM(?z) AS ?s) WHERE { ?p :p_brand ?b ; :p_size ?z } GROUP BY ?b",
    "SELECT p_brand AS b, sum(p_size)::BIGINT AS s FROM part GROUP BY 1",
    s=I,
)
sparql(
    "avg_decimal",
    "SELECT ?b (AVG(?z) AS ?a) WHERE { ?p :p_brand ?b ; :p_size ?z } GROUP BY ?b",
    "SELECT p_brand AS b, round(avg(p_size), 2) AS a FROM part GROUP BY 1",
    a="rounded",
)
sparql(
    "sample",
    "SELECT ?x (SAMPLE(?n) AS ?v) WHERE { ?x :n_name ?n } GROUP BY ?x",
    f"SELECT {T}nation/' || n_nationkey AS x, n_name AS v FROM nation",
)
sparql(
    "order_mixed_terms",
    "SELECT ?s ?o WHERE { ?s :n_regionkey|:n_nationkey ?o } ORDER BY ?o ?s LIMIT 25",
    f"SELECT {T}nation/' || n_nationkey AS s, {T}region/' || n_regionkey AS o FROM nation",
)
sparql(
    "timezone",
    "SELECT ?e (TZ(?u) AS ?z) (TIMEZONE(?u) AS ?y) (HOURS(?u) AS ?h) (MINUTES(?u) AS ?m) (TZ(?d) AS ?none) WHERE { GRAPH <urn:g/view> { ?e :ts ?d } BIND(STRDT(CONCAT(STR(?d), 'Z'), xsd:dateTime) AS ?u) }",
    "SELECT 'urn:t/event/' || event_id AS e, 'Z' AS z, 'PT0S' AS y, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS m, '' AS none FROM events WHERE event_type = 'view'",
    h=I, m=I,
)
sparql(
    "logic_terms",
    "SELECT ?x (isIRI(?r) AS ?a) (isLITERAL(?n) AS ?b) (isNUMERIC(?k) AS ?c) (sameTerm(?n, ?r) AS ?d) (BOUND(?none) AS ?e) (-?k AS ?f) (?k / 2 AS ?g) WHERE { ?x :n_name ?n ; :n_regionkey ?r ; :n_nationkey ?k }",
    f"SELECT {T}nation/' || n_nationkey AS x, true AS a, true AS b, true AS c, false AS d, false AS e, -n_nationkey::BIGINT AS f, n_nationkey / 2 AS g FROM nation",
    a="boolean", b="boolean", c="boolean", d="boolean", e="boolean", f=I, g=D,
)
sparql(
    "iri_strdt_strlang",
    "SELECT ?x (IRI(CONCAT('urn:n/', ?n)) AS ?i) (LANG(STRLANG(?n, 'EN')) AS ?l) (DATATYPE(STRDT(?n, xsd:token)) AS ?d) WHERE { ?x :n_name ?n }",
    f"SELECT {T}nation/' || n_nationkey AS x, 'urn:n/' || n_name AS i, 'en' AS l, 'http://www.w3.org/2001/XMLSchema#token' AS d FROM nation",
)
sparql(
    "contains_starts",
    "SELECT ?p WHERE { ?p :p_name ?n FILTER(CONTAINS(?n, 'ring') || STRSTARTS(?n, 'blue')) }",
    f"SELECT {T}part/' || p_partkey AS p FROM part WHERE contains(p_name, 'ring') OR p_name LIKE 'blue%'",
)
sparql(
    "from_named",
    "SELECT ?g (COUNT(*) AS ?n) FROM NAMED <urn:g/click> FROM NAMED <urn:g/view> WHERE { GRAPH ?g { ?e :value ?v } } GROUP BY ?g",
    "SELECT 'urn:g/' || event_type AS g, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
    n=I,
)
sparql(
    "construct_where",
    "CONSTRUCT WHERE { ?s :s_nationkey ?n }",
    f"SELECT {T}supplier/' || s_suppkey AS s, 'urn:t/s_nationkey' AS p, {T}nation/' || s_nationkey AS o FROM supplier",
)
sparql(
    "reduced",
    "SELECT REDUCED ?x WHERE { ?x :r_name ?n }",
    f"SELECT {T}region/' || r_regionkey AS x FROM region",
)
sparql(
    "ground_pattern",
    "SELECT ?n WHERE { ?x :n_name ?n . <urn:t/nation/1> :n_name 'NATION_1' }",
    "SELECT n_name AS n FROM nation",
)
sparql(
    "bgp_cycle",
    "SELECT (COUNT(*) AS ?n) WHERE { ?l :l_orderkey ?o ; :l_suppkey ?s . ?o :o_custkey ?c . ?c :c_nationkey ?k . ?s :s_nationkey ?k . ?k :n_regionkey ?r }",
    "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey",
    n=I,
)
sparql(
    "min_max",
    "SELECT ?m (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) WHERE { ?c :c_mktsegment ?m ; :c_acctbal ?b } GROUP BY ?m",
    "SELECT c_mktsegment AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1",
    lo=D, hi=D,
)
sparql(
    "group_concat_distinct",
    "SELECT ?r (GROUP_CONCAT(DISTINCT ?n; SEPARATOR='|') AS ?s) WHERE { ?x :n_name ?n ; :n_regionkey ?r } GROUP BY ?r",
    f"SELECT {T}region/' || n_regionkey AS r, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS s FROM nation GROUP BY 1",
)
sparql(
    "having",
    "SELECT ?k (COUNT(*) AS ?n) WHERE { ?c :c_nationkey ?k } GROUP BY ?k HAVING(COUNT(*) > 60)",
    f"SELECT {T}nation/' || c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60",
    n=I,
)
sparql(
    "implicit_group",
    "SELECT (COUNT(*) AS ?n) (MAX(?v) AS ?m) WHERE { ?x :no_such ?v }",
    "SELECT 0::BIGINT AS n, NULL::VARCHAR AS m",
    n=I,
)
sparql(
    "path_seq",
    "SELECT ?c ?r WHERE { ?c :c_nationkey/:n_regionkey ?r }",
    f"SELECT {T}customer/' || c_custkey AS c, {T}region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
sparql(
    "path_alt",
    "SELECT ?x ?k WHERE { ?x :s_nationkey|:c_nationkey ?k }",
    f"SELECT {T}supplier/' || s_suppkey AS x, {T}nation/' || s_nationkey AS k FROM supplier UNION ALL SELECT {T}customer/' || c_custkey, {T}nation/' || c_nationkey FROM customer",
)
sparql(
    "path_inverse",
    "SELECT ?k ?s WHERE { ?k ^:s_nationkey ?s }",
    f"SELECT {T}nation/' || s_nationkey AS k, {T}supplier/' || s_suppkey AS s FROM supplier",
)
sparql(
    "path_opt",
    "SELECT ?a ?x WHERE { ?a :n_name ?n ; :n_regionkey? ?x }",
    f"SELECT {T}nation/' || n_nationkey AS a, {T}nation/' || n_nationkey AS x FROM nation UNION ALL SELECT {T}nation/' || n_nationkey, {T}region/' || n_regionkey FROM nation",
)
sparql(
    "path_opt_bound",
    "SELECT ?x WHERE { <urn:t/nation/2> :n_regionkey? ?x }",
    f"SELECT {T}nation/2' AS x UNION ALL SELECT {T}region/' || n_regionkey FROM nation WHERE n_nationkey = 2",
)
sparql(
    "path_plus",
    "SELECT ?a ?b WHERE { ?a :next+ ?b }",
    "SELECT 'urn:t/turn/' || x.conv_id || '/' || x.turn AS a, 'urn:t/turn/' || y.conv_id || '/' || y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn > x.turn",
)
sparql(
    "path_star",
    "SELECT ?a ?b WHERE { ?a :turn ?k ; :next* ?b }",
    "SELECT 'urn:t/turn/' || x.conv_id || '/' || x.turn AS a, 'urn:t/turn/' || y.conv_id || '/' || y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn >= x.turn",
)
sparql(
    "path_star_bound",
    "SELECT ?b WHERE { <urn:t/turn/1/0> :next* ?b }",
    "SELECT 'urn:t/turn/' || conv_id || '/' || turn AS b FROM conversations WHERE conv_id = 1 AND turn >= 0",
)
sparql(
    "path_neg_set",
    "SELECT ?n ?o WHERE { ?n :n_name ?m ; !(:n_name|rdf:type|rdfs:subClassOf) ?o }",
    f"SELECT {T}nation/' || n_nationkey AS n, n_nationkey::VARCHAR AS o FROM nation UNION ALL SELECT {T}nation/' || n_nationkey, {T}region/' || n_regionkey FROM nation",
)
sparql(
    "path_composed",
    "SELECT DISTINCT ?r WHERE { ?o :o_custkey/(:c_nationkey|:s_nationkey)/:n_regionkey ?r }",
    f"SELECT DISTINCT {T}region/' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
sparql(
    "str_functions",
    "SELECT ?n (UCASE(SUBSTR(?n, 2, 3)) AS ?a) (STRLEN(?n) AS ?b) (CONCAT(?n, '-', LCASE(?n)) AS ?c) WHERE { ?x :n_name ?n }",
    "SELECT n_name AS n, upper(substr(n_name, 2, 3)) AS a, length(n_name) AS b, n_name || '-' || lower(n_name) AS c FROM nation",
    b=I,
)
sparql(
    "regex_replace",
    "SELECT ?n (REPLACE(?n, 'r(.)', '<$1>') AS ?r) WHERE { ?x :p_name ?n FILTER REGEX(?n, '^[R-S].*(IN|BO)', 'i') }",
    "SELECT p_name AS n, regexp_replace(p_name, 'r(.)', '<\\1>', 'g') AS r FROM part WHERE regexp_matches(p_name, '^[r-sR-S].*([iI][nN]|[bB][oO])')",
)
sparql(
    "strbefore_after",
    "SELECT ?p (STRBEFORE(?n, ' ') AS ?a) (STRAFTER(?n, ' ') AS ?b) WHERE { ?p :p_name ?n }",
    f"SELECT {T}part/' || p_partkey AS p, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END AS a, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS b FROM part",
)
sparql(
    "encode_uri",
    "SELECT ?n (ENCODE_FOR_URI(CONCAT(?n, ' ~/')) AS ?e) WHERE { ?x :r_name ?n }",
    "SELECT r_name AS n, replace(r_name, ' ', '%20') || '%20~%2F' AS e FROM region",
)
sparql(
    "hash_md5_sha",
    "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x :n_name ?n }",
    "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation",
)
sparql(
    "date_parts",
    "SELECT ?y ?m (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) } GROUP BY ?y ?m",
    "SELECT year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    y=I, m=I, n=I,
)
sparql(
    "date_compare",
    "SELECT (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d FILTER(?d < '1996-01-01T00:00:00'^^xsd:dateTime) }",
    "SELECT count(*) AS n FROM orders WHERE o_orderdate < '1996-01-01'",
    n=I,
)
sparql(
    "abs_ceil_floor_round",
    "SELECT ?c (ABS(?b) AS ?p) (CEIL(?b) AS ?q) (FLOOR(?b) AS ?r) (ROUND(?b) AS ?s) WHERE { ?c :s_acctbal ?b }",
    f"SELECT {T}supplier/' || s_suppkey AS c, abs(s_acctbal) AS p, ceil(s_acctbal) AS q, floor(s_acctbal) AS r, floor(s_acctbal + 0.5) AS s FROM supplier",
    p=D, q=D, r=D, s=D,
)
sparql(
    "cast_integer",
    "SELECT ?s (xsd:integer(?b) AS ?i) (xsd:string(?b) AS ?t) (xsd:boolean(?b) AS ?f) WHERE { ?s :p_size ?b }",
    f"SELECT {T}part/' || p_partkey AS s, p_size::BIGINT AS i, p_size::VARCHAR AS t, (p_size <> 0) AS f FROM part",
    i=I, f="boolean",
)
sparql(
    "if_coalesce",
    "SELECT ?s (IF(?z > 25, 'big', 'small') AS ?k) (COALESCE(?none, ?z) AS ?w) WHERE { ?s :p_size ?z }",
    f"SELECT {T}part/' || p_partkey AS s, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS k, p_size::BIGINT AS w FROM part",
    w=I,
)
sparql(
    "datatype_lang",
    "SELECT ?d (LANG(?t) AS ?l) (DATATYPE(?n) AS ?y) WHERE { ?d :text ?t ; :n_chars ?n FILTER(LANGMATCHES(LANG(?t), 'en')) }",
    "SELECT 'urn:t/doc/' || doc_id AS d, lang AS l, 'http://www.w3.org/2001/XMLSchema#integer' AS y FROM documents WHERE lang = 'en'",
)
sparql(
    "order_by_lang",
    "SELECT ?l (COUNT(*) AS ?n) WHERE { ?d :lang ?l } GROUP BY ?l ORDER BY DESC(?n) ?l",
    "SELECT lang AS l, count(*) AS n FROM documents GROUP BY 1",
    n=I,
)
sparql(
    "ask",
    "ASK { ?c :c_mktsegment 'BUILDING' }",
    "SELECT count(*) > 0 AS answer FROM customer WHERE c_mktsegment = 'BUILDING'",
)
sparql(
    "construct",
    "CONSTRUCT { ?r :holds ?n } WHERE { ?n :n_regionkey ?r }",
    f"SELECT {T}region/' || n_regionkey AS s, 'urn:t/holds' AS p, {T}nation/' || n_nationkey AS o FROM nation",
)
sparql(
    "describe",
    "DESCRIBE <urn:t/region/1>",
    "SELECT 'urn:t/region/1' AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:t/Region' AS o UNION ALL SELECT 'urn:t/region/1', 'urn:t/r_name', r_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'urn:t/region/1', 'urn:t/r_regionkey', '1'",
)
sparql(
    "triple_terms",
    "SELECT ?s ?o WHERE { ?x :n_regionkey ?r BIND(<<( ?x :in ?r )>> AS ?t) BIND(SUBJECT(?t) AS ?s) BIND(OBJECT(?t) AS ?o) FILTER(isTRIPLE(?t)) }",
    f"SELECT {T}nation/' || n_nationkey AS s, {T}region/' || n_regionkey AS o FROM nation",
)
sparql(
    "volatile_functions",
    "SELECT ?x (REGEX(STR(UUID()), '^urn:uuid:[0-9a-f-]{36}$') AS ?a) (STRLEN(STRUUID()) AS ?b) (RAND() < 1 AS ?c) (YEAR(NOW()) > 2000 AS ?d) (isBLANK(BNODE()) AS ?e) (isBLANK(BNODE(?n)) AS ?f) WHERE { ?x :r_name ?n }",
    f"SELECT {T}region/' || r_regionkey AS x, true AS a, 36::BIGINT AS b, true AS c, true AS d, true AS e, true AS f FROM region",
    a="boolean", b=I, c="boolean", d="boolean", e="boolean", f="boolean",
)
sparql(
    "lang_functions",
    "SELECT ?x (hasLANG(?l) AS ?a) (hasLANG(?n) AS ?b) (LANGDIR(?r) AS ?c) (hasLANGDIR(?r) AS ?d) (LANG(?r) AS ?e) (STR(?r) AS ?f) WHERE { ?x :r_name ?n BIND(STRLANG(?n, 'en') AS ?l) BIND(STRLANGDIR(?n, 'ar', 'rtl') AS ?r) }",
    f"SELECT {T}region/' || r_regionkey AS x, true AS a, false AS b, 'rtl' AS c, true AS d, 'ar' AS e, r_name AS f FROM region",
    a="boolean", b="boolean", d="boolean",
)
sparql(
    "casts",
    "SELECT ?o (xsd:date(?d) AS ?a) (xsd:dateTime(STR(?d)) AS ?b) (xsd:double('1e1') AS ?c) (xsd:decimal('2.50') AS ?e) (xsd:float(3) AS ?f) (xsd:integer('no') AS ?g) (xsd:boolean('1') AS ?h) WHERE { ?o :o_orderdate ?d }",
    f"SELECT {T}orders/' || o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS b, 10.0::DOUBLE AS c, 2.5::DOUBLE AS e, 3.0::DOUBLE AS f, NULL::VARCHAR AS g, true AS h FROM orders",
    c=D, e=D, f=D, h="boolean",
)
sparql(
    "day_seconds",
    "SELECT ?e (DAY(?d) AS ?a) (FLOOR(SECONDS(?d)) AS ?b) WHERE { GRAPH <urn:g/error> { ?e :ts ?d } }",
    "SELECT 'urn:t/event/' || event_id AS e, day(ts)::BIGINT AS a, second(ts)::DOUBLE AS b FROM events WHERE event_type = 'error'",
    a=I, b=D,
)
sparql(
    "term_parts",
    "SELECT ?x (STR(PREDICATE(?t)) AS ?p) (isTRIPLE(TRIPLE(?x, rdf:type, ?n)) AS ?q) (isTRIPLE(?n) AS ?r) (sameTerm(OBJECT(?t), ?n) AS ?s) WHERE { ?x :n_name ?n BIND(TRIPLE(?x, :n_name, ?n) AS ?t) }",
    f"SELECT {T}nation/' || n_nationkey AS x, 'urn:t/n_name' AS p, true AS q, false AS r, true AS s FROM nation",
    q="boolean", r="boolean", s="boolean",
)
sparql(
    "quoted_pattern",
    "SELECT ?x ?k WHERE { { SELECT ?t WHERE { ?y :n_regionkey ?z BIND(<<( ?y :within ?z )>> AS ?t) } } BIND(SUBJECT(?t) AS ?x) BIND(OBJECT(?t) AS ?k) ?x :n_name ?n }",
    f"SELECT {T}nation/' || n_nationkey AS x, {T}region/' || n_regionkey AS k FROM nation",
)
sparql(
    "geo_within",
    "SELECT ?n WHERE { ?n :n_nationkey ?k ; :n_regionkey/:r_regionkey ?r BIND(STRDT(CONCAT('POINT (', STR(?k), ' ', STR(?r), ')'), geo:wktLiteral) AS ?g) FILTER(geof:sfWithin(?g, 'POLYGON ((2 0, 20 0, 20 3, 2 3, 2 0))'^^geo:wktLiteral)) }",
    f"SELECT {T}nation/' || n_nationkey AS n FROM nation WHERE n_nationkey > 2 AND n_nationkey < 20 AND n_regionkey > 0 AND n_regionkey < 3",
)
sparql(
    "geo_distance",
    "SELECT ?n (geof:distance(?g, 'POINT (0 0)'^^geo:wktLiteral) AS ?d) (geof:area(geof:envelope(?l)) AS ?a) WHERE { ?n :n_nationkey ?k BIND(STRDT(CONCAT('POINT (0 ', STR(?k), ')'), geo:wktLiteral) AS ?g) BIND(STRDT(CONCAT('LINESTRING (0 0, 2 ', STR(?k), ')'), geo:wktLiteral) AS ?l) }",
    f"SELECT {T}nation/' || n_nationkey AS n, round(6371008.8 * radians(n_nationkey), 2) AS d, round(2.0::DOUBLE * n_nationkey, 2) AS a FROM nation",
    d="rounded", a="rounded",
)

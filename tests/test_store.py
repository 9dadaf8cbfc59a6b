"""Updates, Cypher, reasoning, SHACL, text search and files."""

import pytest

from quadrille.operators import shacl
from quadrille.plans import cypher
from quadrille.sources import formats, ntriples, results, turtle
from quadrille.sources.dataset import Dataset
from quadrille.store import Store

P = "PREFIX : <http://ex/> "


def values(result):
    return sorted(tuple(r) for r in result.decode().collect())


def filled(spark, text, **kw):
    s = Store(spark, **kw)
    s.extend([(q[1], q[2], q[3], *([q[0]] if q[0] else [])) for q in turtle.parse("@prefix : <http://ex/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . " + text)])
    return s


def test_updates(spark):
    s = Store(spark)
    s.update(P + "INSERT DATA { :a :p 1 . :b :p 2 . GRAPH :g { :x :y 'z'@en } } ; DELETE DATA { :b :p 2 }")
    assert len(s) == 2
    s.update(P + "DELETE { ?x :p ?o } INSERT { ?x :p 3 } WHERE { ?x :p ?o } ; COPY :g TO :h ; CLEAR GRAPH :g")
    assert values(s.query(P + "SELECT ?o { :a :p ?o }")) == [("3",)]
    assert values(s.query(P + "SELECT ?g { GRAPH ?g { :x :y ?o } }")) == [("http://ex/h",)]
    with pytest.raises(Exception, match="no graph"):
        s.update(P + "DROP GRAPH :none")
    s.update(P + "DROP SILENT GRAPH :none")
    s.update(P + "DELETE { :a :p ?o } INSERT { :a :p ?o } WHERE { :a :p ?o }")  # T12: inserts come after all deletes
    assert values(s.query(P + "SELECT ?o { :a :p ?o }")) == [("3",)]
    assert s.contains((("iri", "http://ex/a"), ("iri", "http://ex/p"), ("lit", "3", "http://www.w3.org/2001/XMLSchema#integer", None, None)))


def test_cypher(spark):
    s = Store(spark)
    s.cypher_update("CREATE (a:Person {name: 'Ann', age: 40})-[:KNOWS {since: 2001}]->(b:Person {name: 'Ben', age: 20})")
    assert values(s.cypher("MATCH (p:Person)-[:KNOWS]->(q) WHERE p.age > 30 RETURN p.name, q.name AS other")) == [("Ann", "Ben")]
    assert values(s.cypher("MATCH (p)-[r:KNOWS]->(q) WHERE r.since = 2001 RETURN q.name")) == [("Ben",)]
    assert values(s.cypher("MATCH (p)-[:KNOWS*]->(q) RETURN p.name, q.name")) == [("Ann", "Ben")]
    s.cypher_update("MATCH (p:Person) WHERE p.age < 30 SET p.age = 21")
    assert values(s.cypher("MATCH (p:Person) RETURN p.age")) == [("21",), ("40",)]
    s.cypher_update("MATCH (p:Person) WHERE p.age = 21 DETACH DELETE p")
    assert values(s.cypher("MATCH (p:Person) RETURN p.name")) == [("Ann",)]


@pytest.mark.parametrize("text", ["MATCH (a) WITH a RETURN a", "OPTIONAL MATCH (a) RETURN a", "MATCH (a)-[:R*2]->(b) RETURN a", "MATCH (a) WHERE a.b = NULL RETURN a", "MERGE (a)"])
def test_cypher_rejects(text):
    with pytest.raises(cypher.CypherError):
        cypher.parse_query(text)


def test_reasoning(spark):
    s = filled(spark, ":lark a :Songbird . :Songbird rdfs:subClassOf :Bird . :Bird rdfs:subClassOf :Being . :anc a owl:TransitiveProperty . :a :anc :b . :b :anc :c . :c :anc :d . :near a owl:SymmetricProperty . :a :near :q .", reasoning=True)
    assert s.query(P + "ASK { :lark a :Being }").boolean()
    assert values(s.query(P + "SELECT ?x { :a :anc ?x }")) == [("http://ex/b",), ("http://ex/c",), ("http://ex/d",)]
    assert s.query(P + "ASK { :q :near :a }").boolean()
    bad = filled(spark, ":Bird owl:disjointWith :Fish . :lark a :Bird, :Fish . :irr a owl:IrreflexiveProperty . :z :irr :z .")
    assert sorted(r["rule"] for r in bad.diagnostics().collect()) == ["cax-dw", "prp-irp"]


def test_shacl(spark):
    shapes = turtle.frame(spark, turtle.parse("@prefix : <http://ex/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . :S a sh:NodeShape ; sh:targetClass :P ; sh:property [ sh:path :age ; sh:minCount 1 ; sh:datatype xsd:integer ] , [ sh:path :kind ; sh:in ( :u :v ) ] ."))
    s = filled(spark, ":a a :P ; :age 3 ; :kind :u . :b a :Q . :Q rdfs:subClassOf :P . :c a :P ; :age 'old' ; :kind :w .")
    got = sorted((r["focus_node"][-1], r["source_constraint_component"].split("#")[1]) for r in s.validate(shapes).collect())
    assert got == [("b", "MinCountConstraintComponent"), ("c", "DatatypeConstraintComponent"), ("c", "InConstraintComponent")]
    report = Store.over(Dataset(shacl.report_quads(s.validate(shapes))))
    q = "PREFIX sh: <http://www.w3.org/ns/shacl#> SELECT ?f ?c { ?r a sh:ValidationReport ; sh:conforms false ; sh:result ?x . ?x sh:focusNode ?f ; sh:sourceConstraintComponent ?c }"
    assert sorted((f[-1], c.split("#")[1]) for f, c in values(report.query(q))) == got
    fine = shacl.report_quads(s.validate(turtle.frame(spark, [])))
    assert fine.count() == 2


def test_text_search(spark):
    s = filled(spark, ":s1 :name 'three grey herons wade' . :s2 :name 'one old barge drifts' .")
    q = lambda f, x: values(s.query(P + f"SELECT ?x {{ ?x :name ?n FILTER(<urn:fn/text#{f}>(?n, '{x}')) }}"))
    assert q("query", "heron*") == [("http://ex/s1",)]
    assert q("query", "gre* OR barge") == [("http://ex/s1",), ("http://ex/s2",)]
    assert q("query", "+old -barge") == []
    assert q("contains", "grey herons") == [("http://ex/s1",)]
    assert q("contains", "heron") == []


def test_files(spark, tmp_path):
    s = filled(spark, ":a :p 'x\\ny\\u00e9'@en-us . :a :q 1.5 . :g { :b :p <<( :s :p 'o' )>> . }")
    s.dump(str(tmp_path / "out"))
    back = ntriples.read(spark, str(tmp_path / "out"), rename_blank_nodes=False)
    key = lambda df: sorted(map(repr, df.select("g", "s", "p", "o").collect()))
    assert key(back) == key(s.dataset.quads)
    r = s.query(P + "SELECT ?p ?o { :a ?p ?o }")
    for form in ("json", "xml", "tsv"):
        names, found = results.parse("".join(results.serialize(r, form)), form)
        assert names == ["p", "o"] and len(found) == 2 and ("lit", "1.5", "http://www.w3.org/2001/XMLSchema#decimal", None, None) in [f["o"] for f in found]
    assert "".join(results.serialize(r, "csv")).startswith("p,o\r\n")


DOCS = {
    "rdfxml": """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://ex/" xml:base="http://ex/">
      <e:Port rdf:about="a" e:code="7"><e:near rdf:resource="b"/><e:name xml:lang="de">Hafen</e:name><e:deep rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">9</e:deep>
      <e:in><e:Land rdf:about="c"/></e:in><e:has rdf:parseType="Collection"><rdf:Description rdf:about="q"/></e:has></e:Port></rdf:RDF>""",
    "jsonld": """{"@context": {"@vocab": "http://ex/", "@base": "http://ex/", "near": {"@type": "@id"}, "has": {"@container": "@list", "@type": "@id"}}, "@id": "a", "@type": "Port", "code": "7",
      "near": "b", "name": {"@value": "Hafen", "@language": "de"}, "deep": 9, "in": {"@id": "c", "@type": "Land"}, "has": ["q"]}""",
    "turtle": """@prefix : <http://ex/> . :a a :Port ; :code '7' ; :near :b ; :name 'Hafen'@de ; :deep 9 ; :in :c ; :has ( :q ) . :c a :Land .""",
}


def shape(quads):
    """Quads with blank nodes made alike."""
    return sorted((repr(g), *("_" if x[0] == "bnode" else repr(x) for x in (s, p, o))) for g, s, p, o in quads)


@pytest.mark.parametrize("form", ["rdfxml", "jsonld", "turtle"])
def test_parse_formats(form):
    assert shape(formats.parse(DOCS[form], form)) == shape(formats.parse(DOCS["turtle"], "n3"))


@pytest.mark.parametrize("form", ["turtle", "trig", "rdfxml", "jsonld", "ntriples", "nquads"])
def test_write_formats(spark, form):
    quads = formats.parse(DOCS["turtle"], "turtle") + [(None, ("iri", "http://ex/z"), ("iri", "http://ex/p"), ("lit", "<&\"\n'", "http://www.w3.org/2001/XMLSchema#string", None, None))]
    graphs = [(("iri", "http://ex/g"), *q[1:]) for q in quads[:3]] if form in formats.DATASETS else []
    text = "".join(formats.serialize(turtle.frame(spark, quads + graphs), form))
    assert shape(formats.parse(text, form)) == shape(quads + graphs)
    if form == "turtle":
        with pytest.raises(ValueError, match="named graphs"):
            list(formats.serialize(turtle.frame(spark, [(("iri", "http://ex/g"), *quads[0][1:])]), form))


def test_convert_and_graph_store(spark, tmp_path):
    (tmp_path / "in.rdf").write_text(DOCS["rdfxml"])
    formats.convert(spark, str(tmp_path / "in.rdf"), str(tmp_path / "out.trig"), to_graph="http://ex/g")
    s = Store(spark)
    s.load([str(tmp_path / "out.trig"), str(tmp_path / "in.rdf")])
    n = s.graph("http://ex/g").count()
    assert n == s.graph().count() == 10
    s.put(s.graph().limit(3), "http://ex/g")
    assert s.graph("http://ex/g").count() == 3 and s.graph().count() == n
    s.post(s.graph(), "http://ex/h")
    s.delete("http://ex/g")
    assert [r[0] for r in s.named_graphs().collect()] == ["http://ex/h"]
    s.add_graph("http://ex/empty")
    s.backup(str(tmp_path / "backup"))
    again = Store.restore(spark, str(tmp_path / "backup"))
    assert len(again) == len(s) and {r[0] for r in again.named_graphs().collect()} == {"http://ex/h", "http://ex/empty"}


def test_parquet_store(spark, tmp_path):
    s = filled(spark, ":a :p :b .")
    s.path = str(tmp_path / "store")
    s.flush()
    assert len(Store(spark, str(tmp_path / "store"))) == 1


def test_stream_ingest(spark, tmp_path):
    from quadrille import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nq").write_text("<http://ex/a> <http://ex/p> \"1\" .\nnot a line\n<http://ex/b> <http://ex/p> <http://ex/c> <http://ex/g> .\n")
    streaming.ingest(streaming.watch(spark, str(tmp_path / "in")), str(tmp_path / "q"), str(tmp_path / "c")).awaitTermination()
    assert len(Store(spark, str(tmp_path / "q"))) == 2

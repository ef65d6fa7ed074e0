"""RDF syntaxes, results, the store with updates, and pipelines."""

import json

import pytest

from tessera.engine import from_quads, query
from tessera.operators.update import UpdateError, update
from tessera.plans.parser import SparqlError, parse_query, parse_update
from tessera.sources import rdf, results
from tessera.sources.interchange import JsonLdError, parse_jsonld, parse_rdfxml
from tessera.sources.turtle import parse_trig, parse_turtle
from tessera.store import Store
from tessera.streaming.pipeline import Stream, run

LINES = """<http://x/a> <http://x/p> "1" .
<http://x/a> <http://x/q> "2\\n\\"x"@EN .
# a comment
<http://x/b> <http://x/p> "3"^^<http://www.w3.org/2001/XMLSchema#string> <http://x/g> .

_:c <http://x/p> "4" .
<http://x/a> <http://x/p> "5" .
"""


@pytest.fixture()
def nq(tmp_path):
    f = tmp_path / "d.nq"
    f.write_text(LINES)
    return f"file://{f}"


def test_lines(spark, nq, tmp_path):
    got = sorted(map(tuple, rdf.read(spark, nq).collect()), key=str)
    assert ("<http://x/a>", "<http://x/q>", '"2\\n\\"x"@en', None) in got and ("<http://x/b>", "<http://x/p>", '"3"', "<http://x/g>") in got and len(got) == 5
    rdf.write(rdf.read(spark, nq), f"file://{tmp_path}/out.nq")
    assert rdf.read(spark, f"file://{tmp_path}/out.nq", "nq").where("s like '<%'").exceptAll(rdf.read(spark, nq).where("s like '<%'")).count() == 0
    (tmp_path / "bad.nt").write_text("<http://x/a> <http://x/p> .\n")
    with pytest.raises(Exception, match="not a statement"):
        rdf.read(spark, f"file://{tmp_path}/bad.nt").collect()


def test_documents(spark, tmp_path):
    (tmp_path / "d.ttl").write_text('@prefix : <http://x/> . :a a :C ; :p "x@prefix y", (1 2) , [ :q 1.5 ] .')
    assert rdf.read(spark, f"file://{tmp_path}/d.ttl").count() == 9
    rdf.write(rdf.read(spark, f"file://{tmp_path}/d.ttl"), f"file://{tmp_path}/o.trig")
    assert rdf.read(spark, f"file://{tmp_path}/o.trig", "trig").count() == 9
    assert parse_trig("PREFIX : <http://x/> :g { :a :b :c }")[0][3] == "<http://x/g>"
    with pytest.raises(SparqlError):
        parse_turtle("?a <http://x/p> 1 .")
    xml = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:T r:about="http://x/a"><e:p xml:lang="en">v</e:p><e:q><e:U/></e:q></e:T></r:RDF>'
    assert len(parse_rdfxml(xml)) == 4
    assert len(parse_jsonld('{"@context": {"n": "http://x/n"}, "@id": "http://x/a", "n": [1, true, {"@value": "x", "@language": "en"}]}')) == 3
    with pytest.raises(JsonLdError):
        parse_jsonld('{"@context": "http://remote/", "@id": "http://x/a"}')


def test_results(spark):
    d = from_quads(spark, [("<http://x/a>", "<http://x/p>", '"v,\\"w"@en', None), ("<http://x/a>", "<http://x/q>", "_:b", None)])
    r = query(d, "SELECT ?o ?z { ?s ?p ?o }")
    got = json.loads(results.text(r, "json"))
    assert {"type": "literal", "value": 'v,"w', "xml:lang": "en"} in [b["o"] for b in got["results"]["bindings"]] and got["head"]["vars"] == ["o", "z"]
    assert '<literal xml:lang="en">v,&quot;w</literal>' in results.text(r, "xml")
    assert '"v,""w",' in results.text(r, "csv") and '"v,\\"w"@en' in results.text(r, "tsv")
    assert json.loads(results.text(query(d, "ASK {}"), "json"))["boolean"] is True
    assert results.negotiated("text/csv;q=0.5, application/*", ["text/csv", "application/json"]) == "application/json"


def test_store_and_updates(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    p = "PREFIX : <http://x/> "

    def n(where="?s ?p ?o"):
        return query(store.snapshot(), p + f"SELECT * {{ {where} }}").df.count()

    update(store, p + "INSERT DATA { :a :p 1 . :a :p 2 . GRAPH :g { :b :p 3 . _:x :p _:x } }")
    old = store.epoch
    assert n() == 2 and n("GRAPH ?h { ?s ?p ?o }") == 2
    update(store, p + "DELETE { ?s :p ?o } INSERT { ?s :q ?o . ?s :r [] } WHERE { ?s :p ?o FILTER(?o > 1) }")
    assert n("?s :q 2") == 1 and n() == 3 and n("?s :r ?b FILTER isBLANK(?b)") == 1
    assert query(store.snapshot(old), p + "SELECT * { ?s ?p ?o }").df.count() == 2
    update(store, p + "COPY GRAPH :g TO GRAPH :h ; MOVE :h TO :i ; ADD DEFAULT TO :i")
    assert n("GRAPH :i { ?s ?p ?o }") == 5 and n("GRAPH :h { ?s ?p ?o }") == 0
    update(store, p + "WITH :i DELETE { ?s :p ?o } WHERE { ?s :p ?o }")
    assert n("GRAPH :i { ?s ?p ?o }") == 2
    update(store, p + "DELETE WHERE { ?s :q ?o } ; DELETE DATA { :a :p 1 }")
    assert n() == 1
    with pytest.raises(UpdateError):
        update(store, p + "CLEAR GRAPH :none")
    update(store, p + "DROP SILENT GRAPH :none ; LOAD SILENT <http://y/> ; CREATE GRAPH :z")
    before = store.quads().count()
    assert store.should_compact() and store.compact() == 1 and store.quads().count() == before and store.verify()
    assert store.collect_garbage()
    update(store, "DROP ALL")
    assert store.quads().count() == 0


def test_pipeline(spark, nq, tmp_path):
    s = Stream.read(spark, nq)
    assert (s.count(), s.distinct("subjects"), s.distinct("graphs"), s.distinct("predicates")) == (5, 3, 2, 2)
    rows = [("<a>", "<p>", '"1"', None), ("<a>", "<q>", '"2"', None), ("<b>", "<p>", '"3"', "<g>"), ("_:c", "<p>", '"4"', None), ("<a>", "<p>", '"5"', None), ("<a>", "<p>", '"1"', None)]
    s = Stream.of(spark.createDataFrame(rows, rdf.QUAD).coalesce(1))
    objects = lambda x: [r.o[1] for r in x.ordered().collect()]
    assert objects(s.skip(2)) == ["3", "4", "5", "1"] and objects(s.head(2)) == ["1", "2"] and objects(s.tail(2)) == ["5", "1"]
    assert objects(s.skip(1, "subjects")) == ["3", "4", "5", "1"] and objects(s.head(2, "subjects")) == ["1", "2", "3"] and objects(s.tail(1, "subjects")) == ["5", "1"]
    assert objects(s.tree()) == ["1", "5", "2", "4", "3"]
    assert Stream.concat(s.head(1), s.tail(1)).count() == 2 and objects(Stream.concat(s.head(1), s.skip(4).head(1))) == ["1", "5"]
    assert run(spark, ["read", nq, "/", "head", "3", "/", "count"]) == 3
    with pytest.raises(ValueError):
        run(spark, ["read", nq, "/", "filter", "x"])


@pytest.mark.parametrize("text", ["SELECT * { ?s ?p }", "SELECT ?x (1 AS ?x) {}", "SELECT * { BIND(1 AS ?x) BIND(2 AS ?x) }", "SELECT ?a { ?a ?b ?c } GROUP BY ?b", "SELECT * { ?s ?p ?o } LIMIT 1 LIMIT 2", "SELECT * { VALUES (?a ?b) { (1) } }", "SELECT (STR() AS ?x) {}", "SELECT * { x:y ?p ?o }", "SELECT * { _:a ?p ?o OPTIONAL { ?s ?p ?o } _:a ?q ?r }"])
def test_rejected_queries(text):
    with pytest.raises(SparqlError):
        parse_query(text)


@pytest.mark.parametrize("text", ["INSERT DATA { ?s <http://x/p> 1 }", "DELETE DATA { _:b <http://x/p> 1 }", "INSERT DATA { <http://x/s> <http://x/p>+ 1 }"])
def test_rejected_updates(text):
    with pytest.raises(SparqlError):
        parse_update(text)

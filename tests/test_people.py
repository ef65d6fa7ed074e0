"""End-to-end queries over a small graph with a named graph."""

import pytest

from tessera.engine import from_quads, query

INT = "^^<http://www.w3.org/2001/XMLSchema#integer>"


def x(s):
    return f"<http://x/{s}>"


PEOPLE = [
    (x("alice"), x("knows"), x("bob"), None), (x("alice"), x("age"), '"30"' + INT, None), (x("alice"), x("name"), '"Alice"', None), (x("alice"), x("likes"), x("carol"), None),
    (x("bob"), x("knows"), x("carol"), None), (x("bob"), x("age"), '"25"' + INT, None), (x("bob"), x("name"), '"Bob"@en', None), (x("carol"), x("age"), '"35"' + INT, None),
    (x("carol"), x("name"), '"Carol"', None), (x("dave"), x("knows"), x("alice"), x("g1")), (x("dave"), x("age"), '"40"' + INT, x("g1")),
]


@pytest.fixture(scope="module")
def people(spark):
    return from_quads(spark, PEOPLE)


def rows(people, text):
    out = []
    for r in query(people, "PREFIX : <http://x/> " + text).df.collect():
        out.append(tuple(None if c is None else str(c).replace("<http://x/", "").replace(">", "") if str(c).startswith("<") else str(c).removeprefix("http://x/") for c in r))
    return sorted(out, key=str)


CASES = {
    "join": ("SELECT ?x ?a { :alice :knows ?x . ?x :age ?a }", [("bob", '"25"' + INT)]),
    "filter": ("SELECT ?s { ?s :age ?a FILTER(?a > 28 && ?a < 36) }", [("alice",), ("carol",)]),
    "arithmetic": ("SELECT ?s { ?s :age ?a FILTER(?a + 5 = 30) }", [("bob",)]),
    "optional": ("SELECT ?s ?y { ?s :age ?a OPTIONAL { ?s :knows ?y } }", [("alice", "bob"), ("bob", "carol"), ("carol", None)]),
    "optional filter": ("SELECT ?s ?y { ?s :age ?a OPTIONAL { ?s :knows ?y FILTER(?a > 28) } }", [("alice", "bob"), ("bob", None), ("carol", None)]),
    "union": ("SELECT ?s { { ?s :knows :bob } UNION { ?s :knows :carol } }", [("alice",), ("bob",)]),
    "minus": ("SELECT ?s { ?s :age ?a MINUS { ?s :knows ?y } }", [("carol",)]),
    "minus disjoint": ("SELECT ?s { ?s :age ?a MINUS { ?p :knows ?q } }", [("alice",), ("bob",), ("carol",)]),
    "bind": ("SELECT ?d { :bob :age ?a BIND(?a * 2 AS ?d) }", [('"50"' + INT,)]),
    "bind error": ("SELECT ?d { :bob :name ?a BIND(?a * 2 AS ?d) }", [(None,)]),
    "values": ("SELECT ?s { VALUES ?s { :bob :nobody } ?s :age ?a }", [("bob",)]),
    "values undef": ("SELECT ?s ?a { ?s :age ?a VALUES (?s ?a) { (:bob UNDEF) (UNDEF 35) } }", [("bob", '"25"' + INT), ("carol", '"35"' + INT)]),
    "regex": ('SELECT ?s { ?s :name ?n FILTER REGEX(STR(?n), "^[AC]") }', [("alice",), ("carol",)]),
    "ucase": ("SELECT (UCASE(?n) AS ?u) { :alice :name ?n }", [('"ALICE"',)]),
    "lang": ('SELECT ?s { ?s :name ?n FILTER(LANG(?n) = "en") }', [("bob",)]),
    "count": ("SELECT (COUNT(*) AS ?n) (AVG(?a) AS ?m) { ?s :age ?a }", [("3", '"30.0"^^<http://www.w3.org/2001/XMLSchema#decimal>')]),
    "group": ("SELECT ?s (COUNT(?y) AS ?n) { ?s :knows ?y } GROUP BY ?s", [("alice", "1"), ("bob", "1")]),
    "having": ("SELECT ?s { ?s ?p ?o } GROUP BY ?s HAVING (COUNT(*) > 3)", [("alice",)]),
    "concat": ('SELECT (GROUP_CONCAT(?n; SEPARATOR="|") AS ?c) { ?s :name ?n }', [("Alice|Bob|Carol",)]),
    "order": ("SELECT ?a { ?s :age ?a } ORDER BY DESC(?a) LIMIT 2", [('"30"' + INT,), ('"35"' + INT,)]),
    "distinct": ("SELECT DISTINCT ?p { ?s ?p ?o }", [("age",), ("knows",), ("likes",), ("name",)]),
    "graph": ("SELECT ?s { GRAPH :g1 { ?s :knows ?o } }", [("dave",)]),
    "graph var": ("SELECT ?g ?s { GRAPH ?g { ?s :knows ?o . ?s :age ?a } }", [("g1", "dave")]),
    "graph empty": ("SELECT ?g { GRAPH ?g {} }", [("g1",)]),
    "graph agg": ("SELECT ?g ?n { GRAPH ?g { SELECT (COUNT(*) AS ?n) { ?s ?p ?o } } }", [("g1", "2")]),
    "from": ("SELECT ?s FROM :g1 { ?s :knows ?o }", [("dave",)]),
    "plus": ("SELECT ?x { :alice :knows+ ?x }", [("bob",), ("carol",)]),
    "star": ("SELECT ?x { :alice :knows* ?x }", [("alice",), ("bob",), ("carol",)]),
    "plus to": ("SELECT ?x { ?x :knows+ :carol }", [("alice",), ("bob",)]),
    "star absent": ("SELECT ?x { :ghost :knows* ?x }", [("ghost",)]),
    "seq": ("SELECT ?n { :alice :knows/:name ?n }", [('"Bob"@en',)]),
    "inverse": ("SELECT ?x { :carol ^:knows ?x }", [("bob",)]),
    "alt": ("SELECT ?x { :alice :knows|:likes ?x }", [("bob",), ("carol",)]),
    "optional step": ("SELECT ?x { :alice :knows? ?x }", [("alice",), ("bob",)]),
    "negated": ("SELECT ?o { :alice !(:knows|:age|:name) ?o }", [("carol",)]),
    "exists": ("SELECT ?s { ?s :age ?a FILTER EXISTS { ?s :knows ?y } }", [("alice",), ("bob",)]),
    "not exists": ("SELECT ?s { ?s :age ?a FILTER NOT EXISTS { ?s :knows ?y } }", [("carol",)]),
    "exists or": ("SELECT ?s { ?s :age ?a FILTER(?a = 35 || EXISTS { ?s :likes ?y }) }", [("alice",), ("carol",)]),
    "exists outer": ("SELECT ?s { ?s :age ?a FILTER EXISTS { ?t :age ?b FILTER(?b > ?a + 7) } }", [("bob",)]),
    "subselect": ("SELECT ?s ?m { { SELECT (MAX(?a) AS ?m) { ?x :age ?a } } ?s :knows ?y }", [("alice", '"35"' + INT), ("bob", '"35"' + INT)]),
    "maybe unbound": ("SELECT ?s ?y { ?s :name ?n OPTIONAL { ?s :likes ?y } { ?s :age ?a OPTIONAL { ?s :knows ?y } } }", [("bob", "carol"), ("carol", None)]),
    "in": ("SELECT ?s { ?s :age ?a FILTER(?a IN (25, 35)) }", [("bob",), ("carol",)]),
    "not in error": ('SELECT ?s { ?s :age ?a FILTER(?a NOT IN (25, "x"/2)) }', []),
    "coalesce": ('SELECT ?s (COALESCE(?y, "none") AS ?c) { ?s :age ?a OPTIONAL { ?s :likes ?y } }', [("alice", "carol"), ("bob", '"none"'), ("carol", '"none"')]),
    "if": ('SELECT ?s (IF(?a > 28, "old", "young") AS ?c) { ?s :age ?a }', [("alice", "old"), ("bob", "young"), ("carol", "old")]),
    "repeated var": ("SELECT ?x { ?x ?p ?x }", []),
    "triple term": ("SELECT ?t { BIND(TRIPLE(:a, :b, 1) AS ?u) BIND(OBJECT(?u) AS ?t) }", [('"1"' + INT,)]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(people, name):
    text, want = CASES[name]
    assert rows(people, text) == sorted(want, key=str)


def test_ask(people):
    assert query(people, "ASK { <http://x/alice> <http://x/age> ?a }").answer
    assert not query(people, "ASK { <http://x/dave> <http://x/age> ?a }").answer


def test_construct_and_describe(people):
    p = "PREFIX : <http://x/> "
    assert query(people, p + "CONSTRUCT { ?y :knownBy ?x } WHERE { ?x :knows ?y }").df.count() == 2
    assert query(people, p + "CONSTRUCT { [] :of ?x ; :n 1 } WHERE { ?x :knows ?y }").df.count() == 4
    assert query(people, p + "DESCRIBE :alice").df.count() == 4
    assert query(people, p + "DESCRIBE ?w { :alice :knows ?w }").df.count() == 3

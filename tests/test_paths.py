"""Paths whose ends other patterns bind: the same solutions by hand, and no more read than they need."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.engine import from_quads, query
from tessera.sources.dataset import Table, Tables

X, DBL = "http://x/", "^^<http://www.w3.org/2001/XMLSchema#double>"
ROWS = [
    *((f"<{X}{s}>", f"<{X}{p}>", f"<{X}{o}>") for s, p, o in ("apb", "bpc", "cpa", "cqd", "dqe", "eqe", "apd", "fqa")),
    *((f"<{X}{s}>", f"<{X}k>", f'"{v}"{DBL}') for s, v in (("a", "0.0"), ("b", "-0.0"), ("c", "1.5"), ("e", "1.5"))),
]
P, Q = ("link", f"<{X}p>"), ("link", f"<{X}q>")
#: A path's text, and what it is.
PATHS = {
    ":p?": ("opt", P), ":p*": ("star", P), "(:p/:q?)?": ("opt", ("seq", P, ("opt", Q))), "(:p?/^:q?)+": ("plus", ("seq", ("opt", P), ("inv", ("opt", Q)))),
    "!(:p|^:q)": ("nps", [P[1]], [Q[1]]), "(:q|:p?)": ("alt", Q, ("opt", P)), "(:q?/:p)": ("seq", ("opt", Q), P), "(:p?|!:q)*": ("star", ("alt", ("opt", P), ("nps", [Q[1]], None))),
}


def related(p):
    k = p[0]
    nodes = {(n, n) for s, _, o in ROWS for n in (s, o)}
    if k == "link":
        return {(s, o) for s, q, o in ROWS if q == p[1]}
    if k == "inv":
        return {(b, a) for a, b in related(p[1])}
    if k == "seq":
        return {(a, d) for a, b in related(p[1]) for c, d in related(p[2]) if b == c}
    if k == "alt":
        return related(p[1]) | related(p[2])
    if k == "nps":
        return {(s, o) for s, q, o in ROWS if q not in p[1]} | {(o, s) for s, q, o in ROWS if p[2] is not None and q not in p[2]}
    if k == "opt":
        return related(p[1]) | nodes
    out = related(p[1]) | (nodes if k == "star" else set())
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


KEYED = {(s, o) for s, p, o in ROWS if p == f"<{X}k>"}
VALUES = {f"<{X}absent>", f"<{X}a>", f"<{X}e>", f'"-0.0"{DBL}'}
BIG = {k for k in KEYED if k[1].startswith('"1.5"')}
#: A group with PATH, and its solutions of ?x and ?y by hand from the pairs of the path.
AROUND = {
    "?x :k ?v . ?x PATH ?y": lambda r: {(x, y) for x, y in r if x in {k for k, _ in KEYED}},
    "?x PATH ?y . ?y :k ?v": lambda r: {(x, y) for x, y in r if y in {k for k, _ in KEYED}},
    "?z :k ?x . ?x PATH ?y": lambda r: {(x, y) for x, y in r if x in {v for _, v in KEYED}},
    "?x :k ?v . ?x PATH ?y . ?y :k ?w": lambda r: {(x, y) for x, y in r if {x, y} <= {k for k, _ in KEYED}},
    f"?x PATH ?y VALUES ?x {{ :absent :a :e '-0.0'{DBL} }}": lambda r: {(x, y) for x, y in r if x in VALUES},
    "?x :k ?v OPTIONAL { ?x PATH ?y FILTER(?y != ?x) }": lambda r: {(x, y) for x, y in r if x in {k for k, _ in KEYED} and x != y} | {(k, None) for k, _ in KEYED if not any(x == k and x != y for x, y in r)},
    "?x :k ?y MINUS { ?x PATH :a }": lambda r: {(x, y) for x, y in KEYED if (x, f"<{X}a>") not in r},
    "?x :k ?v { { ?x PATH ?y } UNION { ?x :k ?y } }": lambda r: {(x, y) for x, y in r if x in {k for k, _ in KEYED}} | KEYED,
    f"?x :k '1.5'{DBL} {{ OPTIONAL {{ ?x PATH ?y }} }}": lambda r: {(x, y) for x, y in r if x in {k for k, _ in BIG}},
    "BIND(IF(RAND() < 2, :a, :b) AS ?x) ?x PATH ?y": lambda r: {(x, y) for x, y in r if x == f"<{X}a>"},
    "{ SELECT ?x { ?x :k ?v } ORDER BY ?x LIMIT 1 } ?x PATH ?y": lambda r: {(x, y) for x, y in r if x == f"<{X}a>"},
    "?x PATH ?x BIND(?x AS ?y)": lambda r: {(x, y) for x, y in r if x == y},
    ":a PATH ?y BIND(:a AS ?x)": lambda r: {(x, y) for x, y in r if x == f"<{X}a>"},
    "GRAPH ?g { ?x :k ?v . ?x PATH ?y }": lambda r: {(x, y) for x, y in r if x in {k for k, _ in KEYED}},
}


def got(spark, path, around):
    d = from_quads(spark, [(*r, f"<{X}g>" if around.startswith("GRAPH") else None) for r in ROWS])
    rows = query(d, f"PREFIX : <{X}> SELECT DISTINCT ?x ?y {{ {around.replace('PATH', path)} }}").df.collect()
    return {tuple(f"<{v}>" if v is not None and v.startswith("http") else v for v in r) for r in rows}


@pytest.mark.parametrize(("path", "around"), [(p, a) for (i, p), (j, a) in itertools.product(enumerate(PATHS), enumerate(AROUND)) if (i + j) % 8 == 0])
def test_paths_beside_other_patterns(spark, path, around):
    assert got(spark, path, around) == AROUND[around](related(PATHS[path]))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.range(9).selectExpr("id AS a_key", "id % 3 AS b_key", "concat('n', id) AS a_name").write.parquet(f"{at}/a")
    spark.range(3).selectExpr("id AS b_key").write.parquet(f"{at}/b")
    spark.range(50).selectExpr("id AS other_key", "concat('t', id) AS other_text").write.parquet(f"{at}/other")
    own = [Table("a", F.col("a_key"), "urn:t:a/", {"b_key": "b"}), Table("b", F.col("b_key"), "urn:t:b/", {}), Table("other", F.col("other_key"), "urn:t:other/", {})]
    return Tables(spark, lambda name: spark.read.parquet(f"{at}/{name}"), own)


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("?x <urn:t:b#b_key> ?k . ?x <urn:t:a#ref-b_key>* ?y", 3),
        ("?x <urn:t:a#a_key> 7 . ?x <urn:t:a#ref-b_key>? ?y", 2),
        ("?x <urn:t:a#a_key> ?k . ?x (<urn:t:a#ref-b_key>/^<urn:t:a#ref-b_key>)? ?y . ?y <urn:t:b#b_key> ?b", 0),
        ("?x <urn:t:a#a_key> ?k . ?x !(<urn:t:a#a_key>|<urn:t:a#a_name>) ?y", 18),
        ("?x <urn:t:b#b_key> ?k . ?x !(^<urn:t:a#a_key>) ?y", 9),
        ("<urn:t:b/1> !(^<urn:t:a#a_key>) ?y", 3),
        ("?x !<urn:t:a#a_key> <urn:t:b/1>", 3),
    ],
)
def test_tables_that_no_bound_end_can_be_in_are_not_read(tables, text, n):
    out = query(tables, f"SELECT * {{ {text} }}").df
    assert out.count() == n and not [f for f in out.inputFiles() if "/other/" in f]


def test_bound_ends_are_looked_up_and_nodes_not_gathered(tables):
    out = query(tables, "SELECT * { VALUES ?x { <urn:x:absent> <urn:t:b/1> <urn:t:b/01> <urn:t:b/9> } ?x <urn:t:a#ref-b_key>* ?y }").df
    assert [tuple(r) for r in out.collect()] == [("<urn:t:b/1>", "<urn:t:b/1>")]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()

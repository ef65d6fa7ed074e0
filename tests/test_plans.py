"""Plans and results of solutions whose shared variables may be unbound, patterns from data, VALUES, readers and writers."""

import itertools
import random

import pytest

from tessera.engine import from_quads, query
from tessera.sources import rdf

P = [f"<http://x/p{i}>" for i in range(4)]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(4)
    rows = {(f"<http://x/s{r.randrange(9)}>", r.choice(P), f'"{r.randrange(4)}"^^<http://www.w3.org/2001/XMLSchema#integer>', None) for _ in range(40)}
    return from_quads(spark, sorted(rows, key=str)), {(s, p, o) for s, p, o, _ in rows}


def side(rows, i):
    """{ ?s pi ?a OPTIONAL { ?s pj ?b } } by hand."""
    out = []
    for s, p, a in rows:
        if p == P[i]:
            own = [o for s2, p2, o in rows if s2 == s and p2 == P[i + 1]]
            out += [{"s": s, "a": a, "b": b} for b in own] or [{"s": s, "a": a}]
    return out


def compatible(m, n):
    return all(m[v] == n[v] for v in m.keys() & n.keys())


LEFT = "{ ?s <http://x/p0> ?a OPTIONAL { ?s <http://x/p1> ?b } }"
RIGHT = "{ ?t <http://x/p2> ?c OPTIONAL { ?t <http://x/p3> ?b } }"


def right(rows):
    return [{"t": m["s"], "c": m["a"]} | ({"b": m["b"]} if "b" in m else {}) for m in side(rows, 2)]


def answers(out, names):
    rows = out.df.select(*names).collect()
    return sorted((tuple(None if r[v] is None else str(r[v]).split("^")[0].strip('"<>') for v in names) for r in rows), key=str)


def expected(maps, names):
    return sorted((tuple(None if m.get(v) is None else m[v].split("^")[0].strip('"<>') for v in names) for m in maps), key=str)


def no_loops(out):
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


def test_minus(data):
    d, rows = data
    out = query(d, f"SELECT * {{ {LEFT} MINUS {RIGHT} }}")
    want = [m for m in side(rows, 0) if not any(compatible(m, n) and m.keys() & n.keys() for n in right(rows))]
    assert answers(out, ["s", "a", "b"]) == expected(want, ["s", "a", "b"]) and no_loops(out)


def test_optional(data):
    d, rows = data
    for condition, test in (("", lambda m: True), ("FILTER(?c > ?a)", lambda m: m["c"] > m["a"]), ("FILTER(?b > 1)", lambda m: "b" in m and int(m["b"][1]) > 1)):
        out = query(d, f"SELECT * {{ {LEFT} OPTIONAL {{ {RIGHT[1:-1]} {condition} }} }}")
        want = []
        for m in side(rows, 0):
            want += [m | n for n in right(rows) if compatible(m, n) and test(m | n)] or [m]
        assert answers(out, ["s", "a", "b", "t", "c"]) == expected(want, ["s", "a", "b", "t", "c"]), condition


@pytest.mark.parametrize("no", ["", "NOT "])
def test_exists(data, no):
    d, rows = data
    out = query(d, f"SELECT * {{ {LEFT} FILTER {no}EXISTS {RIGHT} }}")
    want = [m for m in side(rows, 0) if any(compatible(m, n) for n in right(rows)) != bool(no)]
    assert answers(out, ["s", "a", "b"]) == expected(want, ["s", "a", "b"])


def ungrouped_products(plan):
    """Joins without a condition of an optimized plan, of which a side isn't grouped."""
    sides = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.nodeName() == "Join" and plan.condition().isEmpty() and not all("Aggregate" in x.toString() for x in sides)
    return own + sum(map(ungrouped_products, sides))


AGGREGATES = {"n": ("COUNT(*)", len), "k": ("COUNT(?c)", lambda ms: sum("c" in m for m in ms)), "x": ("SUM(?c)", lambda ms: sum(int(m["c"][1]) for m in ms)), "y": ("SUM(?a)", lambda ms: sum(int(m["a"][1]) for m in ms)), "lo": ("MIN(?c)", lambda ms: min(int(m["c"][1]) for m in ms))}


@pytest.mark.parametrize("by", ["s", "b", "t", "s t", ""])
def test_aggregates_of_a_join_group_its_sides_first(data, by):
    d, rows = data
    items = " ".join(f"({f} AS ?{v})" for v, (f, _) in AGGREGATES.items())
    for left, own in ((LEFT, side(rows, 0)), ("{ ?s <http://x/p0> ?a OPTIONAL { ?s <http://x/none> ?b } }", [{k: v for k, v in m.items() if k != "b"} for m in side([r for r in rows if r[1] != P[1]], 0)])):
        out = query(d, f"SELECT {' '.join('?' + v for v in by.split())} {items} {{ {left} {RIGHT} }}" + (f" GROUP BY {' '.join('?' + v for v in by.split())}" if by else ""))
        groups = {}
        for m, n in itertools.product(own, right(rows)):
            if compatible(m, n):
                groups.setdefault(tuple((m | n).get(v) for v in by.split()), []).append(m | n)
        want = [(*k, *(f(ms) for _, f in AGGREGATES.values())) for k, ms in groups.items()]
        clean = lambda r: tuple(None if x is None else str(x).split("^")[0].strip('"<>') for x in r)
        assert sorted(map(clean, out.df.collect()), key=str) == sorted(map(clean, want), key=str)
        assert not ungrouped_products(out.df._jdf.queryExecution().optimizedPlan())


def test_aggregates_of_a_product_of_decimals(spark):
    dec = "^^<http://www.w3.org/2001/XMLSchema#decimal>"
    d = from_quads(spark, [(f"<http://x/{i}>", "<http://x/p>", f'"{v}"{dec}', None) for i, v in enumerate(("0.1", "2.5", "-1.25"))])
    r = query(d, "SELECT (SUM(?a) AS ?s) (AVG(?b) AS ?m) (COUNT(*) AS ?n) { { ?x <http://x/p> ?a } { ?y <http://x/p> ?b } }").df.first()
    assert r.s.startswith('"4.05"') and r.m.startswith('"0.45"') and r.n == 9


def test_patterns_from_data(spark):
    d = from_quads(spark, [("<http://x/a>", "<http://x/p>", f'"{p}"', None) for p in ("a.c", "(", "(?=a)", "[z]", "^A", "(a)(b)", "\\\\\\\\1")])
    got = {r["q"]: (r["plain"], r["any"], r["to"]) for r in query(d, 'SELECT (STR(?p) AS ?q) (REGEX("abc", ?p) AS ?plain) (REGEX("abc", ?p, IF(STR(?p) = "^A", "i", "")) AS ?any) (REPLACE("abc", ?p, "<$2$1$9>") AS ?to) { ?s <http://x/p> ?p }').df.collect()}
    assert got["a.c"] == (True, True, "<>") and got["("] == (None, None, None) and got["(?=a)"] == (None, None, None)
    assert got["[z]"] == (False, False, "abc") and got["^A"] == (False, True, "abc") and got["(a)(b)"] == (True, True, "<ba>c")


def test_trailing_values(spark):
    d = from_quads(spark, [("<http://x/a>", "<http://x/p>", '"v"', None)])
    assert sorted(r.y for r in query(d, "SELECT (?x + 1 AS ?y) {} VALUES ?x { 1 2 }").df.collect()) == [2, 3]
    assert [(r.s is not None, r.x) for r in query(d, "SELECT * { ?s <http://x/p> ?o } VALUES ?x { 7 }").df.collect()] == [(True, 7)]


TERMS = ['"plain"', '"q\\"uo\\\\te\\n"', '"tag"@en-gb', '"dir"@ar--rtl', '"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"a <b> c"', '"x <http://x/y>"', "<http://x/o>", "_:b", '"é \U0001f600 &<>"']


@pytest.mark.parametrize("syntax", ["nt", "nq", "ttl", "trig", "rdfxml", "jsonld"])
def test_written_terms_read_back(spark, tmp_path, syntax):
    graphs = syntax in ("nq", "trig", "jsonld")
    rows = [(s, p, o, g) for s, p, (o, g) in itertools.product(["<http://x/a>", "_:n"], ["<http://x/p>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#value>"], itertools.product(TERMS, [None, "<http://x/g>"] if graphs else [None]))]
    rows = [r for r in rows if syntax not in ("rdfxml", "jsonld") or "--" not in r[2]]  # which have no directions
    q = spark.createDataFrame(rows, rdf.QUAD)
    path = f"file://{tmp_path}/{syntax}"
    rdf.write(q.coalesce(1), path, syntax, prefixes={"x": "http://x/"})
    clean = lambda rs: sorted((tuple(None if x is None else "_:" if x.startswith("_:") else x for x in r) for r in rs), key=str)
    assert clean(map(tuple, rdf.read(spark, path, syntax).collect())) == clean(rows)
    assert rdf.read(spark, f"file://{tmp_path}/{syntax}", syntax).where("s = '_:n'").count() == 0  # labels are the file's own


def test_lines_of_every_form(spark, tmp_path):
    """Lines that the pattern takes and lines that the parser takes give the same keys."""
    lines = [f"<http://x/a> <http://x/p> {o} {g}." for o in (*TERMS, '"up"@EN-GB', '"s"^^<http://www.w3.org/2001/XMLSchema#string>', "<<( <http://x/a> <http://x/p> 1 )>>".replace("1", '"1"')) for g in ("", "<http://x/g> ", "_:g ")]
    (tmp_path / "a.nq").write_text("\n".join(lines) + "\n# end\n\n")
    (tmp_path / "b.nq").write_text("\n".join("  " + x.replace("<http://x/p> ", "<http://x/p>\t").replace(" .", "\t.") for x in lines))
    a, b = ([tuple("_:" if x and x.startswith("_:") else x for x in r) for r in rdf.read(spark, f"file://{tmp_path}/{n}.nq").collect()] for n in "ab")
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == len(lines)

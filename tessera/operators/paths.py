"""Property paths that need sets of nodes: closures, optional steps and negated property sets.

A closure is a semi-naive iteration: each round joins the newest pairs with the edges and keeps what is not known yet; the
rounds are written to the shared folder. A constant end seeds the iteration, so that only what it reaches is visited.

Zero-length paths and negated sets are over the whole graph only where nothing else binds an end of the path: else the terms
that it is bound to, a `Seed`, are written and looked up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import functions as F

from tessera.functions.values import key_py
from tessera.plans.parser import term_vars
from tessera.plans.session import written

from .relation import TERM, Rel, Rep, column, disjoint, join, name_of, union, unified


def nullable(p) -> bool:
    k = p[0]
    if k in ("star", "opt"):
        return True
    if k in ("inv", "plus"):
        return nullable(p[1])
    if k == "seq":
        return nullable(p[1]) and nullable(p[2])
    if k == "alt":
        return nullable(p[1]) or nullable(p[2])
    return False


def inverse(p):
    k = p[0]
    if k == "link":
        return ("inv", p)
    if k == "inv":
        return p[1]
    if k == "seq":
        return ("seq", inverse(p[2]), inverse(p[1]))
    if k == "nps":
        return ("nps", [(i, not v) for i, v in p[1]])
    return (k, *map(inverse, p[1:]))


def stripped(p):
    """A path of the same closure p* that adds no zero-length paths of its own."""
    k = p[0]
    if k in ("star", "plus", "opt"):
        return stripped(p[1])
    if k == "inv":
        return ("inv", stripped(p[1]))
    if k == "alt" or k == "seq" and nullable(p):
        return ("alt", stripped(p[1]), stripped(p[2]))
    return p


def plain(p):
    """A path of the same pairs whose outermost operator has no nullable operand."""
    if p[0] in ("star", "plus"):
        return ("star" if nullable(p) or nullable(p[1]) else "plus", stripped(p[1]))
    return plain(p[1]) if p[0] == "opt" and nullable(p[1]) else p


class Seed:
    """The terms that other patterns bind an end of a path to. nodes: whether they are nodes of the path's graph for certain."""

    def __init__(self, rel: Rel, var: str, extra, nodes: bool):
        r = rel.keep([var, *(g for g in extra if g in rel.reps)]).renamed({var: "n"})
        self.source = r.as_terms(["n"]) if r.reps["n"].kind in ("flt", "dbl") else r  # 0.0 and -0.0 are two terms
        self.nodes = nodes and all(g in r.reps for g in extra)

    @property
    def rep(self) -> Rep:
        return self.source.reps["n"]

    @cached_property
    def rel(self) -> Rel:
        return Rel(written(self.source.df.distinct()), self.source.reps, set(self.source.reps))


def _distinct(r: Rel) -> Rel:
    return Rel(r.df.distinct(), r.reps, r.certain)


def _swap(r: Rel, extra) -> Rel:
    return r.renamed({"a": "b", "b": "a"}).keep(["a", "b", *extra])


def pairs(p, data, graph, ends: dict | None = None) -> Rel:
    """The distinct (a, b) that a path relates. ends: for a or b a constant or a Seed; pairs of other ends may lack."""
    extra = [graph[1]] if isinstance(graph, tuple) else []
    ends, p = ends or {}, plain(p)
    k = p[0]
    if k == "link":
        return _distinct(data.bgp([(("var", "a"), p[1], ("var", "b"))], graph).keep(["a", "b", *extra]))
    if k == "inv":
        return _swap(pairs(p[1], data, graph, _turned(ends)), extra)
    if k == "seq":
        first, last = {e: x for e, x in ends.items() if e == "a"}, {e: x for e, x in ends.items() if e == "b"}
        if nullable(p[1]) and (not nullable(p[2]) or not first):
            y = pairs(p[2], data, graph, last)
            x = pairs(p[1], data, graph, {**first, "b": Seed(y, "a", extra, True)})
        else:
            x = pairs(p[1], data, graph, first)
            y = pairs(p[2], data, graph, {**last, "a": Seed(x, "b", extra, True)})
        return _distinct(join(x.renamed({"b": "m"}), y.renamed({"a": "m"})).keep(["a", "b", *extra]))
    if k == "alt":
        return _distinct(union(pairs(p[1], data, graph, ends), pairs(p[2], data, graph, ends)).keep(["a", "b", *extra]))
    if k == "nps":
        return negated(p[1], data, graph, extra, ends)
    if k == "opt":
        out = pairs(p[1], data, graph, ends)
    else:
        steps = pairs(p[1], data, graph)
        out = closure(steps, steps, extra, whole=True)
    same = identity(data, graph, extra, ends) if k != "plus" else None
    return out if same is None else _distinct(union(out, same))


def _turned(ends: dict) -> dict:
    return {"b" if e == "a" else "a": x for e, x in ends.items()}


def negated(items, data, graph, extra, ends) -> Rel:
    out = None
    forward, backward = [i for i, v in items if not v], [i for i, v in items if v]
    for iris, back in ((forward, False), (backward, True)):
        if iris or not items and not back:
            found = {e: x.rel if isinstance(x, Seed) else x for e, x in (_turned(ends) if back else ends).items()}
            r = data.links(iris, graph, found).keep(["a", "b", *extra])
            r = _swap(r, extra) if back else r
            out = r if out is None else union(out, r)
    return _distinct(out)


def identity(data, graph, extra, ends) -> Rel | None:
    """(n, n) of the nodes; of those of an end where there is one, and None where the ends can't be the same."""
    for x in ends.values():
        if isinstance(x, tuple):
            return _constant(x, data, graph, extra)
    seeds = list(ends.values())
    if len(seeds) == 2 and disjoint(seeds[0].rep, seeds[1].rep):
        return None
    sure = [x for x in seeds if x.nodes]
    n = sure[0].rel if sure else data.nodes(graph, "n", seeds[0].rel if seeds else None)
    n = n.renamed({"n": "a"})
    return Rel(n.df.withColumn(name_of("b"), column("a")), {**n.reps, "b": n.reps["a"]}, n.certain | {"b"}).keep(["a", "b", *extra])


COMPACT = 8


def closure(start: Rel, steps: Rel, extra, whole: bool = False) -> Rel:
    """start followed by any number of steps, distinct; whole: start is steps, so that lengths can double each round.

    The first 2**k steps of a shortest path of more than 2**k are a shortest path themselves, which round k found.
    """
    names = ["a", "b", *extra]
    steps, start = unified(steps, start, ["a", "b"])
    if steps.reps["a"] != steps.reps["b"]:
        steps, start = steps.as_terms(["a", "b"]), start.as_terms(["a", "b"])
    if start.reps["b"] != steps.reps["a"]:
        steps, start = steps.as_terms(["a", "b"]), start.as_terms(["a", "b"])
    cols = [name_of(v) for v in names]
    known = fresh = written(start.keep(names).df.distinct())
    edges = None if whole else written(steps.keep(names).df.distinct())
    rounds = 0
    while not fresh.isEmpty():
        # from a seed by a step; else what the last round found by all that is known, which doubles the length
        onward = (known if whole else edges).withColumnsRenamed({name_of("a"): "__m", name_of("b"): "__next", **{name_of(h): f"__{h}" for h in extra}})
        on = fresh[name_of("b")] == onward["__m"]
        for h in extra:
            on = on & (fresh[name_of(h)] == onward[f"`__{h}`"])
        step = fresh.join(onward, on).select(fresh[name_of("a")], F.col("__next").alias(name_of("b")), *(fresh[name_of(h)] for h in extra)).distinct()
        fresh = written(step.join(known, cols, "left_anti").select(*cols))
        known, rounds = known.union(fresh), rounds + 1
        if whole or rounds % COMPACT == 0:
            known = written(known)  # so that the next rounds read one table
    return Rel(known, {**start.reps}, set(names))


def solutions(s, p, o, data, graph, seed: Callable[[str], Seed | None] = lambda _: None) -> Rel:
    """The solutions of a path between two terms; seed: of a variable, all the terms that matter, or None for any."""
    extra = [graph[1]] if isinstance(graph, tuple) else []
    p = plain(p)
    if s[0] != "var" and o[0] == "var" and p[0] in ("star", "plus", "opt"):
        found = _from_constant(s, p, data, graph, extra)
    elif o[0] != "var" and s[0] == "var" and p[0] in ("star", "plus", "opt"):
        found = _swap(_from_constant(o, (p[0], inverse(p[1])), data, graph, extra), extra)
    else:
        ends = {e: x for e, t in (("a", s), ("b", o)) if (x := seed(t[1]) if t[0] == "var" else t)}
        found = pairs(p, data, graph, ends)
        for t in (s, o):
            if t[0] != "var" and nullable(p):  # a constant reaches itself, in the graph or not
                found = _distinct(union(found, _constant(t, data, graph, extra)))
    out = found
    for t, v in ((s, "a"), (o, "b")):
        if t[0] != "var":
            from tessera.functions.values import key

            out = out.where(key(out.val(v)) == F.lit(key_py(t)))
    if s[0] == "var" and o[0] == "var" and s[1] == o[1]:
        x, _ = unified(out, out, [])
        if x.reps["a"] != x.reps["b"]:
            x = x.as_terms(["a", "b"])
        return x.where(column("a") == column("b")).renamed({"a": s[1]}).keep([s[1], *extra])
    names = {**({"a": s[1]} if s[0] == "var" else {}), **({"b": o[1]} if o[0] == "var" else {})}
    return out.keep([*names, *extra]).renamed(names)


def _constant(t, data, graph, extra) -> Rel:
    k = key_py(t)
    if extra:
        g = data.named_graphs(extra[0])
        df = g.df.withColumns({name_of("a"): F.lit(k), name_of("b"): F.lit(k)})
        return Rel(df, {**g.reps, "a": TERM, "b": TERM}, {"a", "b", *extra}).keep(["a", "b", *extra])
    df = data.spark.range(1).select(F.lit(k).alias(name_of("a")), F.lit(k).alias(name_of("b")))
    return Rel(df, {"a": TERM, "b": TERM}, {"a", "b"})


def _from_constant(t, p, data, graph, extra) -> Rel:
    """(a, b) from one constant; a star and an optional step reach the constant itself too."""
    steps = pairs(p[1], data, graph, {"a": t} if p[0] == "opt" else None)
    rep = steps.reps["a"]
    if rep == steps.reps["b"] and rep.kind == "iri" and t[0] == "iri" and t[1].startswith(rep.prefix):
        local = F.lit(t[1][len(rep.prefix) :]).cast(steps.df.schema[name_of("a")].dataType)
        seed = steps.where(column("a") == local)
    else:
        steps = steps.as_terms(["a", "b"])
        seed = steps.where(column("a") == key_py(t))
    found = seed if p[0] == "opt" else closure(seed, steps, extra)
    return found if p[0] == "plus" else _distinct(union(found, _constant(t, data, graph, extra)))


__all__ = ["Rep", "Seed", "nullable", "pairs", "solutions", "term_vars"]

"""SPARQL groups and queries as lazy DataFrame plans."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import builtins
from tessera.functions.values import NULL, NUMBERS, Val, arithmetic, compare, const, ebv, key, key_py, lanes, negated, order_key
from tessera.plans.parser import SparqlError, ground, term_vars, visible_vars
from tessera.sources.dataset import Dataset, joined

from . import paths
from .aggregates import aggregated, factored
from .relation import TERM, Rel, Rep, column, flagged, join, left_join, minus, name_of, semi, union


class Unsupported(NotImplementedError):
    """SERVICE, which is parsed but not evaluated."""


@dataclass
class Env:
    """What holds for a whole query."""

    data: Dataset
    base: str | None = None
    now: str = ""
    nonce: str = ""
    graph: object = None  # None, an IRI, or ("var", hidden)
    seed: Rel | None = None  # outer solutions, for the filters of an EXISTS pattern

    @staticmethod
    def new(data: Dataset, base: str | None) -> Env:
        return Env(data, base, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), uuid.uuid4().hex)

    @property
    def hidden(self) -> list[str]:
        return [self.graph[1]] if isinstance(self.graph, tuple) else []


def unit(env: Env) -> Rel:
    """One empty solution; under GRAPH ?g one for each named graph."""
    if env.hidden:
        return env.data.named_graphs(env.hidden[0])
    return Rel(env.data.spark.range(1).select(), {}, set())


# -- expressions --


class Expressions:
    """Compiles expressions over one relation; EXISTS inside an expression adds flags to it."""

    def __init__(self, rel: Rel, env: Env, aggregates: dict | None = None):
        self.rel, self.env, self.aggregates = rel, env, aggregates or {}

    def row(self) -> Column:
        cols = [F.coalesce(key(self.rel.val(v)), F.lit("")) for v in self.rel.reps]
        return F.concat_ws("|", *cols) if cols else F.lit("")

    @property
    def base(self):
        return self.env.base

    @property
    def now(self):
        return self.env.now

    @property
    def nonce(self):
        return self.env.nonce

    def prepare(self, e) -> None:
        """Flags for the EXISTS of an expression, as a column each."""
        for x in exists_in(e):
            flag = f".x{len(self.rel.reps)}"
            found = exists_pattern(self.rel, x[2], self.env)
            self.rel = flagged(self.rel, found, flag)
            self.aggregates[id(x)] = flag

    def __call__(self, e) -> Val:
        k = e[0]
        if k == "var":
            return self.rel.val(e[1])
        if k in ("iri", "lit") or k == "triple" and ground(e):
            return const(e)
        if k == "triple":
            return builtins.call("TRIPLE", list(e[1:]), [self(x) for x in e[1:]], self)
        if k == "agg":
            return self.rel.val(self.aggregates[id(e)])
        if k == "exists":
            hit = column(self.aggregates[id(e)])
            return Val("bool", ~hit if e[1] else hit)
        if k in ("or", "and"):
            a, b = ebv(self(e[1])), ebv(self(e[2]))
            return Val("bool", a | b if k == "or" else a & b)
        if k == "not":
            return Val("bool", ~ebv(self(e[1])))
        if k == "cmp":
            return Val("bool", compare(e[1], self(e[2]), self(e[3])))
        if k == "in":
            a = self(e[2])
            hits = [compare("=", a, self(x)) for x in e[3]]
            out = F.lit(False)
            for h in hits:
                out = out | h
            return Val("bool", ~out if e[1] else out)
        if k == "arith":
            return arithmetic(e[1], self(e[2]), self(e[3]))
        if k == "neg":
            return negated(self(e[1]))
        if k == "pos":
            v = self(e[1])
            return v if v.kind in NUMBERS else Val("term", F.when(lanes(v.col)["rank"].isNotNull(), v.col)) if v.kind == "term" else NULL
        if k == "fn":
            return builtins.function(e[1], [self(x) for x in e[2]])
        if k == "call":
            name, args = e[1], e[2]
            if name == "BOUND":
                v = self.rel.val(args[0][1])
                return Val("bool", F.lit(False) if v.kind == "null" else (v.ts if v.ts is not None else v.col).isNotNull())
            if name == "COALESCE":
                return builtins.coalesced([self(x) for x in args])
            if name == "IF":
                c = ebv(self(args[0]))
                out = builtins.merged(c, self(args[1]), self(args[2]))
                return NULL if out.kind == "null" else builtins._when(c.isNotNull(), out)
            vals = [self(x) for x in args]
            if any(v.kind == "null" for v in vals):
                return NULL
            return builtins.call(name, args, vals, self)
        raise SparqlError(f"expression {k}")


def exists_in(e) -> list:
    if not isinstance(e, (tuple, list)):
        return []
    if isinstance(e, tuple) and e and e[0] == "exists":
        return [e]
    return [x for part in e if isinstance(part, (tuple, list)) for x in exists_in(part)]


def expression_vars(e) -> set[str]:
    if not isinstance(e, (tuple, list)):
        return set()
    if isinstance(e, tuple) and e and e[0] == "var":
        return {e[1]}
    if isinstance(e, tuple) and e and e[0] == "exists":
        return set()
    return set().union(*(expression_vars(x) for x in e)) if e else set()


def exists_pattern(rel: Rel, group, env: Env) -> Rel:
    """The solutions of an EXISTS pattern; its filters see the outer row's variables."""
    seed = Rel(rel.df.distinct(), rel.reps, rel.certain) if outer_filters(group) & rel.reps.keys() else None
    if seed is not None and env.seed is not None:
        seed = join(seed, env.seed)
    return compile_group(group, replace(env, seed=seed or env.seed))


def outer_filters(group) -> set[str]:
    """Variables that a group's filters and assignments use and its patterns don't bind."""
    bound, used = visible_vars(group), set()
    for e in group:
        if e[0] == "filter":
            used |= expression_vars(e[1])
            used |= set().union(*[outer_filters(x[2]) for x in exists_in(e[1])], set())
        elif e[0] == "bind":
            used |= expression_vars(e[1])
        elif e[0] in ("optional", "minus", "group"):
            used |= outer_filters(e[1])
        elif e[0] == "union":
            used |= set().union(*map(outer_filters, e[1]))
        elif e[0] == "graph":
            used |= outer_filters(e[2])
    return used - bound


def seeded(rel: Rel, wanted: set[str], env: Env) -> Rel:
    """rel with the outer variables that an expression wants and it lacks."""
    if env.seed is None or not (wanted - rel.reps.keys()) & env.seed.reps.keys():
        return rel
    names = [v for v in env.seed.reps if v in rel.reps or v in wanted]
    seed = env.seed.keep(names)
    return join(rel, Rel(seed.df.distinct(), seed.reps, seed.certain))


def filtered(rel: Rel, e, env: Env) -> Rel:
    if e[0] == "and" and exists_in(e):
        return filtered(filtered(rel, e[1], env), e[2], env)
    if e[0] == "not" and e[1][0] == "exists":
        e = ("exists", not e[1][1], e[1][2])
    if e[0] == "exists":
        return semi(rel, exists_pattern(rel, e[2], env), e[1])
    rel = seeded(rel, expression_vars(e), env)
    names = list(rel.reps)
    x = Expressions(rel, env)
    x.prepare(e)
    out = x.rel.where(F.coalesce(ebv(x(e)), F.lit(False)))
    return out.keep(names) if len(x.rel.reps) > len(names) else out


def bound(rel: Rel, e, var: str, env: Env) -> Rel:
    rel = seeded(rel, expression_vars(e), env)
    names = [*rel.reps, var]
    x = Expressions(rel, env)
    x.prepare(e)
    out = x.rel.extend(var, x(e))
    return out.keep(names) if len(out.reps) > len(names) else out


# -- groups --


JOINED = ("triples", "group", "union", "graph", "values", "subselect")
VOLATILE = ("RAND", "UUID", "STRUUID", "BNODE")


def mentions(e, test) -> bool:
    """Whether any tuple or query in a syntax tree passes a test."""
    if isinstance(e, dict):
        return test(e) or any(mentions(x, test) for x in e.values())
    return isinstance(e, (tuple, list)) and (isinstance(e, tuple) and bool(e) and test(e) or any(mentions(x, test) for x in e))


def is_volatile(e) -> bool:
    return isinstance(e, tuple) and len(e) > 1 and e[0] == "call" and e[1] in VOLATILE


def is_unsettled(e) -> bool:
    """What may differ when it is evaluated again."""
    return is_volatile(e) or isinstance(e, tuple) and e[0] == "agg" or isinstance(e, dict) and (e.get("limit") is not None or bool(e.get("offset")))


def is_path(e) -> bool:
    return isinstance(e, tuple) and e[0] in ("star", "plus", "opt", "nps")


def paths_last(group) -> list:
    """A group whose patterns with paths stand after what they are joined with."""
    out, run = [], []
    for e in [*group, None]:
        if e is not None and (e[0] in JOINED or e[0] == "filter"):
            run.append(e)
            continue
        out += sorted(run, key=lambda x: x[0] == "triples" and mentions(x, is_path))
        out, run = [*out, *([e] if e is not None else [])], []
    return out


def as_var(t):
    """Blank nodes of patterns are variables that can't be named."""
    if t[0] == "bnode":
        return ("var", f".b:{t[1]}")
    if t[0] == "triple":
        return ("triple", *map(as_var, t[1:]))
    return t


@dataclass
class Outer:
    """Solutions that others are joined to, so that only what they bind matters; nodes: variables that hold nodes of the graph at hand."""

    rel: Rel
    nodes: frozenset = frozenset()

    def seed(self, var: str, env: Env) -> paths.Seed | None:
        return paths.Seed(self.rel, var, env.hidden, var in self.nodes) if var in self.rel.certain else None


def ends_of(triples) -> frozenset:
    return frozenset(t[1] for s, _, o in triples for t in (s, o) if t[0] == "var")


def connected(triples, env: Env) -> list[list]:
    """Triple patterns in parts that share no variable."""
    parts: list = []
    for t in triples:
        own = set().union(*map(term_vars, t))
        touching = [p for p in parts if p[0] & own or env.hidden]
        parts = [p for p in parts if p not in touching] + [(own.union(*(p[0] for p in touching)), [*(x for p in touching for x in p[1]), t])]
    return [p[1] for p in parts]


def compile_triples(triples, env: Env, outer: Outer | None = None) -> Rel:
    plain, found = [], []

    def add(s, p, o):
        kind = p[0]
        if kind == "link":
            plain.append((s, as_var(p[1]), o))
        elif kind == "inv":
            add(o, p[1], s)
        elif kind == "seq":
            mid = ("var", f".p{len(plain)}_{len(found)}_{uuid.uuid4().hex[:6]}")
            add(s, p[1], mid)
            add(mid, p[2], o)
        else:
            found.append((s, p, o))

    for s, p, o in triples:
        add(as_var(s), p, as_var(o))
    if not found:
        return env.data.bgp(plain, env.graph) if plain else unit(env)
    rels = [Outer(env.data.bgp(part, env.graph), ends_of(part)) for part in connected(plain, env)]

    def seed(var: str) -> paths.Seed | None:
        own = next((r for r in rels if var in r.rel.reps), outer)
        return own and own.seed(var, env)

    others = []
    for s, p, o in found:
        if p[0] == "alt":
            inner = next((r for r in rels if r.rel.reps.keys() & ends_of([(s, p, o)])), outer)
            others.append(union(compile_triples([(s, p[1], o)], env, inner), compile_triples([(s, p[2], o)], env, inner)))
        else:
            others.append(paths.solutions(s, p, o, env.data, env.graph, seed))
    return joined([r.rel for r in rels] + others)


def table_rel(names, rows, env: Env) -> Rel:
    """VALUES: native columns where all the values of a variable have one native kind."""
    spark = env.data.spark
    if not rows:
        return Rel(spark.range(0).select(*(F.lit(None).cast("string").alias(name_of(v)) for v in names)), {v: TERM for v in names}, set(names))
    reps, types, cells = {}, [], []
    for i, v in enumerate(names):
        own = [r[i] for r in rows]
        kinds = {const(t).kind if t[0] != "lit" or not t[3] else "term" for t in own if t is not None}
        kind = kinds.pop() if len(kinds) == 1 else "term"
        # native columns where all the values have one native kind
        reps[v], type_, cell = {
            "iri": (Rep("iri"), "string", lambda t: t[1]), "int": (Rep("int"), "bigint", lambda t: int(t[1])),
            "str": (Rep("str"), "string", lambda t: t[1]), "dbl": (Rep("dbl"), "double", lambda t: float(t[1].replace("INF", "inf"))),
        }.get(kind, (TERM, "string", key_py))
        types.append(f"`{name_of(v)}` {type_}")
        cells.append([None if t is None else cell(t) for t in own])
    data = spark.createDataFrame(list(zip(*cells, strict=True)), ", ".join(types)) if names else spark.range(len(rows)).select()
    return Rel(data, reps, {v for i, v in enumerate(names) if all(r[i] is not None for r in rows)})


def compile_group(group, env: Env, outer: Outer | None = None) -> Rel:
    """outer: what the group's solutions are joined to, in the same graph."""
    out: Rel | None = None
    filters, seen, nodes = [], [], frozenset()

    def onto(r: Rel) -> Rel:
        return r if out is None else join(out, r)

    def before() -> Outer | None:
        return None if out is None or mentions(seen, is_unsettled) else Outer(out, nodes)

    for e in paths_last(group):
        k = e[0]
        if k == "filter":
            filters.append(e[1])
        elif k == "triples":
            out = onto(compile_triples(e[1], env, before() or outer))
            nodes |= ends_of((s, p, o) for s, p, o in e[1] if p[0] == "link")
        elif k == "optional":
            left, near = unit(env) if out is None else out, before()
            inner = [x for x in e[1] if x[0] != "filter"]
            conds = [x[1] for x in e[1] if x[0] == "filter"]
            if any(exists_in(c) for c in conds):
                # the merged mappings that pass, and the left rows without one
                numbered = Rel(left.df.withColumn(name_of(".row"), F.monotonically_increasing_id()), {**left.reps, ".row": Rep("int")}, left.certain | {".row"})
                both = join(numbered, compile_group(inner, env, near))
                for c in conds:
                    both = filtered(both, c, env)
                rest = minus(numbered, both.keep([".row"]))
                both = union(both, rest)
                out = both.keep([v for v in both.reps if v != ".row"])
                out.certain = left.certain
            else:
                right = compile_group(inner, env, near)
                test = None
                if conds:
                    e_ = conds[0]
                    for c in conds[1:]:
                        e_ = ("and", e_, c)
                    left = seeded(left, expression_vars(e_) - right.reps.keys(), env)
                    test = lambda both, e_=e_: ebv(Expressions(both, env)(e_))
                out = left_join(left, right, test)
        elif k == "minus":
            left = unit(env) if out is None else out
            right = compile_group(e[1], replace(env, seed=None), before())
            shown = [v for v in right.reps if v not in env.hidden]
            if set(shown) & left.reps.keys():
                out = minus(left, right)
            else:
                out = left
        elif k == "graph":
            out = onto(compile_graph(e[1], e[2], env))
        elif k == "service":
            raise Unsupported("SERVICE is not evaluated")
        elif k == "union":
            near = before() or outer
            parts = [compile_group(b, env, near) for b in e[1]]
            whole = parts[0]
            for p in parts[1:]:
                whole = union(whole, p)
            out = onto(whole)
        elif k == "group":
            out = onto(compile_group(e[1], env, before() or outer))
        elif k == "bind":
            out = bound(unit(env) if out is None else out, e[1], e[2], env)
        elif k == "values":
            out = onto(with_graphs(table_rel(*e[1], env), env))
        elif k == "subselect":
            out = onto(compile_select(e[1], env).named())
        else:
            raise SparqlError(k)
        seen.append(e)
    out = unit(env) if out is None else out
    for f in filters:
        out = filtered(out, f, env)
    return out


def with_graphs(rel: Rel, env: Env) -> Rel:
    return join(rel, unit(env)) if env.hidden else rel


def compile_graph(g, group, env: Env) -> Rel:
    if g[0] == "iri":
        if not group:
            found = env.data.bgp([(("var", ".s"), ("var", ".p"), ("var", ".o"))], g[1])
            return Rel(found.df.limit(1).select(), {}, set())
        return compile_group(group, replace(env, graph=g[1]))
    hidden = f".g{uuid.uuid4().hex[:6]}"
    rel = compile_group(group, replace(env, graph=("var", hidden)))
    if g[1] not in rel.reps:
        return rel.renamed({hidden: g[1]})
    own = rel.renamed({g[1]: ".own", hidden: g[1]})
    same = key(own.val(".own")) == key(own.val(g[1]))
    kept = own.where(own.val(".own").col.isNull() | same if own.val(".own").ts is None else F.lit(False))
    return kept.keep([v for v in kept.reps if v != ".own"])


# -- SELECT --


@dataclass
class Selected:
    rel: Rel
    order: list[Column]

    def named(self) -> Rel:
        return self.rel


def walk_aggregates(e, found: list) -> None:
    if isinstance(e, tuple) and e and e[0] == "agg":
        found.append(e)
    elif isinstance(e, (tuple, list)):
        for x in e:
            if isinstance(x, (tuple, list)):
                walk_aggregates(x, found)


def sides(group) -> tuple[list, list] | None:
    """A group as two that are joined, where it is nothing but a join."""
    while len(group) == 1 and group[0][0] == "group":
        group = group[0][1]
    return (group[:-1], group[-1:]) if len(group) > 1 and all(e[0] in JOINED for e in group) else None


def compile_select(q, env: Env) -> Selected:
    found: list = []
    for part in ([e for _, e in q.get("items") or [] if e], q["having"], [e for e, _ in q["order"]]):
        walk_aggregates(list(part), found)
    names: dict = {}
    pair = sides(q["where"]) if found and not mentions(q["where"], is_path) and all(e is None for _, e in q["group"] or []) and not mentions(found, lambda e: e[0] == "exists" or is_volatile(e)) else None
    if pair is None:
        rel = compile_group(q["where"], env)
    else:
        left, right = (compile_group(g, env) for g in pair)
        rel = join(left, right)
    if q["group"] is not None or found:
        keys = []
        for v, e in q["group"] or []:
            if e is not None:
                rel = bound(rel, e, v, env)
            keys.append(v)
        keys = [*dict.fromkeys(keys), *(h for h in env.hidden if h in rel.reps)]
        split = factored(left, right, keys, found, expression_vars, lambda r: Expressions(r, env)) if pair else None
        rel, names = split or aggregated(rel, keys, found, lambda r: Expressions(r, env))
        for h in q["having"]:
            shown = list(rel.reps)
            x = Expressions(rel, env, names)
            x.prepare(h)
            names = x.aggregates
            rel = x.rel.where(F.coalesce(ebv(x(h)), F.lit(False))).keep(shown)
    elif q["having"]:
        raise SparqlError("HAVING without a group")
    if q.get("values"):
        # joined after grouping; the select expressions see its variables
        rel = join(rel, with_graphs(table_rel(*q["values"], env), env))
    items = q.get("items")
    if items is None:
        own = [(v, None) for v in ordered_vars(q["where"]) if v in visible_vars(q["where"])]
        items = own + [(v, None) for v in (q["values"][0] if q.get("values") else []) if (v, None) not in own]
    for v, e in items:
        if e is not None:
            x = Expressions(rel, env, names)
            x.prepare(e)
            rel = x.rel.extend(v, x(e))
    wanted = [v for v, _ in items]
    out = wanted + [h for h in env.hidden if h in rel.reps]
    orders = []
    for e, desc in q["order"]:
        x = Expressions(rel, env, names)
        x.prepare(e)
        rel, names = x.rel, x.aggregates
        col = order_key(x(e))
        orders.append((e, col, desc))
    sort = [c.desc_nulls_last() if d else c.asc_nulls_first() for _, c, d in orders]
    sliced = q["limit"] is not None or q["offset"]
    if q.get("mode") == "DISTINCT":
        plain = all(e[0] == "var" and e[1] in wanted for e, _, _ in orders)
        if not orders or plain:
            rel = rel.keep(out)
            rel = Rel(rel.df.distinct(), rel.reps, rel.certain)
            sort = [c.desc_nulls_last() if d else c.asc_nulls_first() for c, d in ((order_key(rel.val(e[1])), d) for e, _, d in orders)]
        else:
            at = [column(v) for v in out if v in rel.reps]
            df = rel.df.withColumns({f"__o{i}": c for i, (_, c, _) in enumerate(orders)})
            sort = [F.col(f"__o{i}").desc_nulls_last() if d else F.col(f"__o{i}").asc_nulls_first() for i, (_, _, d) in enumerate(orders)]
            df = df.withColumn("__first", F.row_number().over(Window.partitionBy(*at).orderBy(*sort))).where("__first = 1")
            rel = Rel(df, rel.reps, rel.certain)
    if env.hidden and sliced and env.hidden[0] in rel.reps:
        # each graph is limited on its own
        w = Window.partitionBy(column(env.hidden[0])).orderBy(*(sort or [F.lit(1)]))
        df = rel.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > q["offset"])
        rel = Rel(df if q["limit"] is None else df.where(F.col("__n") <= q["offset"] + q["limit"]), rel.reps, rel.certain)
        return Selected(rel.keep(out), [])
    if sort:
        rel = Rel(rel.df.orderBy(*sort), rel.reps, rel.certain)
    rel = rel.keep(out)
    if sliced:
        df = rel.df.offset(q["offset"]) if q["offset"] else rel.df
        rel = Rel(df if q["limit"] is None else df.limit(q["limit"]), rel.reps, rel.certain)
    return Selected(rel, [])


def ordered_vars(group) -> list[str]:
    """Variables in the order of first mention."""
    out: list[str] = []

    def walk(x):
        if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
            out.append(x[1])
        elif isinstance(x, tuple) and x and x[0] == "bind":
            walk(x[1])
            out.append(x[2])
        elif isinstance(x, tuple) and x and x[0] == "values":
            out.extend(x[1][0])
        elif isinstance(x, tuple) and x and x[0] == "subselect":
            q = x[1]
            out.extend(ordered_vars(q["where"]) if q["items"] is None else [v for v, _ in q["items"]])
        elif isinstance(x, tuple) and x and x[0] in ("minus", "filter"):
            return
        elif isinstance(x, (tuple, list)):
            for y in x:
                walk(y)

    walk(group)
    return [v for v in dict.fromkeys(out) if not v.startswith(".")]


def output(rel: Rel) -> DataFrame:
    """The solutions with a column a variable: IRIs and literals of one kind native, other terms as keys."""
    cols = []
    for v, r in rel.reps.items():
        if v.startswith("."):
            continue
        c = column(v)
        cols.append((F.concat(F.lit(r.prefix), c.cast("string")) if r.prefix else c).alias(v))
    return rel.df.select(*cols)


__all__ = ["Env", "Unsupported", "compile_group", "compile_select", "output", "term_vars"]

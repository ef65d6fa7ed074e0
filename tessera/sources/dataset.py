"""The data that queries run over: quads, or relational tables seen as a graph.

A dataset gives the solutions of triple patterns. `graph` is None for the default graph, an IRI for a named graph, or
("var", v) for all named graphs, which binds v.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import Val, as_term, const, key, key_py
from tessera.operators.relation import TERM, Rel, Rep, among, column, join, name_of, stored, union
from tessera.plans.parser import XSD, ground


class Dataset:
    spark: SparkSession
    default: list[str] | None = None  # FROM
    named: list[str] | None = None  # FROM NAMED

    def quads(self) -> DataFrame:
        """(s, p, o, g) keys."""
        raise NotImplementedError

    def view(self, clauses: list[tuple[bool, str]]) -> Dataset:
        """The dataset that FROM and FROM NAMED describe; either alone empties the other."""
        if not clauses:
            return self
        out = Quads(self.spark, self.quads())
        out.default, out.named = [i for n, i in clauses if not n], [i for n, i in clauses if n]
        return out

    def narrow(self, subjects: list[str]) -> Dataset:
        """A dataset that has all the triples of these subjects."""
        return self

    def named_graphs(self, var: str) -> Rel:
        df = self.scope(("var", var)).select(F.col("g").alias(name_of(var))).distinct()
        return Rel(df, {var: TERM}, {var})

    def scope(self, graph) -> DataFrame:
        """The quads of a graph."""
        q = self.quads()
        if graph is None:
            if self.default is not None:
                return q.where(F.col("g").isin([f"<{g}>" for g in self.default])).dropDuplicates(["s", "p", "o"]) if self.default else q.limit(0)
            return q.where("g is null")
        if isinstance(graph, str):
            visible = self.named is None or graph in self.named
            return q.where(F.col("g") == f"<{graph}>") if visible else q.limit(0)
        return q.where("g is not null") if self.named is None else q.where(F.col("g").isin([f"<{g}>" for g in self.named]))

    def pattern(self, s, p, o, graph) -> Rel:
        df = self.scope(graph)
        reps: dict[str, Rep] = {}
        nested = []
        for t, c in ((s, "s"), (p, "p"), (o, "o"), *([(graph, "g")] if isinstance(graph, tuple) else [])):
            if t[0] == "var":
                if t[1] in reps:
                    df = df.where(F.col(c) == column(t[1]))
                else:
                    df = df.withColumn(name_of(t[1]), F.col(c))
                    reps[t[1]] = TERM
            elif ground(t):
                df = df.where(F.col(c) == key_py(t))
            else:
                nested.append((t, F.col(c)))
        for t, c in nested:
            df = self._match(df, t, c, reps)
        return Rel(df.select(*(column(v) for v in reps)), reps, set(reps))

    def _match(self, df: DataFrame, t, c: Column, reps) -> DataFrame:
        """Matches a triple-term pattern with variables, at any depth."""
        from tessera.functions.builtins import triple_parts

        df = df.where(c.startswith("<<("))
        for i, part in enumerate(t[1:], 1):
            own = triple_parts(Val("term", c), i).col
            if part[0] == "var":
                if part[1] in reps:
                    df = df.where(own == column(part[1]))
                else:
                    df = df.withColumn(name_of(part[1]), own)
                    reps[part[1]] = TERM
            elif ground(part):
                df = df.where(own == key_py(part))
            else:
                tmp = f"__part{len(df.columns)}"
                df = self._match(df.withColumn(tmp, own), part, F.col(tmp), reps)
        return df

    def bgp(self, triples: list[tuple], graph) -> Rel:
        """A basic graph pattern: each pattern joined to what it shares variables with."""
        return joined([self.pattern(s, p, o, graph) for s, p, o in triples])

    def nodes(self, graph, var: str, seeds: Rel | None = None) -> Rel:
        """The subjects and objects of a graph; with seeds those that are among its terms n."""
        names = {"g": graph[1]} if isinstance(graph, tuple) else {}
        reps = dict.fromkeys([var, *names.values()], TERM)
        out = None
        for c in "so":
            df = self.scope(graph).select(F.col(c).alias(name_of(var)), *(F.col(g).alias(name_of(v)) for g, v in names.items()))
            r = Rel(df, reps, set(reps))
            r = r if seeds is None else among(r, var, seeds)
            out = r if out is None else union(out, r)
        return Rel(out.df.distinct(), out.reps, out.certain)

    def links(self, without: list[str], graph, ends: dict) -> Rel:
        """(a, b) of the triples of all predicates but some. ends: for a or b a term, or a Rel of the terms n that are wanted."""
        r = self.bgp([(("var", "a"), ("var", "p"), ("var", "b"))], graph).as_terms(["a", "p", "b"])
        r = r.where(~column("p").isin([f"<{i}>" for i in without])) if without else r
        for end, x in ends.items():
            r = r.where(column(end) == key_py(x)) if isinstance(x, tuple) else among(r, end, x)
        return r.keep([v for v in r.reps if v != "p"])


def joined(rels: list[Rel]) -> Rel:
    """All joined, each next one sharing a variable with those before where there is one."""
    rest = list(rels)
    out = rest.pop(0)
    while rest:
        i = next((i for i, r in enumerate(rest) if set(r.reps) & set(out.reps)), 0)
        out = join(out, rest.pop(i))
    return out


class Quads(Dataset):
    """Quads (s, p, o, g) of keys; g is null in the default graph."""

    def __init__(self, spark: SparkSession, df: DataFrame):
        self.spark, self.df = spark, df

    def quads(self) -> DataFrame:
        return self.df


@dataclass
class Table:
    """A table as a graph: a subject for each row, a predicate for each column that is not null."""

    name: str
    subject: Column
    prefix: str  # of the subjects
    refs: dict[str, str]  # column: table whose subjects it refers to
    graph: Column | None = None  # the local part of a named graph's IRI, which rows are in too
    skip: tuple[str, ...] = ()


NATIVE = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "dbl", "float": "flt", "string": "str", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time"}


class Tables(Dataset):
    """Tables of a folder of Parquet files, mapped as `Table`s say; bindings stay native columns.

    A predicate has one value a row at most and a subject is one row, so patterns of one subject over one table are one
    scan with conditions, and joins of subjects with references are joins of native keys.
    """

    def __init__(self, spark: SparkSession, read, tables: list[Table], base: str = "urn:t:", graphs: str = "urn:g:", every: dict[str, Table] | None = None):
        self.spark, self.read, self.base, self.graphs = spark, read, base, graphs
        self.tables = {t.name: t for t in tables}
        self.every = every or self.tables  # what references may lead to
        self._frames: dict[str, DataFrame] = {}

    def narrow(self, subjects: list[str]) -> Tables:
        return Tables(self.spark, self.read, [t for t in self.tables.values() if any(s.startswith(t.prefix) for s in subjects)], self.base, self.graphs, self.tables)

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.read(name)
        return self._frames[name]

    def resolve(self, iri: str):
        """(table, column, whether a reference) of a predicate's IRI."""
        if not iri.startswith(self.base) or "#" not in iri:
            return None
        name, _, col = iri[len(self.base) :].partition("#")
        t = self.tables.get(name)
        if t is None:
            return None
        ref = col.startswith("ref-")
        col = col.removeprefix("ref-")
        if col not in self.frame(name).columns or col in t.skip or ref and col not in t.refs:
            return None
        return t, col, ref

    def subject(self, t: Table) -> Val:
        return Val("iri", t.subject, prefix=t.prefix)

    def object(self, t: Table, col: str, ref: bool) -> Val:
        c = F.col(col)
        if ref:
            return Val("iri", c, prefix=self.every[t.refs[col]].prefix)
        kind = NATIVE[dict(self.frame(t.name).dtypes)[col]]
        if kind == "time":
            return Val("time", None, dt=XSD + "dateTime", ts=c.cast("timestamp_ntz"))
        return Val(kind, c.cast("bigint") if kind == "int" else c)

    def _star(self, t: Table, triples, graph) -> Rel:
        """Patterns of one subject over one table, as one scan."""
        df = self.frame(t.name)
        reps: dict[str, Rep] = {}
        conds: list[Column] = []
        cols: dict[str, Column] = {}

        def bind(term, v: Val):
            rep, c = stored(v)
            if term[0] == "var":
                if term[1] in reps:
                    own = cols[term[1]]
                    conds.append(own == c if reps[term[1]] == rep else key(reps[term[1]].val(own)) == key(v))
                else:
                    reps[term[1]], cols[term[1]] = rep, c
            else:
                want = const(term)
                if want.kind == "iri" and v.kind == "iri" and term[1].startswith(v.prefix):
                    conds.append(c == F.lit(term[1][len(v.prefix) :]).try_cast(df.select(c.alias("c")).schema["c"].dataType))
                elif want.kind == v.kind and v.kind in ("int", "str", "bool") and want.lang is None:
                    conds.append(c == want.col)
                else:
                    conds.append(key(v) == F.lit(key_py(term)))
            conds.append(c.isNotNull())

        for s, p, o in triples:
            bind(s, self.subject(t))
            bind(o, self.object(t, *self.resolve(p[1])[1:]))
        if isinstance(graph, tuple):
            bind(graph, Val("iri", t.graph, prefix=f"{self.graphs}{t.name}/"))
        elif graph is not None:
            conds.append(F.concat(F.lit(f"{self.graphs}{t.name}/"), t.graph.cast("string")) == graph)
        df = df.where(reduce(lambda a, b: a & b, conds)).select(*(c.alias(name_of(v)) for v, c in cols.items()))
        return Rel(df, reps, set(reps))

    def bgp(self, triples: list[tuple], graph) -> Rel:
        stars: dict = {}
        rels = []
        for s, p, o in triples:
            found = self.resolve(p[1]) if p[0] == "iri" else None
            if found is None:
                rels.append(self._any(s, p, o, graph))
            elif graph is not None and found[0].graph is None or s[0] == "lit" or not (s[0] == "var" or ground(s)) or not (o[0] == "var" or ground(o)):
                rels.append(self._nothing(s, p, o, graph))
            else:
                stars.setdefault((s, found[0].name), []).append((s, p, o))
        rels = [self._star(self.tables[name], own, graph) for (_, name), own in stars.items()] + rels
        return joined(rels)

    def pattern(self, s, p, o, graph) -> Rel:
        return self.bgp([(s, p, o)], graph)

    def _nothing(self, s, p, o, graph) -> Rel:
        names = list(dict.fromkeys(t[1] for t in (s, p, o, graph if isinstance(graph, tuple) else ("iri",)) if t[0] == "var"))
        df = self.spark.range(0).select(*(F.lit(None).cast("string").alias(name_of(v)) for v in names))
        return Rel(df, {v: TERM for v in names}, set(names))

    def _any(self, s, p, o, graph) -> Rel:
        """A pattern whose predicate is a variable or no column's: over the quads, or over the tables that its subject can be in."""
        if p[0] == "iri":
            return self._nothing(s, p, o, graph)
        out = None
        for t in self.tables.values():
            if graph is not None and t.graph is None or s[0] == "iri" and not s[1].startswith(t.prefix):
                continue
            for col in self.frame(t.name).columns:
                for ref in (False, True):
                    iri = f"{self.base}{t.name}#{'ref-' * ref}{col}"
                    if self.resolve(iri) is None or p[1] in (s[1], o[1] if o[0] == "var" else None):
                        continue
                    r = self._star(t, [(s, ("iri", iri), o)], graph).extend(p[1], Val("iri", F.lit(iri)), certain=True)
                    out = r if out is None else union(out, r)
        return self._nothing(s, p, o, graph) if out is None else out

    def links(self, without: list[str], graph, ends: dict) -> Rel:
        """Over the columns that can have such ends, whose terms stay native."""
        s, o = (ends[e] if isinstance(ends.get(e), tuple) else ("var", e) for e in "ab")
        out = None
        for t in self.tables.values():
            if graph is not None and t.graph is None or s[0] not in ("var", "iri") or s[0] == "iri" and not s[1].startswith(t.prefix):
                continue
            for p, col, ref in self._predicates(t):
                v = self.object(t, col, ref)
                if p in without or o[0] != "var" and ((o[0] == "iri") != (v.kind == "iri") or o[0] == "iri" and not o[1].startswith(v.prefix)):
                    continue
                r = self._star(t, [(s, ("iri", p), o)], graph)
                for e, x in (("a", s), ("b", o)):
                    if r is not None and x[0] != "var":
                        r = r.extend(e, const(x), certain=True)
                    elif r is not None and e in ends:
                        r = among(r, e, ends[e])
                if r is not None:
                    out = r if out is None else union(out, r)
        return self._nothing(("var", "a"), ("iri",), ("var", "b"), graph) if out is None else out

    def nodes(self, graph, var: str, seeds: Rel | None = None) -> Rel:
        if seeds is None or graph is not None:
            return super().nodes(graph, var, seeds)
        out = None
        for t in self.tables.values():
            for v in (self.subject(t), *(self.object(t, col, ref) for _, col, ref in self._predicates(t))):
                rep, c = stored(v)
                r = among(Rel(self.frame(t.name).select(c.alias(name_of(var))).where(column(var).isNotNull()), {var: rep}, {var}), var, seeds)
                if r is not None:
                    out = r if out is None else union(out, r)
        return self._nothing(("var", var), ("iri",), ("iri",), None) if out is None else Rel(out.df.distinct(), out.reps, out.certain)

    def _predicates(self, t: Table) -> list[tuple[str, str, bool]]:
        """(IRI, column, whether a reference) of a table's predicates."""
        found = [(f"{self.base}{t.name}#{'ref-' * ref}{col}", col, ref) for col in self.frame(t.name).columns for ref in (False, True)]
        return [x for x in found if self.resolve(x[0])]

    def quads(self) -> DataFrame:
        """Every triple as keys: one scan a table, its columns exploded."""
        out = None
        if not self.tables:
            return self.spark.createDataFrame([], "s string, p string, o string, g string")
        for t in self.tables.values():
            df = self.frame(t.name)
            pairs = []
            for col in df.columns:
                for ref in (False, True):
                    if self.resolve(iri := f"{self.base}{t.name}#{'ref-' * ref}{col}"):
                        pairs.append(F.struct(F.lit(f"<{iri}>").alias("p"), key(self.object(t, col, ref)).alias("o")))
            df = df.select(key(self.subject(t)).alias("s"), F.explode(F.array(*pairs)).alias("x"), *([t.graph.cast("string").alias("local")] if t.graph is not None else []))
            df = df.where("x.o is not null")
            rows = df.select("s", "x.p", "x.o", F.lit(None).cast("string").alias("g"))
            if t.graph is not None:
                rows = rows.union(df.select("s", "x.p", "x.o", F.concat(F.lit(f"<{self.graphs}{t.name}/"), "local", F.lit(">"))))
            out = rows if out is None else out.union(rows)
        return out

    def named_graphs(self, var: str) -> Rel:
        out = None
        for t in self.tables.values():
            if t.graph is not None:
                df = self.frame(t.name).select(t.graph.alias(name_of(var))).distinct()
                r = Rel(df, {var: Rep("iri", f"{self.graphs}{t.name}/")}, {var})
                out = r if out is None else union(out, r)
        return self._nothing(("var", var), ("iri",), ("iri",), None) if out is None else out


__all__ = ["Dataset", "Quads", "Table", "Tables", "as_term", "joined"]

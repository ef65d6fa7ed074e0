"""ASK, CONSTRUCT and DESCRIBE over compiled groups, and the instantiation of templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import key, key_py
from tessera.plans.session import written

from .compile import Env, compile_select
from .relation import Rel


def _cell(t, rel: Rel, nonce: str) -> Column:
    if t is None:
        return F.lit(None).cast("string")
    if t[0] == "var":
        return key(rel.val(t[1])) if t[1] in rel.reps else F.lit(None).cast("string")
    if t[0] == "blank":
        return F.concat(F.lit("_:t"), F.substring(F.sha2(F.concat_ws("|", F.lit(nonce), F.lit(t[1]), F.col("__ordinal").cast("string")), 256), 1, 24))
    if t[0] == "triple":
        parts = [_cell(x, rel, nonce) for x in t[1:]]
        return F.concat(F.lit("<<( "), parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit(" )>>"))
    return F.lit(key_py(t))


def legal(s: Column, p: Column, o: Column, g: Column | None = None) -> Column:
    iri = lambda c: c.startswith("<") & ~c.startswith("<<(")
    out = s.isNotNull() & o.isNotNull() & (iri(s) | s.startswith("_")) & iri(p)
    return out if g is None else out & (g.isNull() | iri(g) | g.startswith("_"))


def instantiated(rel: Rel, template, nonce: str, default_graph: str | None = None) -> DataFrame:
    """The distinct legal quads (s, p, o, g) of a template for each solution; blank nodes are fresh for each."""
    df = rel.df
    if any("'blank'" in repr(q) for q in template):
        # ordinals differ between evaluations, so the solutions are written first
        df = written(df.withColumn("__ordinal", F.monotonically_increasing_id()))
    own = Rel(df, rel.reps, rel.certain)
    quads, unbound = [], []
    for s, p, o, g in template:
        graph = F.lit(f"<{default_graph}>") if g is None and default_graph else _cell(g, own, nonce)
        cells = [_cell(x, own, nonce) for x in (s, p, o)]
        # a graph that is a variable must be bound
        unbound.append(F.lit(True) if g is None else graph.isNotNull())
        quads.append(F.struct(cells[0].alias("s"), cells[1].alias("p"), cells[2].alias("o"), graph.alias("g"), unbound[-1].alias("ok")))
    if not quads:
        return df.sparkSession.createDataFrame([], "s string, p string, o string, g string")
    rows = df.select(F.explode(F.array(*quads)).alias("q")).select("q.*")
    return rows.where(F.col("ok") & legal(F.col("s"), F.col("p"), F.col("o"), F.col("g"))).select("s", "p", "o", "g").distinct()


def solutions(q, env: Env) -> Rel:
    """All the variables of a query's pattern, with its modifiers."""
    return compile_select({**q, "items": q.get("items"), "mode": None}, env).rel


def ask(q, env: Env) -> DataFrame:
    found = solutions(q, env).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
    return found


def construct(q, env: Env) -> DataFrame:
    return instantiated(solutions(q, env), q["template"], env.nonce).select("s", "p", "o").distinct()


def describe(q, env: Env) -> DataFrame:
    """Concise bounded descriptions: the triples of the targets, and of the blank nodes that they lead to."""
    spark = env.data.spark
    named = [t for t in q["targets"] or [] if t[0] != "var"]
    variables = [t[1] for t in q["targets"] or [] if t[0] == "var"]
    roots = [spark.createDataFrame([(key_py(t),) for t in named], "n string")] if named else []
    if variables or q["targets"] is None:
        rel = solutions(q, env)
        for v in rel.reps if q["targets"] is None else variables:
            if v in rel.reps and not v.startswith("."):
                roots.append(rel.df.select(key(rel.val(v)).alias("n")))
    if not roots:
        return spark.createDataFrame([], "s string, p string, o string")
    data = env.data if variables or q["targets"] is None else env.data.narrow([t[1] for t in named])
    triples = data.scope(None).select("s", "p", "o")
    fresh = seen = written(reduce(DataFrame.union, roots).where("n is not null").distinct())
    out = None
    while not fresh.isEmpty():
        own = written(triples.join(fresh.withColumnRenamed("n", "s"), "s", "left_semi").select("s", "p", "o").distinct())
        out = own if out is None else out.union(own)
        nxt = own.where("o like '\\_:%'").select(F.col("o").alias("n")).distinct()
        fresh = written(nxt.join(seen, "n", "left_anti"))
        seen = seen.union(fresh)
    return spark.createDataFrame([], "s string, p string, o string") if out is None else out.distinct()

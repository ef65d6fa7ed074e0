"""Solution mappings as DataFrames: a nullable column a variable, with what is known of it statically."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import Val, key


def name_of(var: str) -> str:
    return "v_" + var.replace(".", "__")


def column(var: str) -> Column:
    return F.col(f"`{name_of(var)}`")


@dataclass(frozen=True)
class Rep:
    """How a variable's column holds its terms: a Val's kind, and with it what else is static."""

    kind: str = "term"
    prefix: str = ""
    dt: str | None = None
    native_time: bool = False

    def val(self, col: Column) -> Val:
        if self.native_time:
            return Val("time", None, dt=self.dt, ts=col)
        return Val(self.kind, col, prefix=self.prefix, dt=self.dt)


TERM = Rep()


def stored(v: Val) -> tuple[Rep, Column]:
    """A Val as a column with its Rep; strings that may have a language become keys."""
    if v.kind == "null":
        return TERM, F.lit(None).cast("string")
    if v.kind == "str" and v.lang is not None:
        return TERM, key(v)
    if v.ts is not None:
        return Rep("time", dt=v.dt, native_time=True), v.ts
    return Rep(v.kind, v.prefix, v.dt), v.col


@dataclass
class Rel:
    df: DataFrame
    reps: dict[str, Rep]
    certain: set[str] = field(default_factory=set)

    def val(self, var: str) -> Val:
        return self.reps[var].val(column(var)) if var in self.reps else Val("null", None)

    def where(self, cond: Column) -> Rel:
        return Rel(self.df.where(cond), self.reps, self.certain)

    def extend(self, var: str, v: Val, certain: bool = False) -> Rel:
        rep, col = stored(v)
        return Rel(self.df.withColumn(name_of(var), col), {**self.reps, var: rep}, self.certain | {var} if certain else self.certain - {var})

    def keep(self, names: list[str]) -> Rel:
        """Exactly these variables, in this order; ones that are missing are unbound."""
        cols = [(column(v) if v in self.reps else F.lit(None).cast("string")).alias(name_of(v)) for v in names]
        return Rel(self.df.select(*cols), {v: self.reps.get(v, TERM) for v in names}, self.certain & set(names))

    def as_terms(self, names) -> Rel:
        cols = {name_of(v): key(self.val(v)) for v in names if self.reps[v] != TERM}
        return Rel(self.df.withColumns(cols) if cols else self.df, {**self.reps, **{v: TERM for v in names}}, self.certain)

    def renamed(self, to: dict[str, str]) -> Rel:
        cols = [column(v).alias(name_of(to.get(v, v))) for v in self.reps]
        return Rel(self.df.select(*cols), {to.get(v, v): r for v, r in self.reps.items()}, {to.get(v, v) for v in self.certain})


def unified(a: Rel, b: Rel, names) -> tuple[Rel, Rel]:
    """Both with the same representation of these variables."""
    differ = [v for v in names if a.reps[v] != b.reps[v]]
    return (a.as_terms(differ), b.as_terms(differ)) if differ else (a, b)


def _right(b: Rel, shared) -> DataFrame:
    return b.df.select(*(column(v).alias("r_" + name_of(v) if v in shared else name_of(v)) for v in b.reps))


def _pair(v: str) -> tuple[Column, Column]:
    return column(v), F.col(f"`r_{name_of(v)}`")


def compatible(a: Rel, b: Rel, shared) -> list[Column]:
    out = []
    for v in shared:
        x, y = _pair(v)
        out.append(x == y if v in a.certain and v in b.certain else x.isNull() | y.isNull() | (x == y))
    return out


def every(conds: list[Column]) -> Column | None:
    return reduce(lambda p, q: p & q, conds) if conds else None


def _merged(df: DataFrame, a: Rel, b: Rel, shared, left: bool) -> Rel:
    cols = []
    for v in [*a.reps, *(v for v in b.reps if v not in a.reps)]:
        c = F.coalesce(*_pair(v)) if v in shared and v not in a.certain else column(v)
        cols.append(c.alias(name_of(v)))
    return Rel(df.select(*cols), {**b.reps, **a.reps}, a.certain if left else a.certain | b.certain)


def union(a: Rel, b: Rel) -> Rel:
    names = list(dict.fromkeys([*a.reps, *b.reps]))
    shared = [v for v in names if v in a.reps and v in b.reps]
    a, b = unified(a, b, shared)
    reps = {v: a.reps.get(v) or b.reps[v] for v in names}

    def side(x: Rel) -> DataFrame:
        other = a if x is b else b
        return x.df.select(*((column(v) if v in x.reps else F.lit(None).cast(other.df.schema[name_of(v)].dataType)).alias(name_of(v)) for v in names))

    return Rel(side(a).unionByName(side(b)), reps, a.certain & b.certain)


def join(a: Rel, b: Rel, splits: int = 4) -> Rel:
    """Compatible mappings. Where a shared variable may be unbound, a side is parted by it, so that the joins stay equi-joins."""
    shared, open_ = both(a, b)
    if open_ and splits:
        v = open_[0]
        halves = [join(x, b, splits - 1) for x in parted(a, v)] if v not in a.certain else [join(a, x, splits - 1) for x in parted(b, v)]
        return union(*halves)
    a, b = unified(a, b, shared)
    cond = every(compatible(a, b, shared))
    right = _right(b, shared)
    return _merged(a.df.join(right, cond, "inner") if cond is not None else a.df.crossJoin(right), a, b, shared, False)


def parted(r: Rel, v: str) -> tuple[Rel, Rel]:
    """The rows of r in which a variable is bound, and, without the variable, those in which it isn't."""
    bound = Rel(r.df.where(column(v).isNotNull()), r.reps, r.certain | {v})
    return bound, Rel(r.df.where(column(v).isNull()), r.reps, r.certain).keep([x for x in r.reps if x != v])


def both(a: Rel, b: Rel) -> tuple[list[str], list[str]]:
    """(the shared variables, those that may be unbound on a side)."""
    shared = [v for v in a.reps if v in b.reps]
    return shared, [v for v in shared if v not in a.certain or v not in b.certain]


def left_join(a: Rel, b: Rel, expr=None, splits: int = 4) -> Rel:
    """OPTIONAL; expr: from the merged mapping, a boolean column of its filter. Sides are parted as join() does."""
    shared, open_ = both(a, b)
    if open_ and splits:
        v, certain = open_[0], a.certain
        if v not in a.certain:
            out = union(*(left_join(x, b, expr, splits - 1) for x in parted(a, v)))
        else:
            out, rest = None, a
            for x in parted(b, v):
                hit = join(a, x)
                hit = hit if expr is None else hit.where(F.coalesce(expr(hit), F.lit(False)))
                out, rest = hit if out is None else union(out, hit), semi(rest, x, True, splits - 1, expr)
            out = union(out, rest)
        return Rel(out.df, out.reps, certain)
    a, b = unified(a, b, shared)
    conds = compatible(a, b, shared)
    if expr is not None:
        # the filter sees the merged mapping
        merged = Rel(a.df, {**b.reps, **a.reps}, a.certain | b.certain)
        conds.append(F.coalesce(expr(merged), F.lit(False)))
    cond = every(conds)
    return _merged(a.df.join(_right(b, shared), F.lit(True) if cond is None else cond, "left"), a, b, shared, True)


def _again(parts: list[Rel], a: Rel) -> Rel:
    """Parts of a's rows as one, with a's variables; a variable that a part lacks is unbound there."""
    return Rel(reduce(DataFrame.unionByName, (a.df.limit(0).unionByName(p.df, allowMissingColumns=True) if len(p.reps) < len(a.reps) else p.df for p in parts)), a.reps, a.certain)


def minus(a: Rel, b: Rel, splits: int = 6) -> Rel:
    """Rows of a without a compatible row in b that binds a variable which the row binds too."""
    shared = [v for v in a.reps if v in b.reps]
    if not shared:
        return a
    a, b = unified(a, b, shared)
    b = b.keep(shared)
    if any(v in a.certain and v in b.certain for v in shared):
        return semi(a, b, True)
    v = shared[0]
    if splits and v not in a.certain:
        return _again([minus(x, b, splits - 1) for x in parted(a, v)], a)
    if splits:
        for x in parted(b, v):
            a = minus(a, x, splits - 1)
        return a
    cond = every(compatible(a, b, shared)) & reduce(lambda p, q: p | q, [_pair(v)[0].isNotNull() & _pair(v)[1].isNotNull() for v in shared])
    return Rel(a.df.join(_right(b, shared), cond, "left_anti"), a.reps, a.certain)


def semi(a: Rel, b: Rel, negative: bool, splits: int = 4, expr=None) -> Rel:
    """Rows of a that have, or don't have, a compatible row in b, with which expr holds; sides are parted as join() does."""
    shared, open_ = both(a, b)
    a, b = unified(a, b, shared)
    if expr is None:
        b = b.keep(shared)
    if open_ and splits:
        v = open_[0]
        if v not in a.certain:
            return _again([semi(x, b, negative, splits - 1, expr) for x in parted(a, v)], a)
        bound, free = parted(b, v)
        rest = semi(a, bound, True, splits - 1, expr)
        if negative:
            return semi(rest, free, True, splits - 1, expr)
        return _again([semi(a, bound, False, splits - 1, expr), semi(rest, free, False, splits - 1, expr)], a)
    conds = compatible(a, b, shared)
    if expr is not None:
        conds.append(F.coalesce(expr(Rel(a.df, {**b.reps, **a.reps}, a.certain | b.certain)), F.lit(False)))
    right = _right(b, shared) if expr is not None else _right(b, shared).distinct() if shared else b.df.limit(1)  # one row says that there is one
    out = a.df.join(right, every(conds) if conds else F.lit(True), "left_anti" if negative else "left_semi")
    return Rel(out, a.reps, a.certain)


def flagged(a: Rel, b: Rel, flag: str) -> Rel:
    """a with a boolean variable: whether b has a compatible row."""
    shared = [v for v in a.reps if v in b.reps]
    x = Rel(a.df.withColumn("__row", F.monotonically_increasing_id()), a.reps, a.certain) if not shared else a
    x, b = unified(x, b, shared)
    if all(v in x.certain and v in b.certain for v in shared) and shared:
        right = _right(b.keep(shared), shared).distinct().withColumn("__hit", F.lit(True))
        df = x.df.join(right, every(compatible(x, b, shared)), "left")
        return Rel(df.select(*(column(v) for v in x.reps), F.coalesce("__hit", F.lit(False)).alias(name_of(flag))), {**x.reps, flag: Rep("bool")}, x.certain | {flag})
    hit = semi(x, b, False).df.withColumn(name_of(flag), F.lit(True))
    miss = semi(x, b, True).df.withColumn(name_of(flag), F.lit(False))
    names = [name_of(v) for v in x.reps] + [name_of(flag)]
    return Rel(hit.select(*names).unionByName(miss.select(*names)), {**x.reps, flag: Rep("bool")}, x.certain | {flag})


def disjoint(a: Rep, b: Rep) -> bool:
    """Whether columns of these representations can't hold the same term."""
    if a.kind == b.kind == "iri":
        return not a.prefix.startswith(b.prefix) and not b.prefix.startswith(a.prefix)
    return a.kind != b.kind and "term" not in (a.kind, b.kind)


def among(r: Rel, var: str, seeds: Rel) -> Rel | None:
    """Rows of r whose variable is one of the terms of seeds' variable n; None where none can be. IRIs are compared as r has them."""
    own, rep = r.reps[var], seeds.reps["n"]
    if disjoint(own, rep):
        return None
    seeds = seeds.keep(["n"])
    if own.kind == "iri" and own != rep:
        text, start = key(seeds.val("n")), f"<{own.prefix}"
        local = F.substring(text, F.lit(len(start) + 1), F.length(text) - len(start) - 1)
        cell = local.try_cast(r.df.schema[name_of(var)].dataType)
        df = seeds.df.where(text.startswith(start) & (cell.cast("string") == local)).select(cell.alias(name_of("n")))
        seeds = Rel(df, {"n": own}, {"n"})
    return semi(r, seeds.renamed({"n": var}), False)

"""Grouping and SPARQL's aggregates. Arguments in error are skipped; Spark aggregates partially before it shuffles.

Over a product, or a join of variables that may be unbound, each side is grouped before the join (`factored`), so that the
pairs of solutions are counted and not made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.values import DEC, Num, Val, from_num, key, lex_of, number, order_key, sql_null

from .relation import Rel, Rep, both, column, join, name_of, parted, stored, unified, union


def _column(v: Val) -> Column:
    return v.ts if v.ts is not None else v.col


@dataclass
class Part:
    """An aggregate expression; kind: how groups' own are put together (count, sum, min, max, min_by, max_by), none where they can't be."""

    whole: Column
    kind: str = ""
    arg: Column | None = None
    type: str = "bigint"  # of a sum

    def partial(self) -> list[Column]:
        """Of a group of one side of a join."""
        if self.kind == "sum" and self.type == "bigint":
            return [F.sum(self.arg.cast("decimal(20,0)"))]  # a part may leave the range that the whole stays in
        return [self.whole, F.count(self.arg)] if self.kind == "sum" else [self.whole]

    def merged(self, own: list[Column], times: Column) -> Column:
        """The whole, from the groups' partial() and how often each occurs."""
        if self.kind == "count":
            return F.coalesce(F.sum(own[0] * times), F.lit(0).cast("bigint"))
        if self.kind == "sum" and self.type == "bigint":
            return F.sum(own[0] * times.cast("decimal(20,0)")).try_cast("bigint")
        if self.kind == "sum" and self.type == DEC:
            product = F.try_multiply(own[0], times.cast("decimal(20,0)"))
            return F.when(F.count_if(product.isNull() & (own[1] > 0)) == 0, F.try_sum(product))
        if self.kind == "sum":
            return F.sum(own[0] * times.cast("double"))
        if self.kind in ("min", "max"):
            return (F.min if self.kind == "min" else F.max)(own[0])
        return (F.min_by if self.kind == "min_by" else F.max_by)(own[0], order_key(Val("term", own[0])))


def _counted(c: Column) -> Part:
    return Part(F.count(c), "count", c)


def _plan(agg, v: Val | None, rel: Rel) -> tuple[list[Part], object]:
    """(the aggregate expressions, a function of their result columns that gives the Val)."""
    _, f, distinct, _, sep = agg
    if f == "COUNT" and v is None:
        every = [F.coalesce(key(rel.val(x)), F.lit("")) for x in rel.reps if not x.startswith(".agg")]
        return [Part(F.count_distinct(F.struct(*every))) if distinct and every else _counted(F.lit(1))], lambda c: Val("int", c[0])
    if v.kind == "null":
        empty = {"COUNT": Val("int", F.lit(0).cast("bigint")), "SUM": Val("int", F.lit(0).cast("bigint")), "AVG": Val("int", F.lit(0).cast("bigint")), "GROUP_CONCAT": Val("str", F.lit(""))}
        return [_counted(F.lit(1))], lambda c: empty.get(f, Val("null", None))
    c = _column(v) if v.kind != "str" or v.lang is None else key(v)
    if f == "COUNT":
        return [Part(F.count_distinct(c)) if distinct else _counted(c)], lambda r: Val("int", r[0])
    if f == "SAMPLE":
        rep, col = stored(v)
        return [Part(F.any_value(col, True))], lambda r: rep.val(r[0])
    if f in ("MIN", "MAX"):
        rep, col = stored(v)
        if rep.kind == "term":
            g = F.min_by if f == "MIN" else F.max_by
            return [Part(g(col, order_key(Val("term", col))), f.lower() + "_by", col)], lambda r: rep.val(r[0])
        return [Part((F.min if f == "MIN" else F.max)(col), f.lower(), col)], lambda r: rep.val(r[0])
    if f == "GROUP_CONCAT":
        text = lex_of(v)
        bad = F.count_if(text.isNull() & c.isNotNull())
        joined = F.array_join(F.sort_array(F.collect_set(text) if distinct else F.collect_list(text)), sep)
        return [Part(joined), Part(bad)], lambda r: Val("str", F.when(r[1] == 0, r[0]))
    n = number(v)
    if n is None:  # no number ever; over no rows it is 0
        return [_counted(c)], lambda r: Val("int", F.when(r[0] == 0, F.lit(0).cast("bigint")))
    if isinstance(n.rank, int):
        col = v.col if n.rank != 0 else v.col.cast("bigint")
        total = Part(F.sum_distinct(col)) if distinct else Part(F.try_sum(col), "sum", col, ("bigint", DEC, "double", "double")[n.rank])
        count = Part(F.count_distinct(col)) if distinct else _counted(col)
        zero = F.lit(0)
        if f == "SUM":
            kind = ("int", "dec", "flt", "dbl")[n.rank]
            return [total], lambda r: Val(kind, F.coalesce(r[0], zero).cast({"int": "bigint", "dec": DEC}.get(kind, "double")))
        if n.rank < 2:
            return [total, count], lambda r: Val("dec", F.coalesce(F.try_divide(r[0].cast(DEC), r[1].cast(DEC)), F.lit(0)).cast(DEC))
        return [total, count], lambda r: Val(("", "", "flt", "dbl")[n.rank], F.coalesce(F.try_divide(r[0], r[1].cast("double")), F.lit(0.0)))
    # numbers of mixed types: by distinct terms where asked
    if distinct:
        cells = F.collect_set(F.struct(v.col.alias("k"), n.rank.alias("r"), n.dec.alias("d"), n.dbl.alias("f")))
        cells = F.filter(cells, lambda x: x["k"].isNotNull())
        rank = lambda r: F.array_max(F.transform(r, lambda x: x["r"]))
        dec = lambda r: F.aggregate(r, F.lit(0).cast(DEC), lambda a, x: F.try_add(a, x["d"]).cast(DEC))
        dbl = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x["f"])
        bad = lambda r: F.exists(r, lambda x: x["r"].isNull())
        return [Part(cells)], lambda r: _mixed(f, F.when(~bad(r[0]), F.coalesce(rank(r[0]), F.lit(0))), dec(r[0]), dbl(r[0]), F.size(r[0]))
    parts = [Part(F.max(n.rank), "max", n.rank), Part(F.try_sum(n.dec), "sum", n.dec, DEC), Part(F.sum(n.dbl), "sum", n.dbl, "double"), _counted(v.col), _counted(F.when(n.rank.isNull() & v.col.isNotNull(), 1))]
    return parts, lambda r: _mixed(f, F.when(r[4] == 0, F.coalesce(r[0], F.lit(0))), F.coalesce(r[1].try_cast(DEC), F.when(r[3] == 0, F.lit(0).cast(DEC))), F.coalesce(r[2], F.lit(0.0)), r[3])


def _mixed(f: str, rank: Column, dec: Column, dbl: Column, count: Column) -> Val:
    if f == "AVG":
        dec = F.when(count == 0, F.lit(0).cast(DEC)).otherwise(F.try_divide(dec, count.cast(DEC)).try_cast(DEC))
        dbl = F.coalesce(F.try_divide(dbl, count.cast("double")), F.lit(0.0))
        rank = F.when((rank == 0) & (count > 0), 1).otherwise(rank)
    return from_num(Num(rank, dec, dbl))


def aggregated(rel: Rel, keys: list[str], aggs: list, expressions) -> tuple[Rel, dict]:
    """(the groups, the variable of each aggregate by its identity)."""
    x = expressions(rel)
    for a in aggs:
        if a[3] is not None:
            x.prepare(a[3])
    rel = x.rel
    plans = [_plan(a, None if a[3] is None else x(a[3]), rel) for a in aggs]
    return _groups(rel, keys, aggs, [(make, [p.whole for p in parts]) for parts, make in plans])


def _groups(rel: Rel, keys: list[str], aggs: list, plans: list) -> tuple[Rel, dict]:
    cols = [c.alias(f"__a{i}_{j}") for i, (_, own) in enumerate(plans) for j, c in enumerate(own)]
    own = [k for k in keys if k in rel.reps]
    # a group by unbound keys only is one group, but only if there are rows
    grouped = rel.df.groupBy(*(column(k) for k in own)) if own or not keys else rel.df.withColumn("__one", F.lit(1)).groupBy("__one")
    df = grouped.agg(*(cols or [F.count(F.lit(1)).alias("__none")]))
    reps = {k: rel.reps[k] for k in own}
    names, out = {}, [column(k) for k in own]
    for i, (make, parts) in enumerate(plans):
        v = make([F.col(f"__a{i}_{j}") for j in range(len(parts))])
        var = f".agg{i}"
        rep, col = stored(v) if v.kind != "null" else (Rep(), sql_null("string"))
        reps[var] = rep
        out.append(col.alias(name_of(var)))
        names[id(aggs[i])] = var
    return Rel(df.select(*out), reps, {k for k in own if k in rel.certain}), names


def factored(a: Rel, b: Rel, keys: list[str], aggs: list, variables, expressions) -> tuple[Rel, dict] | None:
    """aggregated() over the join of a and b, where it isn't an equi-join and its aggregates are each of one side's variables; else None.

    Sides are parted as join() does. A part is grouped by its keys and what it joins on, with its number of rows, by which the
    other side's aggregates count. So no more pairs are made than groups of the two sides share.
    """
    shared, open_ = both(a, b)
    if shared and not open_ or len(open_) > 4:
        return None
    a, b = unified(a, b, shared)
    plans = []
    for agg in aggs:
        used = variables(agg[3]) & (a.reps.keys() | b.reps.keys())
        left = used <= a.reps.keys()
        if used & set(open_) or not left and not used <= b.reps.keys():
            return None
        home = a if left else b
        parts, make = _plan(agg, None if agg[3] is None else expressions(home)(agg[3]), home)
        if not all(p.kind for p in parts):
            return None
        plans.append((left, parts, make))
    rel = reduce(union, _leaves(a, b, keys, plans))
    merged = [
        (make, [p.merged([column(f".p{i}_{j}_{k}") for k in range(len(p.partial()))], column(".nb" if left else ".na")) for j, p in enumerate(parts)])
        for i, (left, parts, make) in enumerate(plans)
    ]
    return _groups(rel, keys, aggs, merged)


def _leaves(a: Rel, b: Rel, keys: list[str], plans: list) -> list[Rel]:
    shared, open_ = both(a, b)
    if open_:
        v = open_[0]
        parts = [(x, b) for x in parted(a, v)] if v not in a.certain else [(a, x) for x in parted(b, v)]
        return [r for x, y in parts for r in _leaves(x, y, keys, plans)]

    def side(r: Rel, left: bool) -> Rel:
        by = list(dict.fromkeys([*shared, *(k for k in keys if k in r.reps)]))
        n = ".na" if left else ".nb"
        cols = {n: F.count(F.lit(1))} | {f".p{i}_{j}_{k}": c for i, (own, parts, _) in enumerate(plans) if own == left for j, p in enumerate(parts) for k, c in enumerate(p.partial())}
        df = r.df.groupBy(*map(column, by)).agg(*(c.alias(name_of(v)) for v, c in cols.items())).where(column(n) > 0)
        return Rel(df, {k: r.reps[k] for k in by} | dict.fromkeys(cols, Rep("part")), r.certain & set(by) | cols.keys())

    return [join(side(a, True), side(b, False))]

"""RDF terms and SPARQL values as Spark columns.

A term's key is its N-Triples text; equal keys are equal terms. A Val is a column with a static kind: native columns stay
native, and only columns of kind "term" hold keys whose parts are taken apart where an expression needs them. A type error
is NULL, which makes SPARQL's three-valued logic Spark's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.parser import RDF, STRING, XSD

LANG, DIRLANG = RDF + "langString", RDF + "dirLangString"
#: The integer types that XSD derives.
DERIVED = {
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "unsignedLong": (0, None), "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 65535), "unsignedByte": (0, 255),
}
INTEGERS = [XSD + "integer", *(XSD + x for x in DERIVED)]
DEC = "decimal(38,18)"
NUMBERS = {"int": 0, "dec": 1, "flt": 2, "dbl": 3}
INT_RE, DEC_RE, DBL_RE = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"
TIME_RE = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?))?(Z|[+-][0-9]{2}:[0-9]{2})?$"


@dataclass
class Val:
    """kind: bool, int, dec, flt, dbl, str, iri, time (a lexical form), term (a key) or null."""

    kind: str
    col: Column | None
    lang: Column | None = None  # of a str; NULL is none
    way: Column | None = None
    dt: str | None = None  # of a time, or a derived integer
    prefix: str = ""  # of an iri: what stands before the column's value
    ts: Column | None = None  # of a time: it as a TIMESTAMP without zone

    def named(self, col: Column) -> Val:
        return replace(self, col=col)


NULL = Val("null", None)


def sql_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# -- keys --


def escape_py(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")


def key_py(t: tuple) -> str:
    """The key of a ground term."""
    if t[0] == "iri":
        return f"<{t[1]}>"
    if t[0] == "bnode":
        return f"_:{t[1]}"
    if t[0] == "triple":
        return f"<<( {' '.join(map(key_py, t[1:]))} )>>"
    _, lex, dt, lang, way = t
    tail = f"@{lang}" + (f"--{way}" if way else "") if lang else "" if dt == STRING else f"^^<{dt}>"
    return f'"{escape_py(lex)}"{tail}'


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    for a, b in (("\\\\", "\x01"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\x01", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decimal_text(c: Column) -> Column:
    c = c.cast(DEC).cast("string")
    return F.regexp_replace(F.regexp_replace(c, r"0+$", ""), r"\.$", ".0")


def double_text(c: Column) -> Column:
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").otherwise(c.cast("double").cast("string"))


def literal_key(lex: Column, dt: str) -> Column:
    return F.concat(F.lit('"'), lex, F.lit(f'"^^<{dt}>'))


def key(v: Val) -> Column:
    k, c = v.kind, v.col
    if k == "term":
        return c
    if k == "iri":
        return F.concat(F.lit("<" + v.prefix), c.cast("string"), F.lit(">"))
    if k == "str":
        plain = F.concat(F.lit('"'), escaped(c), F.lit('"'))
        if v.lang is None:
            return plain
        tail = F.concat(F.lit("@"), v.lang, F.coalesce(F.concat(F.lit("--"), v.way), F.lit("")) if v.way is not None else F.lit(""))
        return F.concat(plain, F.coalesce(tail, F.lit("")))
    if k == "time":
        return literal_key(lex_of(v), v.dt)
    text = {"int": lambda: c.cast("string"), "dec": lambda: decimal_text(c), "flt": lambda: double_text(c), "dbl": lambda: double_text(c), "bool": lambda: c.cast("string")}
    names = {"int": "integer", "dec": "decimal", "flt": "float", "dbl": "double", "bool": "boolean"}
    return literal_key(text[k](), v.dt or XSD + names[k]) if k in names else sql_null("string")


def as_term(v: Val) -> Val:
    return Val("term", key(v))


def const(t: tuple) -> Val:
    """A constant, native if its lexical form is the canonical one of its type."""
    if t[0] == "iri":
        return Val("iri", F.lit(t[1]))
    if t[0] != "lit":
        return Val("term", F.lit(key_py(t)))
    _, lex, dt, lang, way = t
    if lang:
        return Val("str", F.lit(lex), F.lit(lang), F.lit(way) if way else None)
    if dt == STRING:
        return Val("str", F.lit(lex))
    if dt == XSD + "integer" and re.fullmatch(r"0|-?[1-9][0-9]{0,17}", lex):
        return Val("int", F.lit(int(lex)).cast("bigint"))
    if dt == XSD + "boolean" and lex in ("true", "false"):
        return Val("bool", F.lit(lex == "true"))
    if dt == XSD + "decimal" and re.fullmatch(r"-?(0|[1-9][0-9]{0,17})\.([0-9]{0,17}[1-9]|0)", lex):
        return Val("dec", F.lit(lex).cast(DEC))
    if dt == XSD + "double" and re.fullmatch(DBL_RE, lex):
        return Val("dbl", F.lit(float(lex.replace("INF", "inf"))))
    if dt in (XSD + "dateTime", XSD + "date") and re.match(TIME_RE, lex):
        return Val("time", F.lit(lex), dt=dt)
    return Val("term", F.lit(key_py(t)))


# -- parts of terms --

_LIT = r'(?s)^"(.*)"(?:@([a-z0-9-]+?)(?:--(ltr|rtl))?|\^\^<([^>]*)>)?$'


def let(c: Column, f) -> Column:
    """f of a column that is evaluated, and stands in the plan, once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def _plain(c: Column) -> Column:
    return F.when(c.contains("\\"), unescaped(c)).otherwise(c)


def raw_lex(c: Column) -> Column:
    return let(F.regexp_extract(c, _LIT, 1), _plain)


def lang_part(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _LIT, 2), F.lit(""))


def way_part(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _LIT, 3), F.lit(""))


def dt_part(c: Column) -> Column:
    """The datatype of a literal's key; NULL for other terms."""

    def of(k):
        own = F.regexp_extract(k, _LIT, 4)
        return F.when(is_literal(k), F.when(own != "", own).when(way_part(k).isNotNull(), DIRLANG).when(lang_part(k).isNotNull(), LANG).otherwise(STRING))

    return let(c, of)


def _integer(dt: Column, lex: Column) -> Column:
    """Whether a literal of an integer type is in its range."""
    wide = lex.try_cast("decimal(38,0)")
    out = F.when(dt == XSD + "integer", lex.try_cast("bigint").isNotNull())
    for name, (lo, hi) in DERIVED.items():
        inside = lex.try_cast("bigint").isNotNull()
        inside = inside if lo is None else inside & (wide >= lo)
        out = out.when(dt == XSD + name, inside if hi is None else inside & (wide <= hi))
    return F.coalesce(out, F.lit(False))


def lanes(c: Column) -> Column:
    """A struct of a key's parts: key, lex, dt, lang, way of a literal, and its number, boolean and string."""

    def values(p):
        lex, dt = p["lex"], p["dt"]
        rank = F.when(_integer(dt, lex) & lex.rlike(INT_RE), 0).when((dt == XSD + "decimal") & lex.rlike(DEC_RE) & lex.try_cast(DEC).isNotNull(), 1)
        rank = rank.when((dt == XSD + "float") & lex.rlike(DBL_RE), 2).when((dt == XSD + "double") & lex.rlike(DBL_RE), 3)
        dbl = F.regexp_replace(F.regexp_replace(lex, r"^\+", ""), "INF$", "Infinity").try_cast("double")
        boolean_ = F.when(dt == XSD + "boolean", F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False))
        string = F.when(dt.isin(STRING, LANG, DIRLANG), lex)
        return F.struct(p["key"].alias("key"), lex.alias("lex"), dt.alias("dt"), p["lang"].alias("lang"), p["way"].alias("way"), rank.alias("rank"), lex.try_cast(DEC).alias("dec"), dbl.alias("dbl"), boolean_.alias("bool"), string.alias("string"))

    def numbers(p):
        dec, dbl, rank = p["dec"], p["dbl"], p["rank"]
        dbl = F.when(rank.isNotNull(), F.when(rank == 2, dbl.cast("float").cast("double")).otherwise(dbl))
        return p.withField("dec", F.when(rank < 2, dec)).withField("dbl", dbl)

    return let(let(let(c, lambda k: F.struct(k.alias("key"), raw_lex(k).alias("lex"), dt_part(k).alias("dt"), lang_part(k).alias("lang"), way_part(k).alias("way"))), values), numbers)


def lex_of(v: Val) -> Column:
    """STR(): NULL for blank nodes and triple terms."""
    k, c = v.kind, v.col
    if k == "term":
        return F.when(is_literal(c), raw_lex(c)).when(c.startswith("<") & ~c.startswith("<<("), F.substring(c, F.lit(2), F.length(c) - 2))
    if k == "iri":
        return F.concat(F.lit(v.prefix), c.cast("string")) if v.prefix else c.cast("string")
    if k == "time":
        return c if v.ts is None else _ts_text(v.ts)
    return {"str": lambda: c, "int": lambda: c.cast("string"), "dec": lambda: decimal_text(c), "flt": lambda: double_text(c), "dbl": lambda: double_text(c), "bool": lambda: c.cast("string")}.get(k, lambda: sql_null("string"))()


def _ts_text(ts: Column) -> Column:
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0{6}$|(?<=\.[0-9]{1,5}[1-9])0+$", "")


def string_arg(v: Val) -> tuple[Column, Column | None, Column | None]:
    """(lexical, language, direction) of a string literal; NULLs for anything else."""
    if v.kind == "str":
        return v.col, v.lang, v.way
    if v.kind == "term":
        dt = dt_part(v.col)
        return F.when(dt.isin(STRING, LANG, DIRLANG), raw_lex(v.col)), lang_part(v.col), way_part(v.col)
    return sql_null("string"), None, None


# -- numbers --


@dataclass
class Num:
    rank: int | Column  # 0 integer, 1 decimal, 2 float, 3 double; NULL is no number
    dec: Column
    dbl: Column


def lanes_num(p: Column) -> Num:
    return Num(p["rank"], p["dec"], p["dbl"])


def native_num(v: Val) -> Num:
    exact = v.kind in ("int", "dec")
    return Num(NUMBERS[v.kind], v.col.cast(DEC) if exact else sql_null(DEC), v.col.cast("double"))


def number(v: Val) -> Num | None:
    """A value as a number; None where its kind is never one."""
    if v.kind in NUMBERS:
        return native_num(v)
    return lanes_num(lanes(v.col)) if v.kind == "term" else None


def with_numbers(vals: list[Val], f) -> Column | None:
    """f of the values' Nums, the parts of each key taken once; None if a value is never a number."""
    if any(v.kind not in NUMBERS and v.kind != "term" for v in vals):
        return None

    def step(rest, done):
        if not rest:
            return f(*done)
        v = rest[0]
        if v.kind == "term":
            return let(lanes(v.col), lambda p: step(rest[1:], [*done, lanes_num(p)]))
        return step(rest[1:], [*done, native_num(v)])

    return step(vals, [])


def from_num(n: Num) -> Val:
    if isinstance(n.rank, int):
        kind = ("int", "dec", "flt", "dbl")[n.rank]
        return Val(kind, n.dec.try_cast("bigint") if n.rank == 0 else n.dec if n.rank == 1 else n.dbl)
    texts = [(0, n.dec.try_cast("bigint").cast("string"), "integer"), (1, decimal_text(n.dec), "decimal"), (2, double_text(n.dbl), "float"), (3, double_text(n.dbl), "double")]
    return Val("term", reduce(lambda w, x: w.when(n.rank == x[0], literal_key(x[1], XSD + x[2])), texts, F.when(F.lit(False), sql_null("string"))))


def _combined(op: str, x: Num, y: Num) -> Num:
    static = isinstance(x.rank, int) and isinstance(y.rank, int)
    if static:
        rank = max(x.rank, y.rank)
    else:
        ranks = [F.lit(r) if isinstance(r, int) else r for r in (x.rank, y.rank)]
        rank = F.when(ranks[0].isNotNull() & ranks[1].isNotNull(), F.greatest(*ranks))
    if op == "*":
        dec = F.try_multiply(x.dec.try_cast("decimal(38,9)"), y.dec.try_cast("decimal(38,9)")).try_cast(DEC)
    else:
        dec = {"+": F.try_add, "-": F.try_subtract, "/": F.try_divide}[op](x.dec, y.dec).try_cast(DEC)
    if op == "/":
        p, q = x.dbl, y.dbl
        inf = F.lit(float("inf"))
        zero = F.when(F.isnan(p) | (p == 0), F.lit(float("nan"))).otherwise(F.when((p > 0) == ~q.cast("string").startswith("-"), inf).otherwise(-inf))
        dbl = F.when(q == 0, zero).otherwise(F.try_divide(p, q))
        rank = max(rank, 1) if static else F.when(rank.isNotNull(), F.greatest(rank, F.lit(1)))
    else:
        dbl = {"+": x.dbl + y.dbl, "-": x.dbl - y.dbl, "*": x.dbl * y.dbl}[op]
    return Num(rank, dec, dbl)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if a.kind == b.kind == "int" and op != "/":
        return Val("int", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col.cast("bigint"), b.col.cast("bigint")))
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return from_num(_combined(op, native_num(a), native_num(b)))
    out = with_numbers([a, b], lambda x, y: key(from_num(_combined(op, x, y))))
    return NULL if out is None else Val("term", out)


def negated(v: Val) -> Val:
    return arithmetic("-", Val("int", F.lit(0).cast("bigint")), v)


# -- times --


def moment(lex: Column, dt: Column) -> Column:
    """A struct of microseconds, whether there is a zone, and the datatype, of a dateTime's or date's lexical form."""

    def of(x):
        zone = F.regexp_extract(x, TIME_RE, 7)
        local = F.regexp_replace(x, r"(Z|[+-][0-9]{2}:[0-9]{2})$", "")
        micros = F.unix_micros(F.when(x.rlike(TIME_RE), F.replace(local, F.lit("T"), F.lit(" "))).try_cast("timestamp"))
        minutes = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
        shift = F.when(zone.rlike("^[+-]"), minutes).otherwise(0)
        return F.struct((micros - shift.cast("bigint") * 60_000_000).alias("at"), (zone != "").alias("zone"), dt.alias("dt"))

    return let(lex, of)


def timeline(v: Val) -> Column:
    """moment() of a Val; a NULL one if it is no dateTime or date."""
    if v.kind == "time" and v.ts is not None:
        return F.struct(F.unix_micros(v.ts.cast("timestamp")).alias("at"), F.lit(False).alias("zone"), F.lit(v.dt).alias("dt"))
    return moment(v.col, F.lit(v.dt))


def _temporal(op: str, a: Val, b: Val) -> Column:
    if a.ts is not None and b.ts is not None:
        return _ops(op)(a.ts, b.ts)
    return let(timeline(a), lambda p: let(timeline(b), lambda q: _temporal_parts(op, p, q)))


def _temporal_parts(op: str, p: Column, q: Column) -> Column:
    """Without a zone a time may be anywhere in 14 hours on either side."""
    sure = (p["zone"] == q["zone"]) | (F.abs(p["at"] - q["at"]) > 14 * 3_600_000_000)
    return F.when((p["dt"] == q["dt"]) & sure, _ops(op)(p["at"], q["at"]))


def _ops(op: str):
    return {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]


# -- comparison --


def _numeric(op: str, x: Num, y: Num) -> Column:
    compare = _ops(op)
    if isinstance(x.rank, int) and isinstance(y.rank, int):
        if max(x.rank, y.rank) < 2:
            return compare(x.dec, y.dec)
        return F.when(~(F.isnan(x.dbl) | F.isnan(y.dbl)), compare(x.dbl, y.dbl))
    exact = compare(x.dec, y.dec)
    return F.when(x.dec.isNotNull() & y.dec.isNotNull(), exact).when(~(F.isnan(x.dbl) | F.isnan(y.dbl)), compare(x.dbl, y.dbl))


def _lang(v: Val) -> Column:
    return F.coalesce(v.lang, F.lit("")) if v.lang is not None else F.lit("")


def compare(op: str, a: Val, b: Val) -> Column:
    """SPARQL's = != < > <= >=; NULL where the operands cannot be compared."""
    if "null" in (a.kind, b.kind):
        return sql_null("boolean")
    ks = {a.kind, b.kind}
    equality = op in ("=", "!=")
    if ks <= set(NUMBERS):
        if ks == {"int"}:
            return _ops(op)(a.col, b.col)
        return _numeric(op, number(a), number(b))
    if ks == {"str"}:
        if a.lang is None and b.lang is None:
            return _ops(op)(a.col, b.col)
        if equality:
            same = (a.col == b.col) & (F.lower(_lang(a)) == F.lower(_lang(b)))
            return same if op == "=" else ~same
        return F.when(F.lower(_lang(a)) == F.lower(_lang(b)), _ops(op)(a.col, b.col))
    if ks == {"bool"}:
        return _ops(op)(a.col, b.col)
    if ks == {"time"}:
        return _temporal(op, a, b)
    if ks == {"iri"} and equality:
        same = a.col == b.col if a.prefix == b.prefix else lex_of(a) == lex_of(b)
        return same if op == "=" else ~same
    if "term" not in ks:
        if "iri" in ks and equality:  # a literal is never an IRI
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "!="))
        return sql_null("boolean")
    return let(lanes(key(a)), lambda x: let(lanes(key(b)), lambda y: _compare_lanes(op, x, y)))


def _compare_lanes(op: str, x: Column, y: Column) -> Column:
    equality = op in ("=", "!=")
    out = F.when(x["rank"].isNotNull() & y["rank"].isNotNull(), _numeric(op, lanes_num(x), lanes_num(y)))
    if equality:
        out = out.when(x["key"] == y["key"], F.lit(op == "="))
    la, lb = F.coalesce(x["lang"], F.lit("")), F.coalesce(y["lang"], F.lit(""))
    strings = x["string"].isNotNull() & y["string"].isNotNull()
    out = out.when(strings, F.lit(op == "!=")) if equality else out.when(strings & (la == lb), _ops(op)(x["string"], y["string"]))
    out = out.when(x["bool"].isNotNull() & y["bool"].isNotNull(), _ops(op)(x["bool"], y["bool"]))
    times = [XSD + "dateTime", XSD + "date"]
    out = out.when(x["dt"].isin(times) & y["dt"].isin(times), let(moment(x["lex"], x["dt"]), lambda p: let(moment(y["lex"], y["dt"]), lambda q: _temporal_parts(op, p, q))))
    if equality:
        out = out.when(x["key"].isNotNull() & y["key"].isNotNull() & ~(is_literal(x["key"]) & is_literal(y["key"])), F.lit(op == "!="))
    return out


def boolean(v: Val) -> Column:
    if v.kind == "bool":
        return v.col
    return lanes(v.col)["bool"] if v.kind == "term" else sql_null("boolean")


def ebv(v: Val) -> Column:
    """The effective boolean value; NULL is an error."""
    if v.kind == "bool":
        return v.col
    if v.kind in ("int", "dec"):
        return v.col != 0
    if v.kind in ("flt", "dbl"):
        return (v.col != 0) & ~F.isnan(v.col)
    if v.kind == "str":
        return v.col != "" if v.lang is None else F.when(v.lang.isNull(), v.col != "")
    if v.kind == "term":
        return let(lanes(v.col), lambda p: F.when(p["rank"].isNotNull(), (p["dbl"] != 0) & ~F.isnan(p["dbl"])).when(p["dt"] == STRING, p["lex"] != "").otherwise(p["bool"]))
    return sql_null("boolean")


def same_term(a: Val, b: Val) -> Column:
    if a.kind == b.kind and a.kind in ("int", "bool", "iri", "str") and a.prefix == b.prefix and a.lang is None and b.lang is None and a.dt == b.dt:
        return a.col == b.col
    return key(a) == key(b)


def order_key(v: Val) -> Column:
    """A column whose order is SPARQL's: unbound, blank nodes, IRIs, literals by class and value, triple terms."""
    if v.kind in ("int", "dec", "flt", "dbl", "bool") or v.kind == "str" and v.lang is None:
        return v.col
    if v.kind == "time" and v.ts is not None:
        return v.ts
    if v.kind == "iri":
        return v.col if not v.prefix else lex_of(v)
    if v.kind == "null":
        return sql_null("string")
    return let(lanes(key(v)), _order_lanes)


def _order_lanes(p: Column) -> Column:
    c = p["key"]
    times = p["dt"].isin(XSD + "dateTime", XSD + "date")
    rank = F.when(c.startswith("_"), 1).when(c.startswith("<<("), 4).when(c.startswith("<"), 2).otherwise(3)
    kind = F.when(rank != 3, 0).when(p["rank"].isNotNull(), 1).when(p["string"].isNotNull() & p["lang"].isNull(), 2).when(p["string"].isNotNull(), 3).when(p["bool"].isNotNull(), 4).when(times, 5).otherwise(6)

    def made(k):
        tag = F.when(k == 3, p["lang"]).when(k.isin(5, 6), p["dt"]).otherwise("")
        text = F.when(k.isin(2, 3), p["string"]).when(k == 0, c).when(k.isin(5, 6), p["lex"]).otherwise("")
        at = F.when(k == 5, moment(p["lex"], p["dt"])["at"])
        value = F.when(k == 1, p["dbl"]).when(k == 4, p["bool"].cast("double"))
        return F.struct(rank.alias("a"), k.alias("b"), tag.alias("c"), at.alias("d"), value.alias("e"), text.alias("f"))

    return F.when(c.isNotNull(), let(kind, made))

"""RDF files as quads (s, p, o, g) of keys.

N-Triples and N-Quads are read line by line, so that files split; the other syntaxes are parsed a file in a task. Blank node
labels are scoped to their file.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import key_py
from tessera.plans.parser import Parser, SparqlError

from .interchange import parse_jsonld, parse_rdfxml, write_jsonld, write_rdfxml
from .turtle import parse_trig, parse_turtle

TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
QUAD = "s string, p string, o string, g string"
#: The syntax of an extension or media type.
FORMATS = {
    "nt": "nt", "nq": "nq", "ttl": "ttl", "trig": "trig", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "jsonld": "jsonld", "json": "jsonld",
    "application/n-triples": "nt", "application/n-quads": "nq", "text/turtle": "ttl", "application/trig": "trig", "application/rdf+xml": "rdfxml", "application/ld+json": "jsonld",
}
WRITERS = {"rdfxml": write_rdfxml, "jsonld": write_jsonld}
PARSERS = {"ttl": parse_turtle, "trig": parse_trig, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld}
_IRI, _BLANK = r'<[^<>"{}|^`\\\x00-\x20]*+>', r"_:[A-Za-z0-9](?:[A-Za-z0-9_-]|\.(?=[A-Za-z0-9_.-]*+[A-Za-z0-9_-]))*+"
_LITERAL = rf'"[^"\\]*+"(?:@[a-z]++(?:-[a-z0-9]++)*+(?![-A-Z])|\^\^(?!<http://www\.w3\.org/2001/XMLSchema#string>){_IRI})?+'
#: Lines that hold keys as they are, one blank between terms: no escape, upper-case language, direction or triple term.
PLAIN = rf"^(?:{_IRI}|{_BLANK}) {_IRI} (?:{_IRI}|{_BLANK}|{_LITERAL})%s \.$"
GRAPH = rf" ({_IRI}|{_BLANK})$"


def format_of(name: str) -> str:
    """The syntax of a path or media type."""
    if name in FORMATS:
        return FORMATS[name]
    ext = name.rsplit(".", 2)[-2] if name.endswith((".gz", ".bz2", ".zst")) else name.rsplit(".", 1)[-1]
    if ext.lower() not in FORMATS:
        raise ValueError(f"no known syntax: {name}")
    return FORMATS[ext.lower()]


def canonical(line: str, scope: str, quads: bool = True) -> tuple | None:
    """A line of N-Quads as keys, by the full grammar; None if it is blank."""
    if not line.strip() or line.lstrip().startswith("#"):
        return None
    p = Parser(line)
    terms = []
    while p.text != ".":
        t = p.term(None)
        terms.append(t)
    p.need(".")
    if p.kind != "end" or len(terms) not in ((3, 4) if quads else (3,)) or terms[1][0] != "iri" or terms[0][0] == "lit":
        raise SparqlError(f"not a statement: {line[:80]}")

    def named(t):
        if t[0] == "bnode":
            return ("bnode", f"{scope}_{t[1]}")
        return ("triple", *map(named, t[1:])) if t[0] == "triple" else t

    keys = [key_py(named(t)) for t in terms]
    return (*keys, *[None] * (4 - len(keys)))


def parsed(text: str, syntax: str, base: str) -> list[tuple]:
    """The quads of a small document of any syntax."""
    if syntax in ("nt", "nq"):
        return [q for line in text.splitlines() if (q := canonical(line, "f0", syntax == "nq"))]
    return PARSERS[syntax](text, base, "f0")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["s", "p", "o", "g"])


def read_lines(spark: SparkSession, path: str, quads: bool = True, lenient: bool = False, spec12: bool = True) -> DataFrame:
    """N-Quads or N-Triples. Lines in the form that writers give are checked by one pattern in the JVM and cut at their
    blanks; others (escapes, white space, comments, triple terms, errors) go through the parser, which raises on a line that
    is no statement."""
    scope = F.concat(F.lit("f"), F.substring(F.md5(F.input_file_name()), 1, 8))
    lines = spark.read.text(path).select("value", scope.alias("scope"))
    plain = F.col("value").rlike(PLAIN % (rf"(?: (?:{_IRI}|{_BLANK}))?" if quads else ""))

    def scoped(c: Column) -> Column:
        return F.when(c.startswith("_:"), F.concat(F.lit("_:"), F.col("scope"), F.lit("_"), F.substring(c, F.lit(3), F.length(c)))).otherwise(c)

    first = lambda c: F.substring_index(c, " ", 1)
    after = lambda c, x: F.substring(c, F.length(x) + 2, F.length(c))
    easy = lines.where(plain).select("scope", first(F.col("value")).alias("s"), F.expr("substring(value, 1, length(value) - 2)").alias("v"))
    easy = easy.select("scope", "s", after(F.col("v"), F.col("s")).alias("v")).select("scope", "s", first(F.col("v")).alias("p"), "v")
    easy = easy.select("scope", "s", "p", after(F.col("v"), F.col("p")).alias("o"))
    graph = F.when(F.col("o").contains(" "), F.nullif(F.regexp_extract("o", GRAPH, 1), F.lit(""))) if quads else F.lit(None).cast("string")
    easy = easy.withColumn("g", graph)
    own = F.when(F.col("g").isNull(), F.col("o")).otherwise(F.substring(F.col("o"), F.lit(1), F.length("o") - F.length("g") - 1))
    easy = easy.select(scoped(F.col("s")).alias("s"), "p", scoped(own).alias("o"), scoped(F.col("g")).alias("g"))
    hard = lines.where(~plain & ~F.col("value").rlike(r"^\s*(#.*)?$"))

    def run(batches):
        for batch in batches:
            found = []
            for v, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    q = canonical(v, s, quads)
                    if q and not spec12 and any(x and (x.startswith("<<(") or x.startswith('"') and x.rpartition('"')[2].endswith(("--ltr", "--rtl"))) for x in q):
                        raise SparqlError(f"RDF 1.2: {v[:80]}")
                    found.append(q)
                except SparqlError:
                    if not lenient:
                        raise
            yield _rows([q for q in found if q])

    return easy.union(hard.mapInArrow(run, QUAD))


def read_documents(spark: SparkSession, path: str, syntax: str, base: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parse = PARSERS[syntax]

    def run(batches):
        import hashlib

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse(content.decode("utf-8-sig"), base or name, "f" + hashlib.md5(name.encode()).hexdigest()[:8])
                for lo in range(0, len(rows), 10_000):
                    yield _rows(rows[lo : lo + 10_000])

    return files.mapInArrow(run, QUAD)


def read(spark: SparkSession, path: str, syntax: str | None = None, base: str | None = None, lenient: bool = False, spec12: bool = True) -> DataFrame:
    """The statements of a file or folder; repeated ones stay. Of N-Triples and N-Quads, lenient leaves lines out that are no
    statements, and without spec12 triple terms and directions are errors."""
    syntax = syntax or format_of(path)
    return read_lines(spark, path, syntax == "nq", lenient, spec12) if syntax in ("nt", "nq") else read_documents(spark, path, syntax, base)


def lines(quads: DataFrame, graphs: bool = True) -> DataFrame:
    """A row `value` for each quad in canonical N-Quads, or N-Triples, which has no named graphs."""
    if graphs:
        return quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value"))
    checked = F.when(F.col("g").isNull(), F.concat_ws(" ", "s", "p", "o", F.lit("."))).otherwise(F.raise_error(F.lit("a named graph in N-Triples")))
    return quads.select(checked.alias("value"))


def write(quads: DataFrame, path: str, syntax: str | None = None, prefixes: dict[str, str] | None = None) -> None:
    """Writes a folder of files, each a document: N-Quads, N-Triples, Turtle, TriG (both with prefixes), RDF/XML, JSON-LD."""
    syntax = syntax or format_of(path)
    if syntax in ("nt", "nq"):
        lines(quads, syntax == "nq").write.text(path)
    elif syntax in ("ttl", "trig"):
        head = [f"@prefix {k}: <{v}> ." for k, v in (prefixes or {}).items()]
        framed(grouped(quads, syntax == "trig", prefixes or {}), head, []).write.text(path)
    elif syntax in WRITERS:
        quads.select("s", "p", "o", "g").mapInArrow(WRITERS[syntax], "value string").write.text(path)
    else:
        raise ValueError(f"no writer for {syntax}")


def framed(rows: DataFrame, head: list[str], tail: list[str]) -> DataFrame:
    """rows(value) with lines before and after those of each partition that has any."""

    def run(batches):
        some = False
        for batch in batches:
            if batch.num_rows and not some and head:
                yield pa.RecordBatch.from_arrays([pa.array(head)], ["value"])
            some = some or batch.num_rows > 0
            yield batch
        if some and tail:
            yield pa.RecordBatch.from_arrays([pa.array(tail)], ["value"])

    return rows.mapInArrow(run, "value string") if head or tail else rows


def shortened(c: Column, prefixes: dict[str, str]) -> Column:
    """IRIs as prefixed names, where what follows the namespace is a plain name."""
    for name, space in prefixes.items():
        c = F.regexp_replace(c, F.lit(rf"^<{re.escape(space)}([A-Za-z_][A-Za-z0-9_-]*)>$"), F.lit(f"{name}:$1"))
    return c


def grouped(quads: DataFrame, graphs: bool, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A row `value` for each subject and graph: its predicates and objects as one Turtle or TriG block."""
    if not graphs:
        quads = quads.withColumn("g", F.when(F.col("g").isNull(), F.col("g")).otherwise(F.raise_error(F.lit("a named graph in Turtle")).cast("string")))
    quads = quads.select(*(shortened(F.col(c), prefixes or {}).alias(c) for c in ("s", "o", "g")), F.when(F.col("p") == TYPE, "a").otherwise(shortened(F.col("p"), prefixes or {})).alias("p"))
    objects = quads.distinct().groupBy("g", "s", "p").agg(F.array_join(F.sort_array(F.collect_list("o")), " , ").alias("o"))
    own = objects.groupBy("g", "s").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n    ").alias("po"))
    body = F.concat(F.col("s"), F.lit(" "), F.col("po"), F.lit(" ."))
    return own.select(F.when(F.col("g").isNull(), body).otherwise(F.concat(F.col("g"), F.lit(" { "), body, F.lit(" }"))).alias("value"))

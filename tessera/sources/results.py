"""SPARQL results as JSON, XML, CSV and TSV: a line a solution from Spark, and a header and footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import STRING, Val, dt_part, is_literal, key, lang_part, lex_of, way_part

MEDIA = {
    "application/sparql-results+json": "json", "application/json": "json", "application/sparql-results+xml": "xml", "text/csv": "csv", "text/tab-separated-values": "tsv",
    "application/n-triples": "nt", "text/turtle": "ttl",
}


def negotiated(accept: str, offered: list[str]) -> str | None:
    """The offered media type that an Accept header prefers; ties go to the first offered."""
    best = (0.0, None)
    for m in offered:
        for part in accept.split(","):
            name, *params = [x.strip() for x in part.split(";")]
            q = next((float(p[2:]) for p in params if p.startswith("q=")), 1.0)
            if name in (m, "*/*", m.split("/")[0] + "/*") and q > best[0]:
                best = (q, m)
    return best[1]


def _keys(rel) -> dict[str, Column]:
    return {v: key(rel.val(v)) for v in rel.reps if not v.startswith(".")}


def _lex(c: Column) -> Column:
    return F.when(c.startswith("_:"), F.substring(c, F.lit(3), F.length(c))).otherwise(lex_of(Val("term", c)))


def _json(c: Column) -> Column:
    kind = F.when(is_literal(c), "literal").when(c.startswith("_"), "bnode").when(c.startswith("<<("), "triple").otherwise("uri")
    dt = F.when(is_literal(c) & lang_part(c).isNull() & (dt_part(c) != STRING), dt_part(c))
    return F.when(c.isNotNull(), F.struct(kind.alias("type"), F.coalesce(_lex(c), c).alias("value"), lang_part(c).alias("xml:lang"), way_part(c).alias("its:dir"), dt.alias("datatype")))


def _xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _xml(v: str, c: Column) -> Column:
    attrs = F.when(lang_part(c).isNotNull(), F.concat(F.lit(' xml:lang="'), lang_part(c), F.lit('"'))).when(dt_part(c) != STRING, F.concat(F.lit(' datatype="'), _xml_text(dt_part(c)), F.lit('"'))).otherwise("")
    body = F.when(is_literal(c), F.concat(F.lit("<literal"), attrs, F.lit(">"), _xml_text(_lex(c)), F.lit("</literal>"))).when(c.startswith("_"), F.concat(F.lit("<bnode>"), _lex(c), F.lit("</bnode>"))).otherwise(F.concat(F.lit("<uri>"), _xml_text(_lex(c)), F.lit("</uri>")))
    return F.when(c.isNotNull(), F.concat(F.lit(f'<binding name="{v}">'), body, F.lit("</binding>"))).otherwise("")


def _csv(c: Column) -> Column:
    text = F.when(c.startswith("_:"), c).otherwise(_lex(c))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), "").when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def lines(result, syntax: str) -> tuple[str, DataFrame, str]:
    """(header, a DataFrame of a `value` a solution, footer); JSON's solutions are to be joined by commas."""
    if result.form == "ask":
        word = str(result.answer).lower()
        spark = result.df.sparkSession
        text = {"json": f'{{"head":{{}},"boolean":{word}}}', "xml": f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{word}</boolean></sparql>'}.get(syntax, word)
        return text, spark.createDataFrame([], "value string"), ""
    keys = _keys(result.rel)
    df = result.rel.df
    if syntax == "json":
        names = ",".join(f'"{v}"' for v in keys)
        row = F.to_json(F.struct(*(_json(c).alias(v) for v, c in keys.items())) if keys else F.struct(F.lit(None).cast("string").alias("x")))
        return f'{{"head":{{"vars":[{names}]}},"results":{{"bindings":[', df.select(row.alias("value")), "]}}"
    if syntax == "xml":
        head = "".join(f'<variable name="{v}"/>' for v in keys)
        row = F.concat(F.lit("<result>"), *(_xml(v, c) for v, c in keys.items()), F.lit("</result>"))
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>', df.select(row.alias("value")), "</results></sparql>"
    if syntax == "csv":
        return ",".join(keys), df.select(F.concat_ws(",", *(_csv(c) for c in keys.values())).alias("value")), ""
    if syntax == "tsv":
        cells = [F.coalesce(F.replace(c, F.lit("\t"), F.lit("\\t")), F.lit("")) for c in keys.values()]
        return "\t".join(f"?{v}" for v in keys), df.select(F.concat_ws("\t", *cells).alias("value")), ""
    raise ValueError(f"no results syntax {syntax}")


def text(result, syntax: str) -> str:
    """A small result as one string."""
    if result.form in ("construct", "describe"):
        return "".join(f"{r.s} {r.p} {r.o} .\n" for r in result.df.collect())
    head, rows, foot = lines(result, syntax)
    end = "\r\n" if syntax == "csv" else "\n"
    body = [r.value for r in rows.collect()]
    if syntax == "json":
        return head + ",".join(body) + foot
    return end.join([head, *body]) + end + foot if syntax in ("csv", "tsv") else head + "".join(body) + foot

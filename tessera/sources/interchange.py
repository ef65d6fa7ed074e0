"""RDF/XML and the inline-context part of JSON-LD as quads of keys, and back."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa

from tessera.functions.values import key_py
from tessera.plans.parser import RDF, STRING, XSD, Parser, lit, resolve

XML = "{http://www.w3.org/XML/1998/namespace}"
R = f"{{{RDF}}}"


class XmlReader:
    def __init__(self, base: str | None, scope: str):
        self.base, self.scope, self.out, self.fresh = base, scope, [], 0

    def blank(self, label: str | None = None) -> tuple:
        if label is None:
            self.fresh += 1
            return ("bnode", f"{self.scope}_x{self.fresh}")
        return ("bnode", f"{self.scope}_{label}")

    def add(self, s, p, o):
        self.out.append((key_py(s), key_py(p), key_py(o), None))

    @staticmethod
    def iri_of(tag: str) -> str:
        ns, _, local = tag[1:].partition("}")
        return ns + local

    def node(self, e, base, lang) -> tuple:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        if R + "about" in e.attrib:
            s = ("iri", resolve(base, e.get(R + "about")))
        elif R + "ID" in e.attrib:
            s = ("iri", resolve(base, "#" + e.get(R + "ID")))
        else:
            s = self.blank(e.get(R + "nodeID"))
        if e.tag != R + "Description":
            self.add(s, ("iri", RDF + "type"), ("iri", self.iri_of(e.tag)))
        self.attributes(s, e, lang)
        self.properties(s, e, base, lang)
        return s

    def attributes(self, s, e, lang):
        for name, value in e.attrib.items():
            if name.startswith(XML) or name in (R + "about", R + "ID", R + "nodeID", R + "resource", R + "datatype", R + "parseType"):
                continue
            p = self.iri_of(name) if name.startswith("{") else name
            self.add(s, ("iri", p), ("iri", value) if p == RDF + "type" else self.text(value, lang))

    @staticmethod
    def text(value, lang, dt=None):
        if dt:
            return lit(value, dt)
        return ("lit", value, RDF + "langString", lang.lower(), None) if lang else lit(value)

    def properties(self, s, e, base, lang):
        number = 0
        for c in e:
            here, own = c.get(XML + "base", base), c.get(XML + "lang", lang)
            p = self.iri_of(c.tag)
            if p == RDF + "li":
                number += 1
                p = f"{RDF}_{number}"
            parse = c.get(R + "parseType")
            kids = list(c)
            if parse == "Resource":
                o = self.blank()
                self.properties(o, c, here, own)
            elif parse == "Collection":
                items = [self.node(k, here, own) for k in kids]
                cells = [self.blank() for _ in items]
                for i, (cell, item) in enumerate(zip(cells, items, strict=True)):
                    self.add(cell, ("iri", RDF + "first"), item)
                    self.add(cell, ("iri", RDF + "rest"), cells[i + 1] if i + 1 < len(cells) else ("iri", RDF + "nil"))
                o = cells[0] if cells else ("iri", RDF + "nil")
            elif parse is not None:
                inner = (c.text or "") + "".join(ET.tostring(k, encoding="unicode") for k in kids)
                o = lit(inner, RDF + "XMLLiteral")
            elif R + "resource" in c.attrib:
                o = ("iri", resolve(here, c.get(R + "resource")))
                self.attributes(o, c, own)
            elif R + "nodeID" in c.attrib:
                o = self.blank(c.get(R + "nodeID"))
            elif kids:
                o = self.node(kids[0], here, own)
            elif any(not n.startswith(XML) and n not in (R + "datatype", R + "ID") for n in c.attrib):
                o = self.blank()
                self.attributes(o, c, own)
            else:
                o = self.text(c.text or "", own, c.get(R + "datatype"))
            self.add(s, ("iri", p), o)
            if R + "ID" in c.attrib:
                r = ("iri", resolve(here, "#" + c.get(R + "ID")))
                for q, v in (("type", ("iri", RDF + "Statement")), ("subject", s), ("predicate", ("iri", p)), ("object", o)):
                    self.add(r, ("iri", RDF + q), v)


def parse_rdfxml(text: str, base: str | None = None, scope: str = "d") -> list[tuple]:
    root = ET.fromstring(text)
    r = XmlReader(base, scope)
    base, lang = root.get(XML + "base", base), root.get(XML + "lang")
    for e in root if root.tag == R + "RDF" else [root]:
        r.node(e, base, lang)
    return r.out


class JsonLdError(ValueError):
    """JSON-LD beyond inline contexts, values, lists and graphs."""


REJECTED = {"@reverse", "@container", "@import", "@included", "@nest"}


class JsonReader:
    def __init__(self, base: str | None, scope: str):
        self.base, self.scope, self.out, self.fresh = base, scope, [], 0

    def blank(self, label=None):
        if label is None:
            self.fresh += 1
            label = f"j{self.fresh}"
        return ("bnode", f"{self.scope}_{label}")

    def context(self, old: dict, new) -> dict:
        if new is None:
            return {"@base": self.base}
        if isinstance(new, list):
            for x in new:
                old = self.context(old, x)
            return old
        if not isinstance(new, dict):
            raise JsonLdError("remote contexts are not read")
        out = dict(old)
        for k, v in new.items():
            if k in REJECTED or isinstance(v, dict) and REJECTED & v.keys():
                raise JsonLdError(f"{k} is not supported")
            out[k] = v
        return out

    def iri(self, x: str, ctx: dict, vocab=True) -> str:
        term = ctx.get(x) if vocab else None
        if isinstance(term, dict):
            return self.iri(term.get("@id", x), {k: v for k, v in ctx.items() if k != x})
        if isinstance(term, str) and term != x:
            return self.iri(term, {k: v for k, v in ctx.items() if k != x})
        prefix, colon, local = x.partition(":")
        if colon and not local.startswith("//") and prefix in ctx:
            own = ctx[prefix]
            return self.iri(own.get("@id") if isinstance(own, dict) else own, {k: v for k, v in ctx.items() if k != prefix}) + local
        if colon:
            return x
        return ctx["@vocab"] + x if vocab and ctx.get("@vocab") else resolve(ctx.get("@base") or self.base, x)

    def ref(self, x: str, ctx, vocab=False):
        return self.blank(x[2:]) if x.startswith("_:") else ("iri", self.iri(x, ctx, vocab))

    def add(self, s, p, o, g):
        self.out.append((key_py(s), key_py(p), key_py(o), None if g is None else key_py(g)))

    def node(self, x: dict, ctx: dict, g):
        if "@context" in x:
            ctx = self.context(ctx, x["@context"])
        alias = {k: v for k, v in ctx.items() if isinstance(v, str) and v.startswith("@")}
        x = {alias.get(k, k): v for k, v in x.items()}
        if REJECTED & x.keys():
            raise JsonLdError("not supported")
        s = self.ref(x["@id"], ctx) if "@id" in x else self.blank()
        for t in x.get("@type", []) if isinstance(x.get("@type", []), list) else [x["@type"]]:
            self.add(s, ("iri", RDF + "type"), self.ref(t, ctx, True), g)
        for k, v in x.items():
            if k == "@graph":
                inner = s if "@id" in x or len(x) > 1 + ("@context" in x) else g
                for y in v if isinstance(v, list) else [v]:
                    self.node(y, ctx, inner)
            elif not k.startswith("@"):
                p = self.iri(k, ctx)
                if ":" not in p:
                    continue
                term = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
                for y in v if isinstance(v, list) else [v]:
                    for o in self.values(y, ctx, term, g):
                        self.add(s, ("iri", p), o, g)
        return s

    def values(self, y, ctx, term, g):
        if y is None:
            return
        if isinstance(y, dict) and "@list" in y:
            items = [o for z in (y["@list"] if isinstance(y["@list"], list) else [y["@list"]]) for o in self.values(z, ctx, term, g)]
            cells = [self.blank() for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items, strict=True)):
                self.add(cell, ("iri", RDF + "first"), item, g)
                self.add(cell, ("iri", RDF + "rest"), cells[i + 1] if i + 1 < len(cells) else ("iri", RDF + "nil"), g)
            yield cells[0] if cells else ("iri", RDF + "nil")
        elif isinstance(y, dict) and "@value" in y:
            v, lang, dt = y["@value"], y.get("@language"), y.get("@type")
            yield ("lit", str(v), RDF + "langString", lang.lower(), None) if lang else self.native(v, self.iri(dt, ctx) if dt else None)
        elif isinstance(y, dict):
            yield self.node(y, ctx, g)
        else:
            kind = term.get("@type")
            if isinstance(y, str) and kind in ("@id", "@vocab"):
                yield self.ref(y, ctx, kind == "@vocab")
            elif isinstance(y, str) and not kind and (lang := term.get("@language", ctx.get("@language"))):
                yield ("lit", y, RDF + "langString", lang.lower(), None)
            else:
                yield self.native(y, self.iri(kind, ctx) if kind else None)

    @staticmethod
    def native(v, dt):
        if isinstance(v, bool):
            return lit("true" if v else "false", dt or XSD + "boolean")
        if isinstance(v, int):
            return lit(str(v), dt or XSD + "integer")
        if isinstance(v, float):
            if v.is_integer() and abs(v) < 1e21 and dt is None:
                return lit(str(int(v)), XSD + "integer")
            m, _, e = f"{v:.15E}".partition("E")
            return lit(f"{re.sub(r'0+$', '', m) if not re.search(r'[.]0+$', m) else m.split('.')[0] + '.0'}E{int(e)}", dt or XSD + "double")
        return lit(v, dt or STRING)


def parse_jsonld(text: str, base: str | None = None, scope: str = "d") -> list[tuple]:
    r = JsonReader(base, scope)
    data = json.loads(text)
    for x in data if isinstance(data, list) else [data]:
        r.node(x, {"@base": base}, None)
    return r.out


# -- writers: quads of a partition, in the order in which they come, as one document ------------------------------------


def _term(text: str) -> tuple:
    if text.startswith("<") and not text.startswith("<<"):
        return ("iri", text[1:-1])
    if text.startswith("_:"):
        return ("bnode", text[2:])
    return Parser(text).term(None)


def _runs(batches):
    """(graph, subject, [(predicate, object)]) of each run of quads that share graph and subject."""
    last, own = None, []
    for batch in batches:
        for s, p, o, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (g, s) != last:
                if own:
                    yield (*last, own)
                last, own = (g, s), []
            own.append((_term(p)[1], _term(o)))
    if own:
        yield (*last, own)


def _documents(head: str, rows, tail: str, between: str = ""):
    """Batches of lines; none without rows."""
    lines, some = [], False
    for row in rows:
        lines.append(between + row if some else head + "\n" + row)
        some = True
        if len(lines) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
            lines = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([*lines, tail])], ["value"])


def _json_object(o: tuple) -> dict:
    if o[0] in ("iri", "bnode"):
        return {"@id": ("_:" if o[0] == "bnode" else "") + o[1]}
    if o[0] == "triple" or o[4]:
        raise ValueError("JSON-LD has no triple terms, and its directions are no part of RDF by default")
    _, lex, dt, lang, _ = o
    return {"@value": lex} | ({"@language": lang} if lang else {"@type": dt} if dt != STRING else {})


def write_jsonld(batches):
    """An array of expanded nodes, those of named graphs inside them."""

    def rows():
        for g, s, own in _runs(batches):
            node: dict = {"@id": _json_object(_term(s))["@id"]}
            for p, o in own:
                if p == RDF + "type" and o[0] != "lit":
                    node.setdefault("@type", []).append(_json_object(o)["@id"])
                else:
                    node.setdefault(p, []).append(_json_object(o))
            yield json.dumps(node if g is None else {"@id": _json_object(_term(g))["@id"], "@graph": [node]}, ensure_ascii=False)

    return _documents("[", rows(), "]", ", ")


def write_rdfxml(batches):
    """rdf:Description elements; ValueError for named graphs, triple terms, directions and predicates that XML cannot name."""

    def rows():
        for g, s, own in _runs(batches):
            if g is not None:
                raise ValueError("a named graph in RDF/XML")
            t = _term(s)
            out = [f"<rdf:Description {'rdf:nodeID' if t[0] == 'bnode' else 'rdf:about'}={quoteattr(t[1])}>"]
            for p, o in own:
                m = re.search(r"[A-Za-z_][A-Za-z0-9_.-]*$", p)
                if not m or m.start() == 0 or o[0] == "triple" or o[0] == "lit" and o[4]:
                    raise ValueError(f"RDF/XML cannot hold <{p}> of {s}")
                tag = f"<n:{m[0]} xmlns:n={quoteattr(p[: m.start()])}"
                if o[0] != "lit":
                    out.append(f"{tag} {'rdf:nodeID' if o[0] == 'bnode' else 'rdf:resource'}={quoteattr(o[1])}/>")
                else:
                    kind = f" xml:lang={quoteattr(o[3])}" if o[3] else f" rdf:datatype={quoteattr(o[2])}" if o[2] != STRING else ""
                    out.append(f"{tag}{kind}>{escape(o[1], {chr(13): '&#13;'})}</n:{m[0]}>")
            yield "".join([*out, "</rdf:Description>"])

    return _documents(f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">', rows(), "</rdf:RDF>")

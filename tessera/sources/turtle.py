"""Turtle and TriG documents as quads of keys; the parser takes one document at a time."""

from __future__ import annotations

from tessera.functions.values import key_py
from tessera.plans.parser import RDF, Parser, SparqlError, resolve


class TurtleParser(Parser):
    """The grammar shares its tokens and terms with SPARQL's; blank node labels get the document's prefix."""

    def __init__(self, text: str, base: str | None = None, scope: str = "d"):
        super().__init__(text, base)
        self.scope, self.quads, self.graph = scope, [], None

    def document(self, graphs: bool) -> list[tuple]:
        """[(s, p, o, g)] of keys, in document order; graphs: whether TriG's graph blocks are allowed."""
        while self.kind != "end":
            if self.kind == "lang" or self.word("PREFIX", "BASE", "VERSION"):
                self.directive()
            elif graphs and (self.word("GRAPH") or self.text == "{"):
                named = self.take("GRAPH")
                self.block(self.graph_name() if named else None)
            elif graphs and self.kind in ("iri", "pname", "bnode") and self.peek() == "{":
                self.block(self.graph_name())
            elif graphs and self.text == "[" and self.peek() == "]" and self.peek(2) == "{":
                self.at += 2
                self.block(self.new())
            else:
                self.statement(None)
                self.need(".")
        return self.quads

    def directive(self):
        w = self.text.upper()
        if w not in ("@PREFIX", "@BASE", "@VERSION", "PREFIX", "BASE", "VERSION"):
            self.fail("expected a directive")
        self.at += 1
        if w.endswith("VERSION"):
            self.at += 1
        elif w.endswith("BASE"):
            self.base = self.iri_ref()
        else:
            if self.kind != "pname" or not self.text.endswith(":"):
                self.fail("expected a prefix")
            name = self.text[:-1]
            self.at += 1
            self.prefixes[name] = self.iri_ref()
        if w.startswith("@"):
            self.need(".")

    def graph_name(self):
        return self.iri() if self.kind != "bnode" else self.term(None)

    def block(self, g):
        self.need("{")
        while not self.take("}"):
            self.statement(g)
            if not self.take(".") and self.text != "}":
                self.fail()

    def statement(self, g):
        if self.kind == "var":
            self.fail("variables are SPARQL's")
        triples: list = []
        self.triples_same_subject(triples)
        for s, p, o in triples:
            if p[0] != "link":
                raise SparqlError("a path in a document")
            if s[0] == "lit" or p[1][0] != "iri":
                raise SparqlError("an illegal subject or predicate")
            self.quads.append(tuple(None if t is None else key_py(self.named(t)) for t in (s, p[1], o, g)))

    def named(self, t):
        if t[0] == "bnode":
            return ("bnode", f"{self.scope}_{t[1]}")
        if t[0] == "var":
            if not t[1].startswith("."):
                raise SparqlError("variables are SPARQL's")
            return ("bnode", f"{self.scope}{t[1].replace('.', '_')}")
        if t[0] == "triple":
            return ("triple", *map(self.named, t[1:]))
        return t


def parse_turtle(text: str, base: str | None = None, scope: str = "d") -> list[tuple]:
    return TurtleParser(text, base, scope).document(False)


def parse_trig(text: str, base: str | None = None, scope: str = "d") -> list[tuple]:
    return TurtleParser(text, base, scope).document(True)


__all__ = ["RDF", "parse_trig", "parse_turtle", "resolve"]

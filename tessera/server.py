"""SPARQL 1.1 protocol and graph store protocol over HTTP, for one store: /sparql, /graphs and /health.

Solutions are streamed row by row from Spark's local iterator, so that a large result never lies in the driver whole. Every
request runs in a job group of its own, which its deadline cancels.
"""

from __future__ import annotations

import tempfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.engine import DeadlineExceeded, deadline, evaluate
from tessera.operators.update import UpdateError, update
from tessera.plans.parser import SparqlError, parse_query
from tessera.sources import rdf, results
from tessera.store import Store

#: The media types that are offered, by kind of result, the first by default.
SOLUTIONS = ["application/sparql-results+json", "application/sparql-results+xml", "text/csv", "text/tab-separated-values"]
GRAPHS = ["application/n-triples", "text/turtle"]


class HttpError(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def handler(store: Store, read_only: bool = False, seconds: float = 60.0, most_seconds: float = 600.0):
    """The request handler class of a store; seconds: a request's time by default, most_seconds: what it may ask for."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def answer(self, status: int, kind: str, parts) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind + ("; charset=utf-8" if kind.startswith("text/") else ""))
            self.send_header("Connection", "close")
            self.end_headers()
            for part in parts:
                self.wfile.write(part.encode("utf-8"))

        def handled(self, f) -> None:
            try:
                parts = urlsplit(self.path)
                self.params = parse_qs(parts.query, keep_blank_values=True)
                f(parts.path)
            except HttpError as e:
                self.answer(e.status, "text/plain", [f"{e}\n"])
            except (SparqlError, UpdateError, ValueError) as e:
                self.answer(400, "text/plain", [f"{e}\n"])
            except DeadlineExceeded as e:
                self.answer(408, "text/plain", [f"{e}\n"])
            except BrokenPipeError:
                pass
            except Exception as e:
                self.answer(500, "text/plain", [f"{e}\n"])

        def one(self, name: str) -> str | None:
            found = self.params.get(name, [])
            if len(found) > 1:
                raise HttpError(400, f"more than one {name}")
            return found[0] if found else None

        def body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def accepted(self, offered: list[str]) -> str:
            kind = results.negotiated(self.headers.get("Accept") or "*/*", offered)
            if kind is None:
                raise HttpError(406, "no such media type; offered: " + ", ".join(offered))
            return kind

        # -- queries and updates --

        def query(self, text: str) -> None:
            q = parse_query(text)
            own = [(False, g) for g in self.params.get("default-graph-uri", [])] + [(True, g) for g in self.params.get("named-graph-uri", [])]
            if own:
                q["dataset"] = own
            kind = self.accepted(SOLUTIONS if q["form"] in ("select", "ask") else GRAPHS)
            time = min(float(self.one("timeout") or seconds), most_seconds)
            with deadline(store.spark, time):
                out = evaluate(store.snapshot(), q)
                if out.form in ("construct", "describe"):
                    rows = rdf.lines(out.df.withColumn("g", F.lit(None).cast("string")), False) if kind == GRAPHS[0] else rdf.grouped(out.df.withColumn("g", F.lit(None).cast("string")), False)
                    self.stream(kind, "", rows, "", "\n")
                else:
                    syntax = results.MEDIA[kind]
                    head, rows, foot = results.lines(out, syntax)
                    end = {"csv": "\r\n", "tsv": "\n"}.get(syntax, "")
                    self.stream(kind, head + end, rows, foot, end, "," if syntax == "json" else "")

        def stream(self, kind: str, head: str, rows: DataFrame, foot: str, end: str, between: str = "") -> None:
            found = rows.toLocalIterator()
            first = next(found, None)  # errors of the job come before the status

            def parts():
                yield head
                if first is not None:
                    yield first["value"] + end
                for row in found:
                    yield between + row["value"] + end
                yield foot

            self.answer(200, kind, parts())

        def update(self, text: str) -> None:
            if read_only:
                raise HttpError(403, "the store is read-only")
            with deadline(store.spark, min(float(self.one("timeout") or seconds), most_seconds)):
                update(store, text)
            self.answer(204, "text/plain", [])

        def sparql(self) -> None:
            kind = (self.headers.get("Content-Type") or "").split(";")[0].strip()
            body = self.body()
            if kind == "application/x-www-form-urlencoded":
                for name, values in parse_qs(body.decode(), keep_blank_values=True).items():
                    self.params.setdefault(name, []).extend(values)
            elif kind == "application/sparql-query":
                return self.query(body.decode())
            elif kind == "application/sparql-update":
                return self.update(body.decode())
            else:
                raise HttpError(415, f"unsupported media type {kind}")
            text, change = self.one("query"), self.one("update")
            if (text is None) == (change is None):
                raise HttpError(400, "one query or one update")
            return self.query(text) if text is not None else self.update(change)

        # -- graphs --

        def graph(self) -> str | None:
            """The graph's key; None is the default graph."""
            if ("default" in self.params) == ("graph" in self.params):
                raise HttpError(400, "either ?default or ?graph=IRI")
            return None if "default" in self.params else f"<{self.one('graph')}>"

        def own(self, g: str | None) -> DataFrame:
            return store.quads().where(F.col("g").eqNullSafe(F.lit(g)))

        def put(self, replace: bool) -> None:
            if read_only:
                raise HttpError(403, "the store is read-only")
            g, kind = self.graph(), (self.headers.get("Content-Type") or "").split(";")[0].strip()
            if kind not in rdf.FORMATS:
                raise HttpError(415, f"unsupported media type {kind}")
            with tempfile.TemporaryDirectory() as folder:  # the driver's own; parsed here, not by the executors
                file = Path(folder) / "body"
                file.write_bytes(self.body())
                found = store.spark.createDataFrame(rdf.parsed(file.read_text("utf-8"), rdf.FORMATS[kind], "http://localhost/graphs"), rdf.QUAD)
            new = found.where("g is null").withColumn("g", F.lit(g).cast("string"))
            store.apply(self.own(g) if replace else None, new)
            self.answer(204, "text/plain", [])

        def do_GET(self):
            def run(path):
                if path == "/health":
                    self.answer(200, "text/plain", ["ok\n"])
                elif path == "/sparql":
                    if (text := self.one("query")) is None:
                        raise HttpError(400, "no query")
                    self.query(text)
                elif path == "/graphs":
                    own = self.own(self.graph()).withColumn("g", F.lit(None).cast("string"))
                    kind = self.accepted(GRAPHS)
                    if self.graph() is not None and own.isEmpty():
                        raise HttpError(404, "no such graph")
                    self.stream(kind, "", rdf.lines(own, False) if kind == GRAPHS[0] else rdf.grouped(own, False), "", "\n")
                else:
                    raise HttpError(404, "not found")

            self.handled(run)

        def do_POST(self):
            self.handled(lambda path: self.sparql() if path == "/sparql" else self.put(False) if path == "/graphs" else self.missing())

        def do_PUT(self):
            self.handled(lambda path: self.put(True) if path == "/graphs" else self.missing())

        def do_DELETE(self):
            def run(path):
                if path != "/graphs":
                    self.missing()
                if read_only:
                    raise HttpError(403, "the store is read-only")
                own = self.own(self.graph())
                if self.graph() is not None and own.isEmpty():
                    raise HttpError(404, "no such graph")
                store.apply(delete=own)
                self.answer(204, "text/plain", [])

            self.handled(run)

        def missing(self):
            raise HttpError(404, "not found")

    return Handler


def serve(store: Store, host: str = "127.0.0.1", port: int = 8080, **options) -> ThreadingHTTPServer:
    """A server that is bound and waits for serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(store, **options))

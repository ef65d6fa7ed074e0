"""SPARQL Update over a store: a commit an operation, deletes before inserts, later operations see earlier ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import key_py
from tessera.plans.parser import parse_update
from tessera.plans.session import written
from tessera.sources import rdf
from tessera.sources.dataset import Dataset, Quads
from tessera.store import QUAD, Store

from .compile import Env, compile_group
from .forms import instantiated


class UpdateError(ValueError):
    """An operation that isn't SILENT failed."""


class _Scoped(Quads):
    """The default graph is one named graph: what WITH makes of a WHERE."""

    def __init__(self, data: Dataset, graph: str):
        super().__init__(data.spark, data.quads())
        self.own = graph

    def scope(self, graph) -> DataFrame:
        return super().scope(self.own if graph is None else graph)


def graph_is(target: str | None):
    """The condition of a target: an IRI, None or DEFAULT, NAMED, ALL."""
    if target in (None, "DEFAULT"):
        return F.col("g").isNull()
    if target == "NAMED":
        return F.col("g").isNotNull()
    return F.lit(True) if target == "ALL" else F.col("g").eqNullSafe(f"<{target}>")


def update(store: Store, text: str, base: str | None = None, loader: Callable[[str], DataFrame] | None = None) -> int:
    """Applies an update request; gives the number of its operations. loader reads a LOAD's source; without it none is read."""
    ops = parse_update(text, base)
    env = Env.new(store.snapshot(), base)
    for n, op in enumerate(ops):
        _apply(store, op, replace(env, data=store.snapshot(), nonce=f"{env.nonce}{n}" if op["op"] != "insert_data" else env.nonce), loader)
    return len(ops)


def _data(store: Store, quads, nonce: str) -> DataFrame:
    def named(t):
        if t is None:
            return None
        if t[0] == "blank":
            return ("bnode", f"u{nonce[:12]}_{t[1].replace('.', '_').replace(':', '_')}")
        return ("triple", *map(named, t[1:])) if t[0] == "triple" else t

    rows = [tuple(None if t is None else key_py(named(t)) for t in q) for q in quads]
    return store.spark.createDataFrame(rows, QUAD)


def _apply(store: Store, op: dict, env: Env, loader) -> None:
    kind, quads = op["op"], store.quads()
    if kind == "insert_data":
        store.apply(insert=_data(store, op["quads"], env.nonce))
    elif kind == "delete_data":
        store.apply(delete=_data(store, op["quads"], env.nonce))
    elif kind == "modify":
        data = store.snapshot()
        if op["using"]:
            data = data.view(op["using"])
        elif op["with"]:
            data = _Scoped(data, op["with"])
        rel = compile_group(op["where"], replace(env, data=data))
        rel.df = written(rel.df.withColumn("__keep", F.lit(1))).drop("__keep")  # evaluated once, for both templates
        gone = written(instantiated(rel, op["delete"], env.nonce, op["with"])) if op["delete"] else None
        new = written(instantiated(rel, op["insert"], env.nonce, op["with"])) if op["insert"] else None
        store.apply(gone, new)
    elif kind == "load":
        try:
            if loader is None:
                raise UpdateError("no loader: sources are not read")
            found = loader(op["source"]).select("s", "p", "o", "g")
            into = F.lit(f"<{op['into']}>") if op["into"] else F.col("g")
            store.apply(insert=written(found.withColumn("g", into)))
        except Exception as e:
            if not op["silent"]:
                raise UpdateError(f"LOAD <{op['source']}>: {e}") from e
    elif kind == "clear":
        own = written(quads.where(graph_is(op["target"])))
        named = op["target"] not in ("DEFAULT", "NAMED", "ALL")
        if own.isEmpty():
            if named and not op["silent"]:
                raise UpdateError(f"no graph <{op['target']}>")
            return
        store.apply(delete=own)
    elif kind in ("add", "move", "copy"):
        if op["source"] == op["to"]:
            return
        own = written(quads.where(graph_is(op["source"])))
        if op["source"] is not None and own.isEmpty():
            if not op["silent"]:
                raise UpdateError(f"no graph <{op['source']}>")
            return
        moved = own.withColumn("g", F.lit(f"<{op['to']}>" if op["to"] else None).cast("string"))
        gone = written(quads.where(graph_is(op["to"]))) if kind != "add" else None
        if kind == "move":
            gone = gone.union(own)
        store.apply(gone, moved)

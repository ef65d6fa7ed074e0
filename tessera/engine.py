"""The engine's entry points: queries over a dataset."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import forms
from tessera.operators.compile import Env, compile_select, output
from tessera.operators.relation import Rel
from tessera.plans.parser import parse_query
from tessera.plans.session import prepared
from tessera.sources.dataset import Dataset, Quads


@dataclass
class Result:
    """form: select, ask, construct or describe; df: solutions, one boolean, or triples (s, p, o) of keys."""

    form: str
    df: DataFrame
    rel: Rel | None = None  # of a select: the solutions with their representations

    @property
    def answer(self) -> bool:
        return bool(self.df.first()[0])


def evaluate(data: Dataset, q: dict) -> Result:
    prepared(data.spark)
    env = Env.new(data.view(q.get("dataset") or []), q.get("base"))
    if q["form"] == "select":
        rel = compile_select(q, env).rel
        return Result("select", output(rel), rel)
    return Result(q["form"], getattr(forms, q["form"])(q, env))


def query(data: Dataset, text: str, base: str | None = None) -> Result:
    """Runs a SPARQL query over a dataset; the result is lazy."""
    return evaluate(data, parse_query(text, base))


class DeadlineExceeded(RuntimeError):
    """A request took longer than it may."""


@contextmanager
def deadline(spark: SparkSession, seconds: float, group: str | None = None) -> Iterator[str]:
    """Runs a block's Spark jobs in a job group that is cancelled after so many seconds; cancel() ends it from another thread."""
    sc, group, late = spark.sparkContext, group or f"tessera-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "tessera request", interruptOnCancel=True)
    timer.start()
    try:
        yield group
    except Exception as e:
        if late.is_set():
            raise DeadlineExceeded(f"more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise DeadlineExceeded(f"more than {seconds} seconds")


def cancel(spark: SparkSession, group: str) -> None:
    """Cancels the jobs of a group that deadline() named."""
    spark.sparkContext.cancelJobGroup(group)


def explain(data: Dataset, text: str) -> str:
    """The formatted physical plan of a query."""
    df = query(data, text).df
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def from_quads(spark: SparkSession, rows: list[tuple]) -> Quads:
    """A dataset of (s, p, o, g) keys in N-Triples form; g is None for the default graph."""
    return Quads(prepared(spark), spark.createDataFrame(rows, "s string, p string, o string, g string"))

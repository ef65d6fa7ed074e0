"""Pipelines of quads: ordered streams with skip, head, tail, tree, concat, merge and the sinks count, distinct and write.

A stream's order is a column `ord`: the file, then the line or statement in it. Ordinals come from counts by partition, so no
stream is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.session import written
from tessera.sources import rdf

NAMES = ["s", "p", "o", "g"]
#: Verbs of the command line that are known but not part of the engine.
FUTURE = {"filter", "transform", "union", "intersect", "diff", "equals", "disjoint", "contains", "canonical"}


def numbered(df: DataFrame) -> DataFrame:
    """df with `ord` from 0 in the order of its partitions and rows."""
    at = written(df.select(*NAMES, F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    low = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.withColumn("part", part).join(F.broadcast(before), "part").select(*NAMES, (F.col("before") + low).alias("ord"))


class Stream:
    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def read(spark: SparkSession, path: str, syntax: str | None = None) -> Stream:
        return Stream(numbered(rdf.read(spark, path, syntax or None)))

    @staticmethod
    def scan(spark: SparkSession, path: str) -> Stream:
        """Line-based files only, in no particular order."""
        if rdf.format_of(path) not in ("nt", "nq"):
            raise ValueError("scan reads N-Triples and N-Quads")
        return Stream(numbered(rdf.read(spark, path)))

    @staticmethod
    def of(df: DataFrame) -> Stream:
        return Stream(numbered(df))

    def groups(self) -> DataFrame:
        """With `grp`: which run of one subject a quad is in, from 1. Runs are counted by blocks of ordinals, then added up."""
        block = F.floor(F.col("ord") / 65_536).alias("block")
        edge = self.df.select((F.col("ord") + 1).alias("ord"), F.col("s").alias("last"))
        df = self.df.join(edge, "ord", "left").withColumn("new", (~F.col("s").eqNullSafe(F.col("last"))).cast("long")).withColumn("block", block)
        df = written(df)
        sums = df.groupBy("block").agg(F.sum("new").alias("n"))
        before = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row a block
        inside = F.sum("new").over(Window.partitionBy("block").orderBy("ord"))
        return df.join(before, "block").select(*NAMES, "ord", (F.col("before") + inside).alias("grp"))

    def _cut(self, n: int, unit: str, first: bool, tail: bool = False) -> Stream:
        df, at = (self.groups(), F.col("grp") - 1) if unit == "subjects" else (self.df, F.col("ord"))
        if tail:
            last = df.agg(F.max(at)).first()[0]
            keep = at > (last if last is not None else 0) - n
        else:
            keep = at < n if first else at >= n
        df = df.where(keep).select(*NAMES, "ord")
        start = 0 if first and not tail else df.agg(F.min("ord")).first()[0] or 0
        return Stream(df.withColumn("ord", F.col("ord") - start))

    def skip(self, n: int, unit: str = "quads") -> Stream:
        return self._cut(n, unit, False)

    def head(self, n: int, unit: str = "quads") -> Stream:
        return self._cut(n, unit, True)

    def tail(self, n: int, unit: str = "quads") -> Stream:
        return self._cut(n, unit, False, tail=True)

    def tree(self) -> Stream:
        """Each quad once, grouped by graph, subject and predicate in the order in which they are first seen."""
        df = self.df.groupBy(*NAMES).agg(F.min("ord").alias("ord"))
        for level, by in (("__g", ["g"]), ("__s", ["g", "s"]), ("__p", ["g", "s", "p"])):
            first = written(df.groupBy(*by).agg(F.min("ord").alias(level)))
            on = [df[c].eqNullSafe(first[c]) for c in by]
            df = df.join(first, on).select(*[df[c] for c in df.columns], first[level])
        return Stream(numbered(df.orderBy("__g", "__s", "__p", "ord")))

    @staticmethod
    def concat(*legs: Stream) -> Stream:
        out, start = None, 0
        for leg in legs:
            df = leg.df.withColumn("ord", F.col("ord") + start)
            start += leg.count()
            out = df if out is None else out.union(df)
        return Stream(out)

    @staticmethod
    def merge(*legs: Stream) -> Stream:
        """All the legs in no particular order."""
        out = legs[0].df
        for leg in legs[1:]:
            out = out.union(leg.df)
        return Stream(numbered(out))

    def ordered(self) -> DataFrame:
        return self.df.orderBy("ord").select(*NAMES)

    def count(self) -> int:
        return self.df.count()

    def distinct(self, what: str = "quads") -> int:
        """How many distinct quads, triples, subjects, predicates, objects or graphs; the default graph is one of these."""
        cols = {"quads": NAMES, "triples": NAMES[:3], "subjects": ["s"], "predicates": ["p"], "objects": ["o"], "graphs": ["g"]}[what]
        return self.df.select(*cols).distinct().count()

    def write(self, path: str, syntax: str | None = None) -> None:
        rdf.write(self.ordered(), path, syntax)


def run(spark: SparkSession, args: list[str]):
    """A pipeline of the command line: verbs with arguments, parted by `/`. Gives a Stream or a number."""
    steps, step = [], []
    for a in [*args, "/"]:
        if a == "/":
            steps.append(step)
            step = []
        else:
            step.append(a)
    out = None
    for verb, *rest in steps:
        if verb in FUTURE:
            raise ValueError(f"{verb} is not supported")
        if verb in ("read", "scan"):
            out = getattr(Stream, verb)(spark, *rest)
        elif verb in ("concat", "merge"):
            legs = [Stream.read(spark, p) for p in rest]
            out = getattr(Stream, verb)(*([out] if out else []), *legs)
        elif verb in ("skip", "head", "tail"):
            out = getattr(out, verb)(int(rest[0]), *rest[1:])
        elif verb in ("tree", "count"):
            out = getattr(out, verb)()
        elif verb == "distinct":
            out = out.distinct(*rest)
        elif verb in ("write", "scribe"):
            out.write(*rest)
        else:
            raise ValueError(f"no verb {verb}")
    return out

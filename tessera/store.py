"""A quad store on Parquet: a base generation, a log of epochs, and snapshots of both.

`CURRENT` names the generation and the last epoch and is replaced by a rename, so a commit is seen whole or not at all. A
snapshot is the base with the log's last event for each quad; compaction writes a new generation. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import prepared
from tessera.sources.dataset import Quads

QUAD = "s string, p string, o string, g string"
NAMES = ["s", "p", "o", "g"]
ADDED = "-add"  # how the names of epochs without deletes end


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepared(spark), path.rstrip("/")
        jvm = spark._jvm
        self._fs_path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self.fs.exists(self._fs_path(f"{self.path}/CURRENT")):
            self.spark.createDataFrame([], QUAD).write.parquet(f"{self.path}/gen=0")
            self._point(0, 0, [])

    # -- what is current --

    def _state(self) -> dict:
        stream = self.fs.open(self._fs_path(f"{self.path}/CURRENT"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, gen: int, epoch: int, log: list[str]) -> None:
        new = self._fs_path(f"{self.path}/CURRENT.{uuid.uuid4().hex}")
        out = self.fs.create(new)
        out.write(bytearray(json.dumps({"gen": gen, "epoch": epoch, "log": log}).encode()))
        out.close()
        jvm = self.spark._jvm
        overwrite = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = overwrite
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(new, self._fs_path(f"{self.path}/CURRENT"), options)

    @property
    def epoch(self) -> int:
        return self._state()["epoch"]

    def quads(self, epoch: int | None = None) -> DataFrame:
        """The quads as of an epoch of this generation; the latest by default. Later commits don't change it."""
        state = self._state()
        base = self.spark.read.schema(QUAD).parquet(f"{self.path}/gen={state['gen']}")
        names = [x for x in state["log"] if epoch is None or int(x.split("-")[0]) <= epoch]
        if not names:
            return base
        log = self.spark.read.schema(QUAD + ", op string, epoch long, seq int").parquet(*(f"{self.path}/log/{x}" for x in names))
        if state["gen"] == 0 and len(names) == 1 and names[0].endswith(ADDED):  # the first load is distinct as it is
            return log.select(*NAMES)
        # what the log says last of each of its quads stands; the base's other quads are only probed, not grouped
        last = log.groupBy(*NAMES).agg(F.max_by("op", F.struct("epoch", "seq")).alias("op"))
        added = last.where("op = 'add'").select(*NAMES)
        if state["gen"] == 0:
            return added
        same = [F.col(f"base.{c}").eqNullSafe(F.col(f"log.{c}")) for c in NAMES]  # the default graph is null
        return base.alias("base").join(last.alias("log"), same, "left_anti").unionByName(added)

    def snapshot(self, epoch: int | None = None) -> Quads:
        return Quads(self.spark, self.quads(epoch))

    # -- changes --

    def apply(self, delete: DataFrame | None = None, insert: DataFrame | None = None) -> int:
        """One commit: deletes, then inserts. Adding what is there and deleting what isn't change nothing. Gives the epoch."""
        state = self._state()
        epoch, events = state["epoch"] + 1, None
        for df, op, seq in ((delete, "delete", 0), (insert, "add", 1)):
            if df is not None:
                own = df.select(*NAMES).distinct().select("*", F.lit(op).alias("op"), F.lit(epoch).cast("long").alias("epoch"), F.lit(seq).alias("seq"))
                events = own if events is None else events.unionByName(own)
        if events is None:
            return state["epoch"]
        name = f"{epoch:012d}-{uuid.uuid4().hex}{ADDED if delete is None else ''}"
        events.write.parquet(f"{self.path}/log/{name}")
        self._point(state["gen"], epoch, [*state["log"], name])
        return epoch

    def load(self, quads: DataFrame) -> int:
        return self.apply(insert=quads)

    def compact(self) -> int:
        """Writes the snapshot as a new generation, ordered by predicate and subject so that scans prune."""
        state = self._state()
        gen = state["gen"] + 1
        self.quads().repartitionByRange("p", "s").sortWithinPartitions("p", "s", "o").write.parquet(f"{self.path}/gen={gen}")
        self._point(gen, state["epoch"], [])
        return gen

    def should_compact(self, log_limit: int = 64, tombstones: float = 0.10) -> bool:
        """Whether the log has many epochs, or the share of deletes in it to the base is high."""
        state = self._state()
        if len(state["log"]) >= log_limit:
            return True
        if not state["log"]:
            return False
        log = self.spark.read.parquet(*(f"{self.path}/log/{x}" for x in state["log"]))
        base = self.spark.read.parquet(f"{self.path}/gen={state['gen']}").count()
        return log.where("op = 'delete'").count() > tombstones * max(1, base)

    def collect_garbage(self) -> list[str]:
        """Deletes generations and epochs that CURRENT doesn't name; snapshots of them end."""
        state, gone = self._state(), []
        for folder, keep in ((self.path, {f"gen={state['gen']}", "log", "CURRENT"}), (f"{self.path}/log", set(state["log"]))):
            if self.fs.exists(self._fs_path(folder)):
                for x in self.fs.listStatus(self._fs_path(folder)):
                    if x.getPath().getName() not in keep and not x.getPath().getName().startswith("."):
                        self.fs.delete(x.getPath(), True)
                        gone.append(x.getPath().getName())
        return gone

    def verify(self) -> bool:
        """Whether every quad is legal and the base has no quad twice."""
        from tessera.operators.forms import legal

        base = self.spark.read.schema(QUAD).parquet(f"{self.path}/gen={self._state()['gen']}")
        bad = self.quads().where(~legal(F.col("s"), F.col("p"), F.col("o"), F.col("g"))).limit(1).count()
        twice = base.groupBy(*NAMES).count().where("count > 1").limit(1).count()
        return not bad and not twice


__all__ = ["QUAD", "Store"]

"""The test tables as a graph: subjects, references and named graphs of each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import prepared

from .dataset import Table, Tables

#: Each table's key column, and the columns that refer to other tables.
KEYS = {
    "region": ("r_regionkey", {}), "nation": ("n_nationkey", {"n_regionkey": "region"}), "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}), "part": ("p_partkey", {}), "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "events": ("event_id", {}), "documents": ("doc_id", {}), "labels": ("doc_id", {"doc_id": "documents"}), "pages": ("page_id", {}), "benchmark": ("item_id", {}),
}


def graph_of(spark: SparkSession, folder: str, only: tuple[str, ...] | None = None) -> Tables:
    """The dataset of a folder of the test tables. lineitem has no key, so its rows' numbers in the file are its subjects;
    a conversation's turn has the turn after it as #next. only: the tables to take, all by default."""
    prepared(spark)

    def read(name: str) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        if name == "lineitem":
            return df.withColumn("__row", F.concat(F.hash(F.col("_metadata.file_name")).cast("string"), F.lit("-"), F.col("_metadata.row_index").cast("string")))
        if name == "conversations":
            after = df.select(F.col("conv_id").alias("__c"), (F.col("turn") - 1).alias("__t"), F.concat_ws("-", "conv_id", "turn").alias("next"))
            return df.join(after, (df["conv_id"] == after["__c"]) & (df["turn"] == after["__t"]), "left").drop("__c", "__t").withColumn("__turn", F.concat_ws("-", "conv_id", "turn"))
        return df

    tables = [Table(t, F.col(k), f"urn:t:{t}/", refs) for t, (k, refs) in KEYS.items() if t != "events"]
    tables.append(Table("events", F.col("event_id"), "urn:t:events/", {}, graph=F.col("event_type")))
    tables.append(Table("lineitem", F.col("__row"), "urn:t:lineitem/r", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, skip=("__row",)))
    tables.append(Table("conversations", F.col("__turn"), "urn:t:conversations/", {"next": "conversations"}, skip=("__turn",)))
    return Tables(spark, read, [t for t in tables if only is None or t.name in only])

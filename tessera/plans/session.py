"""The session's settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """Settings that the value semantics rely on."""
    spark.conf.set("spark.sql.decimalOperations.allowPrecisionLoss", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where unset, a temporary folder on local masters only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df written as Parquet to the shared folder and read back with the same schema. The folder is the
    job's to delete: what is read back is read lazily."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() gave and that nothing reads any more, and those of finished shuffles."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    for df in tables[:1]:
        df.sparkSession._jvm.System.gc()  # Spark drops a shuffle's files when its plan is collected

"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "stripline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew handling on; the cluster's own settings win where given in ``conf``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the cluster's checkpoint folder, or a fresh local one where none is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stripline-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_written: list[str] = []


def clear_cuts(spark: SparkSession) -> None:
    """Delete the tables that :func:`cut` wrote in this process, once no result that reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder.

    A written table survives the loss of executors, keeps column pruning and gives the optimizer real sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/stripline-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

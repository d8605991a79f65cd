"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on; nothing here needs a restart."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # (shipment, slice) is already even, so a join on more keys need not shuffle again
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # a recursion ends with the data: no body is too deep, no level too long
        "spark.sql.cteRecursionLevelLimit": "-1",
        "spark.sql.cteRecursionRowLimit": "-1",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: spark.checkpoint.dir.

    Where none is configured, a run inside this one process makes a temporary one; on a cluster
    executors would write to their own disks, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="haulscope-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/haulscope-{context.applicationId}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where several branches of one result need the same expensive input. Unlike a cache the
    table survives lost executors, cuts the lineage, and each branch reads only its own columns, and with ``by`` (a
    column of few values) only its own folders.
    """
    path = new_table(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_table(spark: SparkSession, name: str) -> str:
    """Unused path for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

"""Cutting lineage without tying results to one executor.

Iterative operators write their intermediate tables as Parquet below the folder named by
``spark.checkpoint.dir``, which every executor can reach, so the loss of an executor never
loses a round. Only where everything runs in one process (a local master, as in unit tests) and the
setting is absent a temporary folder is used; on a cluster its absence is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; on a local master set once per session when unset."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders by the columns ``by``, and read it back as a
    table without history."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut` (or plain columns of it) once nothing reads
    it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        root = re.match(r".*?/[^/]+-[0-9a-f]{32}(?=/)", name)
        if root:
            path = jvm.org.apache.hadoop.fs.Path(root[0])
            path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For scans that are followed by long work on each row: few input splits would leave cores idle.
    With more splits than cores, as on any large table, the frame comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

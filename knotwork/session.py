"""Session helpers shared by all operators: table loading, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a single machine) is a temporary folder chosen.
    """
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(there)
        return there
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="knotwork-"))
    return sc.getCheckpointDir()


def stage_table(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (columnar, prunable).

    ``instead_of`` is an earlier staged table that nobody reads any more once this one is written; its files are removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out._staged_at = path
    if instead_of is not None and hasattr(instead_of, "_staged_at"):
        there = spark._jvm.org.apache.hadoop.fs.Path(instead_of._staged_at)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    return out

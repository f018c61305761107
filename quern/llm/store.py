"""Spark-side helpers: shared scratch tables, sizes, packets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; where none is set, one in the warehouse, and a local one only if all runs in one process.

    A cluster whose warehouse lies on a local file system has no folder that
    all machines see: that is an error, not a folder of the driver's own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="quern-")
        else:
            root = f"{spark.conf.get('spark.sql.warehouse.dir')}/quern-scratch"
            if _path(spark, root).getFileSystem(sc._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = _path(spark, path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the table that ``materialize`` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/quern-{df.sparkSession.sparkContext.applicationId}/" in folder:
            _delete(df.sparkSession, folder)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application materialized; call it once results are written, since they read from these."""
    _delete(spark, f"{scratch_dir(spark)}/quern-{spark.sparkContext.applicationId}")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of UTF-8 text in all rows; only decides how finely work is dealt out."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def doc_hash(mod: int):
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod

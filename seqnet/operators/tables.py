"""Intermediate tables in the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where that is unset, a local master takes a temporary folder; a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        base = _own_dirs[app]
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqnet-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Helpers the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in the sense of the quality, join and line operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands in for a null doc_id where rows need an order or a join key.
NO_ID = -(1 << 63)

_own_dirs: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local master takes a temporary one; on a cluster that would scatter parts over machines, so it fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        base = _own_dirs[app]
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and the planner knows its size from then on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqnet-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_kinds(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """df's rows of kind 0 and of kind 1, staged in folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqnet-{uuid.uuid4().hex}/{name}"
    df.write.partitionBy("kind").parquet(path)
    schema = df.drop("kind").schema
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/kind=0")  # either may have no rows
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/kind=1")
    return spark.read.schema(schema).parquet(f"{path}/kind=0"), spark.read.schema(schema).parquet(f"{path}/kind=1")


def drop_stage(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def some_rows(df: DataFrame, rows: int, *columns: str, total: int | None = None) -> DataFrame:
    """df if it has ``rows`` rows or fewer, else a sample by a 63-bit hash of the columns: about ``rows`` rows whatever the table's size, where the columns tell rows apart. Rows that agree in the columns count once, so that no group of copies is taken whole; where most agree, use distinct_sample()."""
    total = df.count() if total is None else total
    if total <= rows:
        return df
    h = F.shiftrightunsigned(F.xxhash64(*columns), 1)
    return df.withColumn("sample_h", h).where(F.col("sample_h") < int((1 << 63) / total * rows)).dropDuplicates(["sample_h"]).drop("sample_h")


def distinct_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Of rows that are distinct in the columns, the ``rows`` of the least hashes; all where there are fewer. The share to look at comes from an estimate of the number of distinct hashes, so copies don't thin it out."""
    h = F.shiftrightunsigned(F.xxhash64(*columns), 1)
    marked = df.withColumn("sample_h", h)
    n = marked.agg(F.approx_count_distinct("sample_h", 0.02)).first()[0]
    if n > 1.2 * rows:
        marked = marked.where(F.col("sample_h") < int((1 << 63) / n * rows * 1.2))
    return marked.dropDuplicates(["sample_h"]).orderBy("sample_h").limit(rows).drop("sample_h")


def pieces(batch, most: int = 4 << 20, column: str = "t"):
    """A batch in slices of about ``most`` bytes of the column's values at most; a longer value is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows < 2 or batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def row_key(doc_id: str, text: str) -> list:
    """Columns k and g, by which later joins find a row again. Rows that share both are copies of one row and get the same result."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.col(text)).alias("g")]

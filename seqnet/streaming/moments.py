"""Streams that feed fits: counts, sums and products of columns by window, whose covariances are the nodes of a chain of networks in time.

Moments are plain aggregates, so Spark merges them as rows arrive and keeps a row of state for each family and open window. A window leaves the stream when the watermark has passed it; what has left is appended to a table by micro-batch, which a repeated micro-batch replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqnet.operators.glasso import GlassoConfig, fit_time_varying_glasso


def pairs(columns: list[str]) -> list[tuple[str, str]]:
    """Pairs of columns in the order of a packed upper triangle."""
    return [(x, y) for k, x in enumerate(columns) for y in columns[k:]]


def window_moments(rows: DataFrame, columns: list[str], length: str, late: str = "1 day", ts: str = "ts", family: str | None = None) -> DataFrame:
    """family, start, n, s (sums), p (sums of products, a packed upper triangle) of rows, a stream or not, by tumbling window.

    Rows with a null or a non-finite number in any of the columns, or without a time, are left out whole; a null family is one of its own. Later rows than the watermark are left out of a stream."""
    if not columns:
        raise ValueError("no columns")
    good = F.col(ts).isNotNull()
    for c in columns:
        v = F.col(c).cast("double")
        good &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    v = [F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)]
    own = rows.where(good).select(F.col(ts).cast("timestamp").alias("at"), (F.lit("all") if family is None else F.col(family).cast("string")).alias("family"), *v).withWatermark("at", late)
    at = [f"v{k}" for k in range(len(columns))]
    sums, products = ([F.sum(x) for x in at], [F.sum(F.col(x) * F.col(y)) for x, y in pairs(at)])
    out = own.groupBy("family", F.window("at", length).alias("w")).agg(F.count("*").alias("n"), F.array(*sums).alias("s"), F.array(*products).alias("p"))
    return out.select("family", F.col("w.start").alias("start"), "n", "s", "p")


def write_moments(moments: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes each closed window of a stream of moments once: a folder for each micro-batch, which is replaced if that one is repeated."""

    def put(part: DataFrame, batch: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return moments.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def stored_moments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("family string, start timestamp, n bigint, s array<double>, p array<double>").parquet(path)


def _lay(batches):
    for b in batches:
        out = []
        for n, s, p in zip(b.column("n").to_pylist(), b.column("s").to_pylist(), b.column("p").to_pylist()):
            s = np.array(s)
            out.append((np.array(p) - np.outer(s, s)[np.triu_indices(len(s))] / n) / (n - 1))
        yield pa.RecordBatch.from_arrays([b.column("family"), b.column("start"), b.column("n"), pa.array(out, pa.list_(pa.float64()))], ["family", "start", "n", "theta"])


def window_covariances(moments: DataFrame) -> DataFrame:
    """family, start, n, theta: packed sample covariances of windows of two rows and more."""
    return moments.where("n > 1").mapInArrow(_lay, "family string, start timestamp, n bigint, theta array<double>")


def fit_windows(moments: DataFrame, cfg: GlassoConfig, last: int | None = None, ridge: float = 0.0, searching: bool = False) -> DataFrame:
    """The joint fit of each family's windows, in the order of time, weighted by their rows; with start. ``last``: only so many of the latest windows of each family. ``ridge`` is added to variances. A window of one row has no covariance and is left out; neighbours are then those that are left."""
    order = Window.partitionBy("family")
    cov = window_covariances(moments).withColumn("back", F.row_number().over(order.orderBy(F.desc("start"))))
    cov = cov if last is None else cov.where(F.col("back") <= last)
    # n (n + 1) / 2 numbers are packed; entry k of them is a variance where it begins a row of the triangle
    size = F.expr("cast((sqrt(8 * size(theta) + 1) - 1) / 2 as int)")
    place = F.transform(F.sequence(F.lit(0), F.col("dim") - 1), lambda i: (i * F.col("dim") - i * (i - 1) / 2).cast("int"))
    cov = cov.withColumn("dim", size).withColumn("own", place).withColumn("theta", F.transform("theta", lambda v, k: v + F.when(F.array_contains("own", k), F.lit(ridge)).otherwise(0.0)))
    nodes = cov.select("family", "start", (F.row_number().over(order.orderBy("start")) - 1).alias("cluster_idx"), F.col("n").cast("double").alias("wt"), "theta")
    fits = fit_time_varying_glasso(nodes.select("family", "cluster_idx", "wt", "theta"), cfg, searching)
    return fits.join(nodes.select("family", "cluster_idx", "start"), ["family", "cluster_idx"])

"""Scans of text files that large files are read in parallel by: Spark cuts a file at line (or record) boundaries into splits, and what depends on a place in the whole file is told by the split's place and the place in the split.

A row's place is (split, at): where its split begins in the file, and a number that ascends within the split. Places are ordered as the file is, so firsts, lasts and ranges need no numbering. Numbers that count from the file's start are the number in
the split plus what earlier splits of the file hold, a table of a row for each split.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("path", "split")


def _scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    rows = spark.read.options(**options).text(path)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")]
    return rows.select("*", *place)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, file (its name), split, at, value, and the folder's partition columns: a row for each line. An empty file has no lines."""
    return _scan(spark, path)


def records(spark: SparkSession, path: str, mark: str = ">") -> DataFrame:
    """The same with a row for each record: what begins with the mark at a line's start, without the mark, up to the next one. ``marked`` is false for what stands before a file's first mark."""
    rows = _scan(spark, path, lineSep=f"\n{mark}")
    # only a file's first record still has its mark, or has none
    starts = rows.where("split = 0").groupBy("path").agg(F.min("at").alias("first_at"))
    rows = rows.join(starts, "path", "left")
    first = (F.col("split") == 0) & (F.col("at") == F.col("first_at"))
    has = F.startswith("value", F.lit(mark))
    value = F.when(first & has, F.substring("value", len(mark) + 1, (1 << 31) - 1)).otherwise(F.col("value"))
    return rows.withColumn("marked", ~first | has).withColumn("value", value).drop("first_at")


def place() -> Column:
    return F.struct("split", "at")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with their number (0, 1, ...) in the file, as a long."""
    return with_offsets(counted(rows, F.lit(True)), "n", name).withColumn(name, F.col(name) - 1)


def counted(rows: DataFrame, condition: Column) -> DataFrame:
    """rows with n, the number of rows of the split up to this one that meet the condition; counted in the order of the scan, without a shuffle."""
    marked = rows.withColumn("meets", F.coalesce(condition, F.lit(False)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def each(batches):
        last, before = None, 0
        for b in batches:
            key = pa.StructArray.from_arrays([b.column("path"), b.column("split")], ["p", "s"])
            n = [0] * b.num_rows
            at = 0
            places = key.to_pylist() if b.num_rows and (key[0] != key[b.num_rows - 1]) else None
            while at < b.num_rows:
                own = key[at].as_py()
                end = b.num_rows if places is None else next((i for i in range(at, b.num_rows) if places[i] != own), b.num_rows)
                if own != last:
                    last, before = own, 0
                sums = pc.add(pc.cumulative_sum(pc.cast(b.column("meets").slice(at, end - at), pa.int64())), before)
                n[at:end] = sums.to_pylist()
                before = n[end - 1]
                at = end
            yield b.drop_columns(["meets"]).append_column("n", pa.array(n, pa.int64()))

    return marked.mapInArrow(each, f"{kind}, n bigint")


def with_offsets(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with ``name``: the column, which counts within a split, plus its largest values in the file's earlier splits."""
    sizes = rows.groupBy(*PLACE).agg(F.max(column).alias("size"))
    before = sizes.select(*PLACE, (F.sum("size").over(Window.partitionBy("path").orderBy("split")) - F.col("size")).alias("before"))
    return rows.join(before, list(PLACE)).withColumn(name, F.col(column) + F.col("before")).drop("before", *([column] if column != name else []))

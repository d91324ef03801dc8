"""All pairs of rows of a key, made in cells of two blocks that are dealt to tasks, so that neither a large key nor a small input (which Spark would put into few tasks) leaves the work to one of them. Pairs are made where they are used; none is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, about, and blocks of a key at most: a row is dealt to as many cells as its key has blocks.
BLOCK, BLOCKS = 256, 64
#: Pairs of a task, about, and tasks at most.
PAIRS, TASKS = 8_000_000, 4000
#: The columns that name a pair's cell, beside its key.
CELL = ("ba_", "bb_")


def _blocks(rows: DataFrame, key: str, block: int | None = None, each: int | None = None) -> tuple[DataFrame, int]:
    """key, of_ (its number of blocks), and the number of tasks."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows_"))
    pairs = sizes.agg(F.sum(F.col("rows_").cast("double") * F.col("rows_"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, int(pairs // (each or PAIRS))))
    return sizes.select(key, F.least(F.lit(BLOCKS), F.ceil(F.col("rows_") / (block or BLOCK))).cast("int").alias("of_")), tasks


def all_pairs(a: DataFrame, b: DataFrame, key: str, of_a: Column, of_b: Column, each: int | None = None) -> DataFrame:
    """a joined with b on key, which have no other column in common, with CELL; of_a and of_b name the rows, and rows of the same name are in the same block. b has no more keys than a, and about as many rows of each."""
    blocks, tasks = _blocks(a, key, each=each)
    every = F.explode(F.sequence(F.lit(0), F.col("of_") - 1))
    block = lambda of: F.pmod(F.xxhash64(of), F.col("of_")).cast("int")
    left = a.join(blocks, key).withColumn("ba_", block(of_a)).withColumn("bb_", every).drop("of_")
    right = b.join(blocks, key).withColumn("bb_", block(of_b)).withColumn("ba_", every).drop("of_")
    return left.repartition(tasks, key, *CELL).join(right.repartition(tasks, key, *CELL).hint("merge"), [key, *CELL])


def id_pairs(rows: DataFrame, key: str, name: str, carried: tuple[str, ...] = (), each: int | None = None) -> DataFrame:
    """key, i, j, CELL and <c>_i, <c>_j of the carried columns: all pairs i < j of the numbers ``name`` of rows."""
    blocks, tasks = _blocks(rows, key, each=each)
    block = F.pmod(F.xxhash64(name), F.col("of_")).cast("int")
    own = rows.select(key, name, *carried).join(blocks, key)
    left = own.withColumn("ba_", block).withColumn("bb_", F.explode(F.sequence("ba_", F.col("of_") - 1))).drop("of_").withColumnsRenamed({c: f"{c}_x" for c in (name, *carried)})
    right = own.withColumn("bb_", block).withColumn("ba_", F.explode(F.sequence(F.lit(0), F.col("bb_")))).drop("of_").withColumnsRenamed({c: f"{c}_y" for c in (name, *carried)})
    x, y = F.col(f"{name}_x"), F.col(f"{name}_y")
    # in a cell of two blocks each pair is met once, in either order
    both = left.repartition(tasks, key, *CELL).join(right.repartition(tasks, key, *CELL).hint("merge"), [key, *CELL]).where((x < y) | ((F.col("ba_") < F.col("bb_")) & (x > y)))
    sides = [c.alias(f"{n}_{s}") for n in carried for s, c in (("i", F.when(x < y, F.col(f"{n}_x")).otherwise(F.col(f"{n}_y"))), ("j", F.when(x < y, F.col(f"{n}_y")).otherwise(F.col(f"{n}_x"))))]
    return both.select(key, F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), *CELL, *sides)


def rounded(c: Column, digits: int) -> Column:
    """round(c, digits) of doubles, without decimals unless c is large, no number, or near the half that it would be rounded at."""
    t = F.abs(c) * float(10**digits)
    k = F.floor(t + 0.5)
    whole = F.when(c < 0, -k).otherwise(k) / float(10**digits)
    return F.when((t < 1e11) & (F.abs(t - F.floor(t) - 0.5) > 1e-4), whole).otherwise(F.round(c, digits))


def block_pairs(rows: DataFrame, key: str, name: str, what: list[str], half: bool = False, block: int | None = None, each: int | None = None) -> DataFrame:
    """key, CELL, a, b: pairs of blocks of rows, as arrays of structs ``what``, some ``each`` pairs of rows a task. With half, each pair of blocks once (ba_ <= bb_), and a block with itself."""
    sizes, tasks = _blocks(rows, key, block, each)
    dealt = rows.join(sizes, key).withColumn("blk_", F.pmod(F.xxhash64(name), F.col("of_")).cast("int"))
    blocks = dealt.repartition(tasks, key, "blk_").groupBy(key, "blk_", "of_").agg(F.collect_list(F.struct(*what)).alias("s"))
    a = blocks.select(key, F.col("blk_").alias("ba_"), F.explode(F.sequence("blk_" if half else F.lit(0), F.col("of_") - 1)).alias("bb_"), F.col("s").alias("a"))
    b = blocks.select(key, F.explode(F.sequence(F.lit(0), "blk_" if half else F.col("of_") - 1)).alias("ba_"), F.col("blk_").alias("bb_"), F.col("s").alias("b"))
    return a.repartition(tasks, key, *CELL).join(b.repartition(tasks, key, *CELL).hint("merge"), [key, *CELL])


def places(batch: pa.RecordBatch, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For rows of block_pairs(): the numbers of rows, of the structs of a and of those of b (in the flattened arrays) that make all their pairs, some ``most`` pairs at a time; a pair of blocks is cut where it is larger."""
    a, b = (batch.column(c).offsets.to_numpy().astype(np.int64) - batch.column(c).offsets[0].as_py() for c in "ab")
    held, size = [], 0
    for r in range(batch.num_rows):
        nb = int(b[r + 1] - b[r])
        step = max(1, most // max(1, nb))
        for lo in range(int(a[r]), int(a[r + 1]), step):
            hi = min(lo + step, int(a[r + 1]))
            held.append((np.full((hi - lo) * nb, r), np.repeat(np.arange(lo, hi), nb), np.tile(np.arange(b[r], b[r + 1]), hi - lo)))
            size += (hi - lo) * nb
            if size >= most:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))

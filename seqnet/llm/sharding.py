"""Puts groups of equal texts into fixed-capacity shards by best-fit decreasing.

A group is indivisible; its size is the sum of its rows' sizes. All groups are packed, in order of falling size, each into the shard with the tightest remaining capacity that holds it, found in a balanced tree. Groups of one size are alike to the packing,
so the driver packs sizes with their counts: a shard that is the tightest for a size stays so until it can't hold another one, and takes as many as fit at once. The driver holds a number for each distinct size (at most the square root of twice the
bytes of all texts) and each shard, never one for each group. Which groups of a size go where is then told by their rank among the groups of that size, which is counted in pieces.

A group above a shard's fair share of what is left gets a shard of its own, first of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stage

SHARDS = 8
#: Rows that are ranked in one piece, about; there are as many pieces as that needs.
PIECE_ROWS = 500_000
#: Ranks of one join key, where runs of ranks meet groups.
BUCKET = 256


class Tree:
    """Treap of (remaining capacity, bin) with the least key not below a bound in logarithmic time; priorities come from the bin's number."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _priority(b: int) -> int:
        return (b * 2654435761 + 12345) & 0xFFFFFFFF

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            return (t[0], t[1], t[2], a), b
        a, b = self._split(t[2], key)
        return a, (t[0], t[1], b, t[3])

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._join(a[3], b)
        return b[0], b[1], self._join(a, b[2]), b[3]

    def add(self, left: int, b: int) -> None:
        lo, hi = self._split(self.root, (left, b))
        self.root = self._join(self._join(lo, ((left, b), self._priority(b), None, None)), hi)

    def take(self, size: int):
        """Removes and returns the tightest (remaining, bin) that holds size, or None."""
        lo, hi = self._split(self.root, (size, -1))
        if hi is None:
            self.root = lo
            return None
        t = hi
        while t[2] is not None:
            t = t[2]
        _, rest = self._split(hi, (t[0][0], t[0][1] + 1))
        self.root = self._join(lo, rest)
        return t[0]


def best_fit(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int] | None:
    """Runs (size, from rank, to rank, bin, items a bin) of (size, count) in order of falling size, and the number of bins: rank r of a run is in bin + (r - from) // items a bin. An item over the capacity gets a bin of its own. None if more than ``most`` bins are needed."""
    tree, runs, bins = Tree(), [], 0
    for size, count in sorted(classes, reverse=True):
        at = 0
        while at < count:
            got = tree.take(size)
            if got is not None:
                left, b = got
                n = min(count - at, left // size)
                runs.append((size, at, at + n, b, n))
                if left > n * size:
                    tree.add(left - n * size, b)
                at += n
                continue
            each = max(1, capacity // size)
            new = -(-(count - at) // each)
            if most is not None and bins + new > most:
                return None
            runs.append((size, at, count, bins, each))
            for b in range(new):
                left = capacity - size * min(each, count - at - b * each)
                if left > 0:
                    tree.add(left, bins + b)
            bins, at = bins + new, count
    return runs, bins


def alone(sizes: list[int], total: int, shards: int) -> tuple[int, int]:
    """How many of the largest sizes, falling, get a shard of their own, each being above the fair share of what those before it leave of total; and what all of them leave."""
    n = 0
    while n < min(len(sizes), shards) and sizes[n] * (shards - n) > total:
        total, n = total - sizes[n], n + 1
    return n, total


def pack_into(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs as of best_fit. Items above the fair share of what is left go to the first shards, one each; the rest by best fit with the least capacity that needs no more than the other shards."""
    classes = sorted(classes, reverse=True)
    top = [s for s, c in classes[:shards] for _ in range(min(c, shards))][:shards]
    n, total = alone(top, sum(s * c for s, c in classes), shards)
    out, skipped = [], {}
    for b, size in enumerate(top[:n]):
        out.append((size, skipped.get(size, 0), skipped.get(size, 0) + 1, b, 1))
        skipped[size] = skipped.get(size, 0) + 1
    rest, shards = [(s, c - skipped.get(s, 0)) for s, c in classes if c > skipped.get(s, 0)], shards - n
    if not rest:
        return out
    lo = hi = max(-(-total // shards), rest[0][0])
    step = 1
    while (got := best_fit(rest, hi, shards)) is None:
        lo, hi, step = hi + 1, hi + step, 2 * step
    while lo < hi:
        mid = (lo + hi) // 2
        less = best_fit(rest, mid, shards)
        if less is not None:
            hi, got = mid, less
        else:
            lo = mid + 1
    return out + [(s, lo + skipped.get(s, 0), hi + skipped.get(s, 0), n + b, each) for s, lo, hi, b, each in got[0]]


def ranked(rows: DataFrame, group: str, order: list[str], pieces: int) -> DataFrame:
    """rows with ``rank``, from 0 without gaps in each group: counted in pieces by a hash of the order's columns."""
    rows = rows.withColumn("piece", F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    counts = rows.groupBy(group, "piece").agg(F.count("*").alias("n"))
    before = counts.select(group, "piece", (F.sum("n").over(Window.partitionBy(group).orderBy("piece")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(group, "piece").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(before, [group, "piece"]).withColumn("rank", (F.col("own") + F.col("before")).cast("long")).drop("piece", "own", "before")


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: k (doc_id), size, text_crc32, shard, slot. With ``capacity`` (bytes), as few shards of that capacity as best fit needs; else ``shards`` shards of nearly equal bytes.

    Only a group above the fair share of what is left makes bytes unequal: it has a shard to itself, and the others are nearly equal.
    Rows with equal texts share a shard; null texts (size 1, crc32 of nothing) are one group of their own. A group over the capacity gets a shard of its own. Groups of equal size are alike (a hash tells their order); repeated rows are separate rows
    with slots of their own. Slots run from 0 in each shard without gaps. Extra columns are ignored. Empty table: no rows.
    """
    t, spark = F.col(text_col), docs.sparkSession
    rows = docs.select(F.col(id_col).alias("k"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(t, F.lit("")), "UTF-8")).alias("text_crc32"), F.coalesce(F.unhex(F.md5(F.encode(t, "UTF-8"))), F.lit(b"")).alias("grp"))
    rows = stage(rows, "rows")
    groups = stage(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    classes = [(r["bytes"], r["c"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("c")).collect()]  # distinct sizes, see above
    n_rows = groups.agg(F.sum("rows").alias("n")).first()["n"] or 0
    runs = best_fit(classes, capacity)[0] if capacity is not None else pack_into(classes, shards or SHARDS)
    placed = stage(spark.createDataFrame(runs or [(0, 0, 0, 0, 1)], "bytes long, lo long, hi long, shard long, each long"), "placed")
    placed = placed.where("hi > lo").select("*", F.explode(F.sequence(F.expr(f"lo div {BUCKET}"), F.expr(f"(hi - 1) div {BUCKET}"))).alias("bucket"))

    few = sum(c for _, c in classes)
    order = ranked(groups.select("grp", "bytes"), "bytes", ["grp"], -(-few // PIECE_ROWS) or 1).withColumn("bucket", F.expr(f"rank div {BUCKET}"))
    dealt = order.join(placed, ["bytes", "bucket"]).where("rank >= lo and rank < hi").select("grp", F.expr("cast(shard + (rank - lo) div each as int)").alias("shard"))
    # a group of copies may hold a third of the rows: the planner's skew join splits its rows
    rows = stage(rows.join(dealt.hint("merge"), "grp").select("k", "size", "text_crc32", "shard"), "dealt")
    return ranked(rows, "shard", ["k", "text_crc32", "size"], -(-n_rows // PIECE_ROWS) or 1).select("k", "size", "text_crc32", "shard", F.col("rank").alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select(F.col("k").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

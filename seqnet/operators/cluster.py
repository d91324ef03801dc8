"""Ordered clusters of a family's sequences. Linkage is sequential: a family is a task there, families are spread; greedy clusters are made in rounds over all families."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqnet.operators.pairs import block_pairs
from seqnet.operators.tables import written

#: BLOSUM62, rows and columns in the order of the alphabet.
BLOSUM62 = """
4 -1 -2 -2 0 -1 -1 0 -2 -1 -1 -1 -1 -2 -1 1 0 -3 -2 0
-1 5 0 -2 -3 1 0 -2 0 -3 -2 2 -1 -3 -2 -1 -1 -3 -2 -3
-2 0 6 1 -3 0 0 0 1 -3 -3 0 -2 -3 -2 1 0 -4 -2 -3
-2 -2 1 6 -3 0 2 -1 -1 -3 -4 -1 -3 -3 -1 0 -1 -4 -3 -3
0 -3 -3 -3 9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1
-1 1 0 0 -3 5 2 -2 0 -3 -2 1 0 -3 -1 0 -1 -2 -1 -2
-1 0 0 2 -4 2 5 -2 0 -3 -3 1 -2 -3 -1 0 -1 -3 -2 -2
0 -2 0 -1 -3 -2 -2 6 -2 -4 -4 -2 -3 -3 -2 0 -2 -2 -3 -3
-2 0 1 -1 -3 0 0 -2 8 -3 -3 -1 -2 -1 -2 -1 -2 -2 2 -3
-1 -3 -3 -3 -1 -3 -3 -4 -3 4 2 -3 1 0 -3 -2 -1 -3 -1 3
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4 -2 2 0 -3 -2 -1 -2 -1 1
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5 -1 -3 -1 0 -1 -3 -2 -2
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5 0 -2 -1 -1 -1 -1 1
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6 -4 -2 -2 1 3 -1
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7 -1 -1 -4 -3 -2
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4 1 -3 -2 -2
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5 -2 -2 0
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11 2 -3
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7 -1
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
MATRIX = np.array([[int(v) for v in line.split()] for line in BLOSUM62.strip().splitlines()])


def blosum_distance(seqs: list[str]) -> np.ndarray:
    """1 - score / max of the two self scores; columns with a gap in either sequence are left out, 1 where that maximum is 0."""
    from seqnet.operators.linkage import distances_between

    n = len(seqs)
    d = np.empty((n, n))
    for k in range(0, n, 512):
        d[k : k + 512] = distances_between(seqs[k : k + 512], seqs)
    np.fill_diagonal(d, 0)
    return d


def balance_bonus(sizes: np.ndarray) -> np.ndarray:
    """How much a merge of small clusters is favoured, 0 to 1."""
    x = np.log(sizes.astype(float))
    b = np.exp(-(x[:, None] + x[None, :]) + np.log(sizes[:, None] + sizes[None, :]))
    np.fill_diagonal(b, 0)
    return b / b.max() if b.max() > 0 else b


def agglomerate(d: np.ndarray, k: int, balance_below: int = 100, start: list[list[int]] | None = None) -> tuple[list[list[int]], np.ndarray]:
    """Complete linkage down to k groups, and the distances between them, from single members or from the groups of start; row minima are kept."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    groups: list[list[int] | None] = [[i] for i in range(n)] if start is None else [list(g) for g in start]
    alive = np.ones(n, bool)
    low = d.min(1) if n > 1 else np.full(n, np.inf)
    left, every = n, np.arange(n)
    while left > max(1, k):
        if left < balance_below:
            idx = np.nonzero(alive)[0]
            sub = d[np.ix_(idx, idx)] - balance_bonus(np.array([len(groups[i]) for i in idx]))
            np.fill_diagonal(sub, np.inf)
            a, b = divmod(int(sub.argmin()), len(idx))
            i, j = int(idx[a]), int(idx[b])
        else:
            i = int(np.where(alive, low, np.inf).argmin())
            j = int(np.where(alive, d[i], np.inf).argmin())
        i, j = min(i, j), max(i, j)
        # entries only grow, so the minimum of a row is found anew only where it stood at one of the two
        stale = alive & ((low >= d[i]) | (low >= d[j]) | (every == i))
        new = np.maximum(d[i], d[j])
        new[i] = new[j] = np.inf
        d[i, :], d[:, i] = new, new
        d[j, :], d[:, j] = np.inf, np.inf
        groups[i] += groups[j]
        groups[j], alive[j] = None, False
        stale[j] = False
        low[stale] = d[stale].min(1)
        left -= 1
    idx = np.nonzero(alive)[0]
    return [sorted(groups[i]) for i in idx], d[np.ix_(idx, idx)]


def ordered(groups: list[list[int]], d: np.ndarray, target: int | None) -> list[list[int]]:
    """The target's group (else the largest) first, the others by distance to it."""
    at = next((g for g, m in enumerate(groups) if target in m), None) if target is not None else None
    at = at if at is not None else max(range(len(groups)), key=lambda g: (len(groups[g]), -g))
    by = sorted(range(len(groups)), key=lambda g: (g != at, d[at][g] if len(groups) > 1 else 0, g))
    return [groups[g] for g in by]


def phylo_clusters(msa: DataFrame, k: int | None = None, most: int = 12000) -> DataFrame:
    """family, cluster_idx, seq_id; k defaults to min(4, max(2, n // 600)). The family's first sequence is the target. A family of up to ``most`` sequences is one task's matrix; larger ones are linked by rounds over rows (linkage.linked_clusters)."""
    from seqnet.operators.linkage import linked_clusters

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        d = blosum_distance(list(pdf["seq"]))
        n = len(pdf)
        groups, between = agglomerate(d, k or min(4, max(2, n // 600)))
        ids, rows = list(pdf["seq_id"]), []
        for c, g in enumerate(ordered(groups, between, 0)):
            rows += [(str(pdf["family"].iloc[0]), c, int(ids[i])) for i in g]
        return pd.DataFrame(rows, columns=["family", "cluster_idx", "seq_id"]).astype({"cluster_idx": "int32"})

    large = written(msa.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") > most).select("family"), "large")
    tasks = int(msa.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given stays, however few bytes there are
    small = msa.join(large, "family", "left_anti").select("family", "seq_id", "seq").repartition(tasks, "family").groupBy("family").applyInPandas(run, "family string, cluster_idx int, seq_id bigint")
    return small if large.isEmpty() else small.unionByName(linked_clusters(msa.join(large, "family", "left_semi"), k))


class Columns:
    """Heads of aligned sequences; a sequence matches a head that it agrees with in ``identity`` of its own letters, column by column."""

    def __init__(self, identity: float):
        self.identity, self.n, self.x = identity, 0, None

    def add(self, seq: str) -> None:
        row = self._letters([seq])
        if self.x is None:
            self.x = row
        elif self.n == len(self.x):
            self.x = np.concatenate([self.x, np.zeros_like(self.x)])
        self.x[self.n] = row
        self.n += 1

    def first(self, seqs: list[str], since: int = 0) -> np.ndarray:
        """The first head, from number ``since`` on, that each sequence matches, or -1."""
        out, at = np.full(len(seqs), -1), np.arange(len(seqs))
        if self.n <= since:
            return out
        x = self._letters(seqs)
        n = np.maximum(1, (x != 45).sum(1))
        for k in range(since, self.n, 64):
            if not len(at):
                break
            heads = self.x[k : min(k + 64, self.n)]
            same = ((x[at, None, :] == heads[None]) & (x[at, None, :] != 45)).sum(2) / n[at][:, None] >= self.identity
            hit = same.any(1)
            out[at[hit]] = k + same[hit].argmax(1)
            at = at[~hit]
        return out

    @staticmethod
    def _letters(seqs: list[str]) -> np.ndarray:
        return np.array([[ord(c) for c in s] for s in seqs], np.int32)


def greedy_clusters(msa: DataFrame, identity: float = 0.8, batch: int = 1000) -> DataFrame:
    """Longest first: a sequence joins the first cluster whose head it agrees with in ``identity`` of its letters, else it heads a new one. Sequences are aligned; words.greedy_word_clusters takes unaligned ones."""
    return greedy_rounds(msa.select("family", "seq_id", "seq", F.length(F.replace("seq", F.lit("-"), F.lit(""))).alias("n")), lambda: Columns(identity), batch)


#: Sequences of a batch that meet the heads before them together.
TOGETHER = 64


def greedy_rounds(left: DataFrame, matcher, batch: int = 1000) -> DataFrame:
    """family, cluster_idx, seq_id of sequences (family, seq_id, seq, n: their length), longest first: each joins the first head that it matches, else it heads a new cluster. ``matcher()`` makes an empty set of heads with add(seq) and first(seqs, since).

    Rounds over all families at once: the longest ``batch`` sequences that are left of each family are clustered in order, in one task; all others that are left meet the new heads in blocks, spread over the cluster, and join the first that matches. The result is that of going
    through a family one by one; a task holds a batch, or a batch's heads and a block. (Spark keeps the longest of each task before they are shuffled up to a batch of 1000, spark.sql.optimizer.windowGroupLimitThreshold.) A family takes a round for each ``batch`` sequences that match no earlier head."""
    done, base = None, None

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "seq_id"], ascending=[False, True])
        heads, is_head, out, known, seqs = matcher(), [], [], 0, list(pdf["seq"])
        for k in range(0, len(seqs), TOGETHER):
            part, since = seqs[k : k + TOGETHER], known
            for seq, hit in zip(part, heads.first(part).tolist()):
                if hit < 0:  # no earlier part's head; the heads of this part come after those
                    hit = int(heads.first([seq], since)[0])
                is_head.append(hit < 0)
                if hit < 0:
                    heads.add(seq)
                    hit, known = known, known + 1
                out.append(hit)
        return pd.DataFrame({"family": pdf["family"].astype(str), "at": np.array(out, np.int32), "seq_id": pdf["seq_id"], "seq": pdf["seq"], "head": is_head})

    def against(batches):
        for pdf in batches:
            for heads, block in zip(pdf["heads"], pdf["block"]):
                known = matcher()
                for h in heads:
                    known.add(h["seq"])
                hit = known.first([v["seq"] for v in block])
                yield pd.DataFrame({"family": [v["family"] for v in block], "seq_id": [v["seq_id"] for v in block], "seq": [v["seq"] for v in block], "n": np.array([v["n"] for v in block], np.int32), "at": hit.astype("int32")})

    order = Window.partitionBy("family").orderBy(F.desc("n"), "seq_id")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given stays, however few bytes there are, unless the rows are dealt so already
    for turn in range(1 << 30):
        now = written(left.withColumn("place", F.row_number().over(order)).where(f"place <= {batch}").drop("place").repartition(tasks + 1, "family").groupBy("family").applyInPandas(within, "family string, at int, seq_id bigint, seq string, head boolean"), f"batch-{turn}")
        heads = now.where("head").groupBy("family").agg(F.sort_array(F.collect_list(F.struct("at", "seq"))).alias("heads"))  # batch at most
        more = now.select("family", "at", "seq_id")
        rest = left.join(now.select("family", "seq_id"), ["family", "seq_id"], "left_anti")
        sizes = rest.groupBy("family").agg(F.ceil(F.count("*") / 512).alias("of"))
        blocks = rest.join(sizes, "family").withColumn("blk", F.pmod(F.xxhash64("seq_id"), F.col("of"))).repartition(tasks, "family", "blk").groupBy("family", "blk").agg(F.collect_list(F.struct("family", "seq_id", "seq", "n")).alias("block"))
        dealt = heads.join(sizes, "family").select("family", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1)).alias("blk"), "heads").repartition(tasks, "family", "blk")
        met = written(blocks.join(dealt, ["family", "blk"]).select("heads", "block").mapInPandas(against, "family string, seq_id bigint, seq string, n int, at int"), f"met-{turn}")
        more = more.unionByName(met.where("at >= 0").select("family", "at", "seq_id"))
        # places of heads go on after those of earlier rounds
        count = now.where("head").groupBy("family").agg(F.count("*").alias("c"))
        more = more if base is None else more.join(base, "family", "left").select("family", (F.col("at") + F.coalesce("base", F.lit(0))).cast("int").alias("at"), "seq_id")
        done = more if done is None else done.unionByName(more)
        base = count.withColumnRenamed("c", "base") if base is None else base.join(count, "family", "full").select("family", (F.coalesce("base", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("base"))
        base = written(base, f"base-{turn}")
        left = met.where("at < 0").select("family", "seq_id", "seq", "n")
        if not left.head(1):
            return done.select("family", F.col("at").alias("cluster_idx"), "seq_id")


def random_clusters(msa: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A seeded shuffle by modular arithmetic, cut into slices of n // k + 1."""
    w = Window.partitionBy("family")
    place = F.row_number().over(w.orderBy((F.col("seq_id") * 7919 + seed) % 104729, "seq_id")) - 1
    out = msa.select("family", "seq_id", place.alias("place"), F.count("*").over(w).alias("n"))
    return out.select("family", F.floor(F.col("place") / (F.floor(F.col("n") / k) + 1)).cast("int").alias("cluster_idx"), "seq_id")


def with_all_first(msa: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """Cluster 0 is the whole family, then the first k - 1 clusters."""
    whole = msa.select("family", F.lit(0).alias("cluster_idx"), "seq_id")
    return whole.unionByName(clusters.where(F.col("cluster_idx") < k - 1).select("family", (F.col("cluster_idx") + 1).alias("cluster_idx"), "seq_id"))


def chain_edges(clusters: DataFrame) -> DataFrame:
    """Edges between consecutive clusters of a family."""
    w = Window.partitionBy("family").orderBy("cluster_idx")
    return clusters.select("family", "cluster_idx").distinct().select("family", F.lag("cluster_idx").over(w).alias("src"), F.col("cluster_idx").alias("dst")).where("src is not null")


def linkage(dist: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Largest, 0.8 quantile and mean distance between groups; dist (family, i, j, d), groups (family, seq_id, g), or dist (family, ga, gb, d) alone. Equal distances are counted before anything moves."""
    if groups is not None:
        a = groups.select("family", F.col("seq_id").alias("i"), F.col("g").alias("ga"))
        b = groups.select("family", F.col("seq_id").alias("j"), F.col("g").alias("gb"))
        dist = dist.join(a, ["family", "i"]).join(b, ["family", "j"])
    counts = dist.where("ga <> gb").groupBy("family", F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), "d").agg(F.count("*").alias("n_"))
    known = F.when(F.col("d").isNotNull(), F.col("n_"))
    return counts.groupBy("family", "ga", "gb").agg(F.max("d").alias("largest"), F.percentile("d", F.lit(0.8), F.col("n_")).alias("q80"), (F.sum(F.col("d") * F.col("n_")) / F.sum(known)).alias("mean"))


def supplied(lists: DataFrame) -> DataFrame:
    """Clusters from lists (family, clusters: array of arrays of seq_id), in their order: family, cluster_idx, seq_id."""
    return lists.select("family", F.posexplode("clusters").alias("cluster_idx", "ids")).select("family", "cluster_idx", F.explode("ids").alias("seq_id"))


def with_target(clusters: DataFrame, msa: DataFrame, targets: DataFrame) -> DataFrame:
    """family, cluster_idx, is_target: whether the cluster holds the family's target sequence (family, target), the all-sequence cluster 0 not counting."""
    own = clusters.join(msa, ["family", "seq_id"]).join(targets, "family")
    return own.groupBy("family", "cluster_idx").agg((F.max((F.col("seq") == F.col("target")).cast("int")) > 0).alias("holds")).select("family", "cluster_idx", (F.col("holds") & (F.col("cluster_idx") > 0)).alias("is_target"))


def order_by_distance(dist: DataFrame, start: DataFrame) -> DataFrame:
    """family, g, cluster_idx: groups in the order of their distance (family, ga, gb, d; both directions or one) from the family's start group (family, g), which comes first."""
    both = dist.select("family", F.col("ga").alias("g"), F.col("gb").alias("other"), "d").unionByName(dist.select("family", F.col("gb").alias("g"), F.col("ga").alias("other"), "d"))
    near = both.join(start, ["family", "g"]).groupBy("family", "other").agg(F.min("d").alias("d")).select("family", F.col("other").alias("g"), "d")
    rows = near.unionByName(start.select("family", "g", F.lit(-1.0).alias("d")))
    return rows.select("family", "g", (F.row_number().over(Window.partitionBy("family").orderBy("d", "g")) - 1).alias("cluster_idx"))


def blosum_pairs(msa: DataFrame) -> DataFrame:
    """family, i, j, d for i < j: 1 - score / max of the two self scores, over columns without a gap in either. Pairs of blocks of a family are compared as arrays, in tasks. The matrix form is blosum_distance."""
    from seqnet.operators.linkage import distances_between

    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (ia, sa), (ib, sb) = ((v.field("seq_id").to_numpy(), v.field("seq").to_pylist()) for v in (batch.column(c)[r].values for c in "ab"))
                for k in range(0, len(ia), 512):
                    part = ia[k : k + 512]
                    # a block with itself has each pair twice, two blocks have it once
                    use = part[:, None] < ib[None, :] if batch.column("ba_")[r] == batch.column("bb_")[r] else part[:, None] != ib[None, :]
                    x, y = np.nonzero(use)
                    d = distances_between(sa[k : k + 512], sb)[x, y]
                    i, j = np.minimum(part[x], ib[y]), np.maximum(part[x], ib[y])
                    yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(d), np.int32), pa.array([batch.column("family")[r].as_py()])).cast(pa.string()), pa.array(i), pa.array(j), pa.array(d)], ["family", "i", "j", "d"])

    return block_pairs(msa.where("seq is not null and seq_id is not null"), "family", "seq_id", ["seq_id", "seq"], half=True).mapInArrow(each, "family string, i bigint, j bigint, d double")

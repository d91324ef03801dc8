"""Matrices as rows (…, r, c, v); dense steps as numpy in one task for each matrix."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqnet.operators.tables import written


def pack(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def unpack(v: np.ndarray) -> np.ndarray:
    n = int((-1 + np.sqrt(1 + 8 * len(v))) / 2 + 0.5)
    m = np.zeros((n, n))
    m[np.triu_indices(n)] = v
    return m + m.T - np.diag(np.diag(m))


def unpack_banded(v: np.ndarray, eps: float) -> np.ndarray:
    """As unpack, with entries within eps of 0 set to 0."""
    return unpack(np.where(np.abs(v) <= eps, 0.0, v))


def unpack_long(upper: DataFrame, keys: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """All entries (keys, within, r, c, v) of symmetric matrices given by those with r <= c."""
    entry = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    both = F.when(F.col("r") < F.col("c"), F.array(entry("r", "c"), entry("c", "r"))).otherwise(F.array(entry("r", "c")))
    return upper.select(*keys, *within, "v", F.explode(both).alias("x")).select(*keys, *within, "x.r", "x.c", "v")


def reembed(m: DataFrame, removed: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Matrices (keys, r, c, v), from 0, over the indices that are left, as matrices over all: removed (keys, pos) come back as 0; sizes (keys, n) are the full sizes."""
    gone = removed.groupBy(*keys).agg(F.collect_set("pos").alias("gone"))
    kept = sizes.join(gone, keys, "left").select(*keys, F.posexplode(F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.coalesce("gone", F.array().cast("array<bigint>")))).alias("at", "pos"))
    a, b = kept.select(*keys, F.col("at").alias("r"), F.col("pos").alias("rr")), kept.select(*keys, F.col("at").alias("c"), F.col("pos").alias("cc"))
    known = m.join(a, [*keys, "r"]).join(b, [*keys, "c"]).select(*keys, F.col("rr").alias("r"), F.col("cc").alias("c"), "v")
    every = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("r")).select(*keys, "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("c"))
    return every.join(known, [*keys, "r", "c"], "left").select(*keys, "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def symmetric_only(m: DataFrame, keys: list[str], tol: float = 1e-9, within: tuple[str, ...] = ()) -> DataFrame:
    """Matrices (keys, r, c, v) that are symmetric, by comparing each entry with its mirror image in one aggregation. within: columns of m, by which its rows are dealt to tasks and which are the same for an entry and its mirror image; entries aren't shuffled then."""
    pair = m.groupBy(*keys, *within, F.least("r", "c").alias("a"), F.greatest("r", "c").alias("b")).agg((F.max("v") - F.min("v")).alias("d"), F.count("*").alias("n"))
    good = pair.groupBy(*keys).agg(F.max((F.col("d") > tol) | ((F.col("a") < F.col("b")) & (F.col("n") != 2))).alias("bad")).where("not bad")
    return m.join(written(good.select(*keys), "symmetric"), keys, "left_semi")


def definite(packed: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """keys, definite of packed matrices (keys, theta): whether all eigenvalues are above ``least``; false where an entry is null or not finite, or there is none. A matrix is a row, repeated keys give one each."""

    def positive(m):
        return bool(len(m) and np.isfinite(m).all() and np.linalg.eigvalsh(m)[0] > least)

    kinds = ", ".join(f"{k} {packed.schema[k].dataType.simpleString()}" for k in keys)
    whole = packed.select(*keys, F.transform(F.coalesce("theta", F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(float("nan")))).alias("theta"))
    return each_matrix(whole, lambda m: [positive(m)], f"{kinds}, definite boolean", keys)


def remove_positions(cov: DataFrame, bad: DataFrame, on: str = "family") -> DataFrame:
    """cov (family, …, i, j) without pairs that have a position of bad (family, pos) in either place."""
    return cov.join(bad.select(on, F.col("pos").alias("i")), [on, "i"], "left_anti").join(bad.select(on, F.col("pos").alias("j")), [on, "j"], "left_anti")


def mask_positions(cov: DataFrame, bad: DataFrame) -> DataFrame:
    """cov with 0 where either position is bad, blocks i = j as they are."""
    a = bad.select("family", F.col("pos").alias("i"), F.lit(True).alias("bi"))
    b = bad.select("family", F.col("pos").alias("j"), F.lit(True).alias("bj"))
    out = cov.join(a, ["family", "i"], "left").join(b, ["family", "j"], "left")
    return out.withColumn("v", F.when((F.col("i") != F.col("j")) & (F.col("bi").isNotNull() | F.col("bj").isNotNull()), 0.0).otherwise(F.col("v"))).drop("bi", "bj")


def bad_positions(gaps: DataFrame, most: float) -> DataFrame:
    return gaps.where(F.col("gap") > most).select("family", "pos").distinct()


def threshold(m: DataFrame, t: float) -> DataFrame:
    return m.withColumn("v", F.when(F.abs("v") < t, 0.0).otherwise(F.col("v")))


def density(m: DataFrame, keys: list[str], t: float = 1e-3) -> DataFrame:
    """Share of entries of at least t; m holds the whole matrix, or with a column ``times`` how often an entry stands in it."""
    w = F.col("times") if "times" in m.columns else F.lit(1)
    return m.groupBy(*keys).agg((F.sum(F.when(F.abs("v") >= t, w).otherwise(0)) / F.sum(w)).alias("density"))


def average(models: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """Weighted mean of each cell over models, weights summing to 1."""
    return models.groupBy(*keys).agg((F.sum(F.col("v") * F.col(weight)) / F.sum(weight)).alias("v"))


def scaled_spectrum(traces: DataFrame) -> DataFrame:
    """Factor max trace / trace of each matrix."""
    return traces.withColumn("factor", F.max("trace").over(Window.partitionBy("family")) / F.col("trace"))


def shrink(s: np.ndarray, tol: float = 1e-2) -> tuple[np.ndarray, float]:
    """The least lam (bisection) for which lam * mean(diag) * I + (1 - lam) * s is positive definite."""

    def at(lam):
        return lam * np.trace(s) / len(s) * np.eye(len(s)) + (1 - lam) * s

    def ok(m):
        try:
            np.linalg.cholesky(m)
            return True
        except np.linalg.LinAlgError:
            return False

    if ok(s):
        return s, 0.0
    lo, hi = 0.0, 1.0
    while hi - lo > tol:
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(at(mid)) else (mid, hi)
    return at(hi), hi


def project(m: np.ndarray, dim: int, zero: float = 1e-3) -> np.ndarray:
    """m without small entries and negative eigenvalues, its ``dim`` largest kept."""
    m = np.where(np.abs(m) < zero, 0, m)
    d, q = np.linalg.eigh((m + m.T) / 2)
    keep = np.argsort(d)[-dim:]
    d = np.maximum(d[keep], 0)
    return (q[:, keep] * d) @ q[:, keep].T


def each_matrix(packed: DataFrame, fn, schema: str, keys: list[str]) -> DataFrame:
    """fn(matrix) -> list of row values, for rows (keys, theta packed); a matrix is a row, so nothing is shuffled."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            rows = [[*key, *fn(unpack(np.asarray(t, float)))] for *key, t in b[[*keys, "theta"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=names)

    return packed.mapInPandas(run, schema)

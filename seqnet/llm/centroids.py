"""Centroid clustering (Lloyd's rounds) with Elkan's bounds and exact results.

Vectors are whole numbers. Each row keeps its cluster, an upper bound of its distance to that cluster's centroid and a lower bound of its distance to every centroid. A round moves the bounds by what
the centroids have moved and skips each distance that bounds or distances between centroids show to be greater; the bounds are rounded outwards and only strict inequalities skip, so a tie is always computed.
What is computed is exact: squared distances are sums of whole numbers. Each round is a map over the rows, written to the shared folder; centroids are ``k`` rows of sums, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

DIM = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
#: Largest size of a component for which squared distances of DIM components fit into 63 bits.
LARGEST = 1 << 27


def up(x):
    return np.nextafter(x, np.inf)


def down(x):
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


def root_bounds(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the roots of whole numbers below 2^63: the conversion and the root are off by less than a unit in the last place each."""
    r = np.sqrt(squares.astype(np.float64))
    return down(down(r)), up(up(r))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("...i,...i->...", d, d)


def between(centroids: np.ndarray) -> np.ndarray:
    """Lower bounds of half the distances between centroids; 0 from each to itself."""
    low, _ = root_bounds(squared(centroids[:, None], centroids[None]))
    return low / 2  # exact


def assign(v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (ties: the smaller number) of the rows of v, their bounds, and the number of distances computed. The arrays may be changed."""
    best = np.full(len(v), -1, np.int64)  # exact squared distance to the row's centroid, where it is known
    computed = 0
    for j in range(len(centroids)):
        ask = np.flatnonzero((a != j) & ~(upper < lower[:, j]) & ~(upper < half[a, j]))
        new = ask[best[ask] < 0]
        if len(new):  # the upper bound is made exact, which often decides
            best[new] = squared(v[new], centroids[a[new]])
            low, upper[new] = root_bounds(best[new])
            lower[new, a[new]] = low
            computed += len(new)
            ask = ask[~(upper[ask] < lower[ask, j]) & ~(upper[ask] < half[a[ask], j])]
        if not len(ask):
            continue
        d = squared(v[ask], centroids[j])
        computed += len(ask)
        low, high = root_bounds(d)
        lower[ask, j] = low
        won = (d < best[ask]) | ((d == best[ask]) & (j < a[ask]))
        at = ask[won]
        a[at], best[at], upper[at] = j, d[won], high[won]
    return a, upper, lower, computed


def moved(a: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after the centroids have moved from old to new."""
    _, far = root_bounds(squared(old, new))
    far[(old == new).all(1)] = 0.0
    return np.where(far[a] > 0, up(upper + far[a]), upper), np.where(far > 0, down(lower - far), lower)


def whole_vectors(table: DataFrame, vector_col: str, dim: int, scale: int) -> DataFrame:
    """Rows whose vector has ``dim`` components, all finite, with v: floor(scale * x) of each."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = (F.size(F.col(vector_col)) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(good).withColumn("v", F.transform(x, lambda c: F.floor(c * scale)))


def _matrix(column: pa.Array, n: int, dim: int) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)


def _round(rows: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """rows (d, v and, but for the first round, a, upper, lower for the old centroids) with a, upper, lower for the new ones."""
    k, dim, kind = len(new), new.shape[1], rows.schema["d"].dataType.simpleString()
    first = old is None

    def each(batches):
        half = between(new)
        for b in batches:
            n = b.num_rows
            v = _matrix(b.column("v"), n, dim)
            if n and np.abs(v).max() >= LARGEST:
                raise ArithmeticError(f"a component of {LARGEST} or more: squared distances don't fit into 64 bits")
            if first:
                a, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k))
            else:
                a = b.column("a").to_numpy(zero_copy_only=False)
                upper, lower = moved(a, b.column("upper").to_numpy(zero_copy_only=False), _matrix(b.column("lower"), n, k), old, new)
                a = a.copy()
            a, upper, lower, _ = assign(v, a, upper, lower, new, half)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("v"), pa.array(a, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(lower.ravel()))], ["d", "v", "a", "upper", "lower"])

    return rows.mapInArrow(each, f"d {kind}, v array<bigint>, a int, upper double, lower array<double>")


def _sums(rows: DataFrame, k: int, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster: k rows; summed where the rows are first, in parts that can't overflow."""

    def each(batches):
        for b in batches:
            v, a = _matrix(b.column("v"), b.num_rows, dim), b.column("a").to_numpy(zero_copy_only=False)
            has = np.unique(a)
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array([int((a == j).sum()) for j in has], pa.int64()), pa.array([v[a == j].sum(0).tolist() for j in has], pa.list_(pa.int64()))], ["a", "n", "s"])

    parts = rows.select("a", "v").mapInArrow(each, "a int, n bigint, s array<bigint>")
    total = parts.groupBy("a").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(30,0)")) for i in range(dim)]).alias("s"))
    return {r["a"]: (r["n"], [int(x) for x in r["s"]]) for r in total.collect()}


def cluster_vectors(table: DataFrame, carry: list[str], seeds, k: int = CLUSTERS, rounds: int = ROUNDS, vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows of the table with a usable vector: ``d`` (the carried columns as a struct), cluster, distance (squared, exact); and the final centroids (whole numbers).

    The k rows that come first in the order of the column ``seeds``, then of their vectors, are the first centroids (fewer rows: as many centroids as rows). A null vector, one of another length and one with a null or non-finite
    component is left out. Ties go to the smaller number; an empty centroid stays. Repeated rows count each. Empty table: no rows, no centroids. Other columns, whatever their names, only come with ``carry``. Texts play no part.
    A component of 2^27 or more after scaling raises ArithmeticError, because distances would not fit into a long.
    """
    own = whole_vectors(table.select(F.struct(*carry).alias("d"), seeds.alias("seed"), F.col(vector_col).alias("x")), "x", dim, scale)
    rows = stage(own.select("d", "v", "seed"), "vectors")
    centroids = np.array([r["v"] for r in rows.select("seed", "v").orderBy("seed", "v").limit(k).collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        return rows.select("d", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    if np.abs(centroids).max() >= LARGEST:
        raise ArithmeticError(f"a component of {LARGEST} or more: squared distances don't fit into 64 bits")
    old, state = None, rows.drop("seed")
    for i in range(rounds + 1):
        last, state = state, stage(_round(state, old, centroids), f"round-{i}")
        if i:
            drop_stage(last)
        if i < rounds:
            old = centroids
            sums = _sums(state, len(centroids), dim)
            centroids = np.array([[s // sums[j][0] for s in sums[j][1]] if j in sums else c.tolist() for j, c in enumerate(old)], np.int64)

    def measure(batches):
        for b in batches:
            v, a = _matrix(b.column("v"), b.num_rows, dim), b.column("a").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("a"), pa.array(squared(v, centroids[a]), pa.int64())], ["d", "cluster", "distance"])

    return state.select("d", "v", "a").mapInArrow(measure, f"d {rows.schema['d'].dataType.simpleString()}, cluster int, distance bigint"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with cluster_inertia and inertia, the sums of distances, and the digest of the cluster's centroid; joined by one row for each cluster."""
    found = stage(found, "distances")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    spark = found.sparkSession
    text = spark.createDataFrame([(j, ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())], "cluster int, c string").select("cluster", F.sha2("c", 256).alias("centroid_sha256"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    small = sums.join(F.broadcast(text), "cluster").crossJoin(F.broadcast(total))
    return found.join(F.broadcast(small), "cluster")


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    seeds = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    out = with_inertia(*cluster_vectors(table, ["vec_id"], seeds))
    return out.select("d.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds as common table expressions, each of all distances."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
    parts = [
        "e as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "c0 as materialized (select (row_number() over (order by h, v) - 1)::int as j, v as c from (select v, sha256('3:' || coalesce(vec_id::varchar, 'null')) as h from e order by h, v limit 8))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} as materialized (select vec_id, v, (min(struct_pack(d := d, j := j))).j as j, min(d) as d from (select e.rowid as r, vec_id, v, j, {dist} as d from (select row_number() over () as rowid, * from e) e, c{r}) group by r, vec_id, v)")
        if r < ROUNDS:
            parts.append(f"u{r} as materialized (select j, list((s - ((s % n) + n) % n) // n order by i) as c from (select j, i, sum(v[i])::bigint as s, count(*)::bigint as n from a{r}, range(1, 65) q(i) group by j, i) group by j)")
            parts.append(f"c{r + 1} as materialized (select c{r}.j, coalesce(u{r}.c, c{r}.c) as c from c{r} left join u{r} using (j))")
    return f"with {', '.join(parts)} select vec_id, j as cluster, d as distance, (sum(d) over (partition by j))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{ROUNDS} join c{ROUNDS} using (j)"


SQL = _sql()

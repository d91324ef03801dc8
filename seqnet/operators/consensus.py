"""The time-varying graphical lasso over several tasks: clusters are the nodes of a family's chain, a row each, and exchange matrices with their neighbours by a join in each round of ADMM.

A node's row holds its covariance and its copies of the consensus variables: its own (z0, u0), as the earlier end of the edge to the next cluster (za, ua), and as the later end of the edge from the one before (zb, ub). A round sends x + u along each edge in both directions, so both ends
of an edge compute its proximal step, and each node then makes its next x. Residual norms are sums over a family's rows. The state is a table in the shared folder; a family that has converged leaves it. A task holds one node's matrices at a time, some 11 n^2 numbers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqnet.operators.glasso import GlassoConfig, density_of
from seqnet.operators.matrix import pack, unpack
from seqnet.operators.prox import edge, lasso, logdet
from seqnet.operators.tables import written

MATRICES = ("s", "x", "z0", "u0", "za", "ua", "zb", "ub")
NORMS = ("r2", "dual2", "ax2", "z2", "u2")
NODE = "family string, cluster_idx int, before int, after int, k int, n int, w double, lam double, beta_before double, beta_after double"
STATE = f"{NODE}, {', '.join(f'{m} array<double>' for m in MATRICES)}, {', '.join(f'{m} double' for m in NORMS)}"


def _lists(columns: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if c is None else c.ravel() for c in columns], pa.list_(pa.float64()))


def _next_x(s, copies, rho, w):
    return logdet(s, sum(copies) / len(copies), len(copies) * rho / w)


def _begin(cov: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: GlassoConfig) -> DataFrame:
    """The state before the first round: nodes with their neighbours, weights, coefficients and x of the first iteration."""
    chain = Window.partitionBy("family").orderBy("cluster_idx")  # a row for each cluster
    total = cov.groupBy("family").agg(F.sum("wt").alias("sum"), F.min("wt").alias("least"), F.count("*").cast("int").alias("k"))
    keys = cov.select("family", "cluster_idx", F.lag("cluster_idx").over(chain).alias("before"), F.lead("cluster_idx").over(chain).alias("after"))
    coef = edges.where("kind = 'temporal'").select("family", "src", "dst", "coef")
    keys = keys.join(coef.select("family", F.col("src").alias("before"), F.col("dst").alias("cluster_idx"), F.col("coef").alias("beta_before")), ["family", "before", "cluster_idx"], "left")
    keys = keys.join(coef.select("family", F.col("dst").alias("after"), F.col("src").alias("cluster_idx"), F.col("coef").alias("beta_after")), ["family", "after", "cluster_idx"], "left")
    keys = keys.join(nodes.select("family", F.col("node").alias("cluster_idx"), "lam"), ["family", "cluster_idx"], "left")
    rows = cov.join(keys, ["family", "cluster_idx"]).join(total, "family")
    w = (F.col("wt") / F.col("sum")) / (F.col("least") / F.col("sum"))
    fill = [F.coalesce("lam", F.lit(float(cfg.lam))).alias("lam"), *[F.coalesce(c, F.lit(float(cfg.beta))).alias(c) for c in ("beta_before", "beta_after")]]
    rows = rows.select("family", "cluster_idx", "before", "after", "k", w.alias("w"), *fill, "theta")

    def each(batches):
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("before", "after", "w")}
            s = [unpack(np.asarray(v.values)) for v in b.column("theta")]
            zero = [np.zeros_like(m) for m in s]
            x = [_next_x(m, [o] * (1 + (p is not None) + (q is not None)), cfg.rho, w) for m, o, p, q, w in zip(s, zero, cols["before"], cols["after"], cols["w"])]
            a = [o if q is not None else None for o, q in zip(zero, cols["after"])]
            z = [o if p is not None else None for o, p in zip(zero, cols["before"])]
            own = [b.column(c) for c in ("family", "cluster_idx", "before", "after", "k")] + [pa.array([len(m) for m in s], pa.int32())] + [b.column(c) for c in ("w", "lam", "beta_before", "beta_after")]
            yield pa.RecordBatch.from_arrays(own + [_lists(m) for m in (s, x, zero, zero, a, a, z, z)] + [pa.nulls(len(s), pa.float64())] * len(NORMS), _NAMES)

    return rows.mapInArrow(each, STATE)


_NAMES = [p.split()[0] for p in STATE.split(", ")]


def _messages(state: DataFrame) -> DataFrame:
    """x + u along each edge: from (the sender), to its neighbour. The join of nodes with their edges and of edges with their other nodes in one."""
    plus = lambda u: F.zip_with("x", u, lambda a, b: a + b)
    on = state.where("after is not null").select("family", F.col("after").alias("cluster_idx"), F.lit("before").alias("side"), plus("ua").alias("m"))
    back = state.where("before is not null").select("family", F.col("before").alias("cluster_idx"), F.lit("after").alias("side"), plus("ub").alias("m"))
    return on.unionByName(back)


def _round(cfg: GlassoConfig):
    """For cogroups of a node's row and its neighbours' messages: the row after a round, with its parts of the residual norms and the next x."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        n = row["n"]
        m = {c: None if row[c] is None else np.array(row[c]).reshape(n, n) for c in MATRICES}
        sent = {side: np.array(v).reshape(n, n) for side, v in zip(right.column("side").to_pylist(), right.column("m").to_pylist())}
        x, new = m["x"], {"z0": lasso(m["x"] + m["u0"], row["lam"] / cfg.rho)}
        if row["after"] is not None:
            new["za"] = edge(x + m["ua"], sent["after"], row["beta_after"] / cfg.rho, cfg.penalty)[0]
        if row["before"] is not None:
            new["zb"] = edge(sent["before"], x + m["ub"], row["beta_before"] / cfg.rho, cfg.penalty)[1]
        norms = dict.fromkeys(NORMS, 0.0)
        copies = {}
        for z, value in new.items():
            u = m["u" + z[1:]] + x - value
            norms["r2"] += float(((x - value) ** 2).sum())
            norms["dual2"] += float(((value - m[z]) ** 2).sum())
            norms["ax2"] += float((x**2).sum())
            norms["z2"] += float((value**2).sum())
            norms["u2"] += float((u**2).sum())
            m[z], m["u" + z[1:]], copies[z] = value, u, value - u
        # in the order of the solver's sums: own, later end, earlier end
        m["x"] = _next_x(m["s"], [copies[z] for z in ("z0", "zb", "za") if z in copies], cfg.rho, row["w"])
        keep = [left.column(c).slice(0, 1) for c in _NAMES[:10]]
        return pa.table(keep + [_lists([m[c]]) for c in MATRICES] + [pa.array([norms[c]], pa.float64()) for c in NORMS], names=_NAMES)

    return each


def fit_over_tasks(cov: DataFrame, cfg: GlassoConfig, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """cov (family, cluster_idx, wt, theta: packed covariance) -> fits, as glasso.fit_time_varying_glasso makes them without a search, by rounds over all families at once.

    nodes (family, node, lam) and edges (family, src, dst, kind, coef), such as chain_problem makes, give coefficients by node and temporal edge; where they are missing, those of cfg hold. A cluster is named once in a family. An empty table gives no fits.
    """
    spark = cov.sparkSession
    if nodes is None:
        nodes = spark.createDataFrame([], "family string, node int, lam double")
    if edges is None:
        edges = spark.createDataFrame([], "family string, src int, dst int, kind string, coef double")
    cov = cov.select(F.col("family").cast("string").alias("family"), F.col("cluster_idx").cast("int").alias("cluster_idx"), F.col("wt").cast("double").alias("wt"), "theta")
    state, done = written(_begin(written(cov, "covariances"), nodes, edges, cfg), "begin"), []
    for it in range(1, cfg.max_iters + 1):
        state = written(state.groupBy("family", "cluster_idx").cogroup(_messages(state).groupBy("family", "cluster_idx")).applyInArrow(_round(cfg), STATE), f"round-{it}")
        size = F.sqrt((F.max("k") + 2 * (F.max("k") - 1)) * F.max("n") * (F.max("n") + 1) / 2) * cfg.eps_abs + 1e-4
        primal = F.sqrt(F.sum("r2")) <= size + cfg.eps_rel * F.greatest(F.sqrt(F.sum("ax2")), F.sqrt(F.sum("z2")))
        dual = cfg.rho * F.sqrt(F.sum("dual2")) <= size + cfg.eps_rel * cfg.rho * F.sqrt(F.sum("u2"))
        met = state.groupBy("family").agg((primal & dual).alias("converged"))
        if it == cfg.max_iters:
            done.append(state.join(met, "family").withColumn("iterations", F.lit(it)))
            break
        met = written(met, f"met-{it}")
        counts = met.agg(F.count_if("converged").alias("yes"), F.count_if(~F.col("converged")).alias("no")).first()
        if counts["yes"]:
            done.append(state.join(met.where("converged"), "family").withColumn("iterations", F.lit(it)))
        if not counts["no"]:
            break
        if counts["yes"]:
            state = written(state.join(met.where("not converged").select("family"), "family", "left_semi"), f"left-{it}")
    out = reduce(DataFrame.unionByName, [d.select("family", "cluster_idx", "lam", "n", "converged", "iterations", "z0") for d in done])

    def shown(batches):
        for b in batches:
            z = [np.asarray(v.values).reshape(n, n) for v, n in zip(b.column("z0"), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("family"), b.column("cluster_idx"), b.column("lam"), pa.array([density_of(m, cfg.zero, cfg.offset or 1) for m in z], pa.float64()), b.column("converged"), b.column("iterations"), b.column("n"), _lists([pack(m) for m in z])], ["family", "cluster_idx", "lam", "density", "converged", "iterations", "n", "theta"])

    return out.mapInArrow(shown, "family string, cluster_idx int, lam double, density double, converged boolean, iterations int, n int, theta array<double>")

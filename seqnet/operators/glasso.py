"""Time-varying graphical lasso: K sparse precision matrices along a chain, fitted by ADMM; one family's problem is one task."""

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seqnet.operators.matrix import pack, unpack
from seqnet.operators.prox import edge, lasso, logdet


@dataclass
class GlassoConfig:
    lam: float = 0.005
    beta: float = 0.0025
    penalty: str = "l1"
    max_iters: int = 150
    final_iters: int = 120
    rho: float = 1.0
    eps_abs: float = 1e-3
    eps_rel: float = 1e-3
    target_density: float = 0.03
    density_tol: float = 1.5e-3
    trials: int = 10
    zero: float = 1e-3
    beta_ratio: float = 0.0
    seed: int = 0
    offset: int | None = None  # the off-diagonal from which densities count; where there is none, 1, and in fit_families 63: letters at positions 3 apart or more
    target_shift: float = 0.0
    selected: tuple[int, ...] | None = None  # models whose densities must meet the target; all where there are none
    single: bool = False  # one lambda for all models


def expand(v, n: int) -> list[float]:
    """A scalar as n values; a list must have n."""
    if np.isscalar(v):
        return [float(v)] * n
    if len(v) != n:
        raise ValueError(f"{len(v)} values, {n} needed")
    return [float(x) for x in v]


def solve(s: list[np.ndarray], lam, beta, penalty="l1", weights=None, max_iters=200, rho=1.0, eps_abs=1e-3, eps_rel=1e-3, state=None) -> dict:
    """Minimises sum w_i (-logdet X_i + tr S_i X_i) + lam_i |X_i|_1,off + beta_i psi(X_i - X_{i-1}). K = 1 is the plain graphical lasso. ``state`` starts from an earlier fit."""
    k, n = len(s), len(s[0])
    lam, beta, w = expand(lam, k), expand(beta, k - 1) if k > 1 else [], [1.0] * k if weights is None else list(weights)
    shape = lambda m: np.zeros((m, n, n))
    x, z0, u0, za, zb, ua, ub = state if state is not None else (shape(k), shape(k), shape(k), shape(k - 1), shape(k - 1), shape(k - 1), shape(k - 1))
    size = (k + 2 * (k - 1)) * n * (n + 1) / 2
    converged, it = False, 0
    for it in range(1, max_iters + 1):
        for i in range(k):  # copies of X_i: its own, as the later end of edge i-1, as the earlier end of edge i
            near = [z0[i] - u0[i]] + ([zb[i - 1] - ub[i - 1]] if i else []) + ([za[i] - ua[i]] if i < k - 1 else [])
            x[i] = logdet(s[i], sum(near) / len(near), len(near) * rho / w[i])
        old = (z0.copy(), za.copy(), zb.copy())
        for i in range(k):
            z0[i] = lasso(x[i] + u0[i], lam[i] / rho)
        for i in range(k - 1):
            za[i], zb[i] = edge(x[i] + ua[i], x[i + 1] + ub[i], beta[i] / rho, penalty)
        u0 += x - z0
        ua += x[:-1] - za
        ub += x[1:] - zb
        ax, z = np.concatenate([x, x[:-1], x[1:]]), np.concatenate([z0, za, zb])
        r, dual = np.linalg.norm(ax - z), rho * np.linalg.norm(z - np.concatenate(old))
        e_pri = np.sqrt(size) * eps_abs + eps_rel * max(np.linalg.norm(ax), np.linalg.norm(z)) + 1e-4
        e_dual = np.sqrt(size) * eps_abs + eps_rel * rho * np.linalg.norm(np.concatenate([u0, ua, ub])) + 1e-4
        if r <= e_pri and dual <= e_dual:
            converged = True
            break
    return {"theta": [m.copy() for m in z0], "x": [m.copy() for m in x], "converged": converged, "iterations": it, "primal": float(r) if max_iters else 0.0, "dual": float(dual) if max_iters else 0.0, "state": (x, z0, u0, za, zb, ua, ub)}


def objective(x, s, lam, beta, penalty, weights=None) -> float:
    k = len(x)
    lam, beta, w = expand(lam, k), expand(beta, k - 1) if k > 1 else [], [1.0] * k if weights is None else weights
    psi = {"l1": lambda d: np.abs(d).sum(), "laplacian": lambda d: (d * d).sum(), "l2": lambda d: np.linalg.norm(d, axis=0).sum(), "linf": lambda d: np.abs(d).max(axis=0).sum()}[penalty]
    fit = sum(w[i] * (np.trace(s[i] @ x[i]) - np.linalg.slogdet(x[i])[1]) + lam[i] * (np.abs(x[i]).sum() - np.abs(np.diag(x[i])).sum()) for i in range(k))
    return fit + sum(beta[i] * psi(x[i + 1] - x[i]) for i in range(k - 1))


def density_of(m: np.ndarray, zero: float = 1e-3, offset: int = 1) -> float:
    return float((np.abs(m[np.triu_indices(len(m), offset)]) >= zero).mean()) if len(m) > offset else 0.0


#: Bounds of the kernel's scale, its constant's root and its noise.
BOUNDS = ((1e-9, 1e9), (1e-7, 1e7), (1e-9, 1e9))


def evidence(logs: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """Log marginal likelihood, summed over the columns of y, of Gaussian processes with the kernel scale * (root^2 + x x') + noise on equal points."""
    scale, root, noise = np.exp(logs)
    k = scale * (root**2 + x @ x.T) + (noise + 1e-10) * np.eye(len(x))
    try:
        low = np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        return -np.inf
    z = np.linalg.solve(low, y)
    return float(-0.5 * (z * z).sum() - y.shape[1] * (np.log(np.diag(low)).sum() + 0.5 * len(x) * np.log(2 * np.pi)))


def fitted_kernel(x: np.ndarray, y: np.ndarray, rng, starts: int = 5, rounds: int = 250) -> np.ndarray:
    """Logs of the kernel's scale, root and noise of the largest evidence: simplex searches from ones and from ``starts`` random places within the bounds."""
    lo, hi = np.log(np.array(BOUNDS)).T
    value = lambda p: -evidence(np.clip(p, lo, hi), x, y)
    best = None
    for start in [np.zeros(3), *rng.uniform(lo, hi, (starts, 3))]:
        points = np.clip(np.array([start, *(start + np.eye(3) * np.where(start > 0, -2.0, 2.0))]), lo, hi)
        f = np.array([value(p) for p in points])
        for _ in range(rounds):
            by = np.argsort(f)
            points, f = points[by], f[by]
            if np.isfinite(f).all() and f[-1] - f[0] < 1e-9 and np.abs(points - points[0]).max() < 1e-5:
                break
            mid = points[:-1].mean(0)
            try_at = lambda t: np.clip(mid + t * (points[-1] - mid), lo, hi)
            p = try_at(-1.0)
            v = value(p)
            if v < f[0]:
                q = try_at(-2.0)
                w = value(q)
                points[-1], f[-1] = (q, w) if w < v else (p, v)
            elif v < f[-2]:
                points[-1], f[-1] = p, v
            else:
                q = try_at(-0.5 if v < f[-1] else 0.5)
                w = value(q)
                if w < min(v, f[-1]):
                    points[-1], f[-1] = q, w
                else:
                    points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                    f[1:] = [value(p) for p in points[1:]]
        i = int(np.argmin(f))
        if best is None or f[i] < best[0]:
            best = (f[i], np.clip(points[i], lo, hi))
    if not np.isfinite(best[0]):
        raise np.linalg.LinAlgError("no kernel fits")
    return best[1]


def inverse_lambda(dens, lams, target: float, rng) -> np.ndarray:
    """The lambdas (1e-7 to 10) that a Gaussian process on densities, its kernel fitted to the trials (rows; a column for each model), expects where all models have the target density. Both sides are scaled by their means."""
    x, y = np.atleast_2d(np.array(dens, float)), np.atleast_2d(np.array(lams, float))
    mx, my = x.mean(), y.mean()
    if mx <= 0 or my <= 0:
        raise np.linalg.LinAlgError("nothing to scale by")
    x, y = x / mx, y / my
    scale, root, noise = np.exp(fitted_kernel(x, y, rng))
    k = scale * (root**2 + x @ x.T) + (noise + 1e-10) * np.eye(len(x))
    at = np.full(x.shape[1], target / mx)
    return np.clip(scale * (root**2 + at @ x.T) @ np.linalg.solve(k, y) * my, 1e-7, 10)


def search(s: list[np.ndarray], cfg: GlassoConfig, weights=None) -> dict:
    """Searches each model's lambda for the target density (shifted by target_shift): random steps first and on even trials, the fitted inverse over all models on odd ones (a random step of up to 15 % where it can't be fitted); best lambda solved again at the end. Trials start from the last fit."""
    rng, k = np.random.default_rng(cfg.seed), len(s)
    lam, seen, best, state = expand(cfg.lam, k), [], None, None
    target, chosen = cfg.target_density + cfg.target_shift, [i for i in cfg.selected or range(k) if i < k]
    for trial in range(cfg.trials):
        beta = [lam[0] * cfg.beta_ratio] * (k - 1) if cfg.beta_ratio > 0 else expand(cfg.beta, k - 1) if k > 1 else []
        fit = solve(s, lam, beta, cfg.penalty, weights, cfg.max_iters, cfg.rho, cfg.eps_abs, cfg.eps_rel, state)
        state = fit["state"]
        dens = [density_of(t, cfg.zero, cfg.offset or 1) for t in fit["theta"]]
        seen.append((dens, list(lam)))
        gap = max(abs(dens[i] - target) for i in chosen)
        if best is None or gap < best[0]:
            best = (gap, list(lam), list(beta))
        if gap <= cfg.density_tol:
            break
        if trial >= 2 and trial % 2:
            own = [0] if cfg.single else range(k)
            try:
                lam = (inverse_lambda([[d[i] for i in own] for d, _ in seen], [[v[i] for i in own] for _, v in seen], target, rng) * np.ones(k)).tolist()
            except np.linalg.LinAlgError:
                lam = np.clip(np.array(lam) * rng.uniform(0.85, 1.15, k), 1e-7, 10).tolist()
        else:
            for i in range(k):
                err = (dens[i] - target) / target
                step = rng.uniform(1, 1 + min(4, abs(err)))
                lam[i] = float(np.clip(lam[i] * step if err > 0 else lam[i] / step, 1e-7, 10))
        if cfg.single:
            lam = [float(np.exp(np.mean(np.log(lam))))] * k
    out = solve(s, best[1], best[2], cfg.penalty, weights, cfg.final_iters, cfg.rho, cfg.eps_abs, cfg.eps_rel)
    return out | {"lam": best[1], "beta": best[2], "density": [density_of(t, cfg.zero, cfg.offset or 1) for t in out["theta"]], "trials": len(seen)}


FIT = "family string, cluster_idx int, lam double, density double, converged boolean, iterations int, n int, theta array<double>"


def fit_time_varying_glasso(cov: DataFrame, cfg: GlassoConfig, searching: bool = False) -> DataFrame:
    """cov (family, cluster_idx, wt, theta: packed covariance) -> fits. A family's K matrices meet in one task; families are spread over the cluster."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster_idx")
        s = [unpack(np.asarray(v, float)) for v in pdf["theta"]]
        w = pdf["wt"].to_numpy(float)
        w = w / w.sum()
        w = list(w / w.min())
        got = search(s, cfg, w) if searching else solve(s, cfg.lam, cfg.beta, cfg.penalty, w, cfg.max_iters, cfg.rho, cfg.eps_abs, cfg.eps_rel)
        lam = got.get("lam", expand(cfg.lam, len(s)))
        return pd.DataFrame({"family": pdf["family"].astype(str), "cluster_idx": pdf["cluster_idx"].astype("int32"), "lam": lam, "density": [density_of(t, cfg.zero, cfg.offset or 1) for t in got["theta"]], "converged": got["converged"], "iterations": np.int32(got["iterations"]), "n": np.int32(len(s[0])), "theta": [pack(t) for t in got["theta"]]})

    return cov.groupBy("family").applyInPandas(fit, FIT)


def packed(blocks: DataFrame, keys: list[str], q: int = 21) -> DataFrame:
    """keys, theta: the packed upper triangle of each full covariance from its blocks (keys, i, j, cov: q x q numbers, row by row; i <= j from 1), which one task for each matrix lays out."""

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["j"].max())
        m = np.zeros((n, q, n, q))
        for i, j, c in zip(pdf["i"], pdf["j"], pdf["cov"]):
            m[i - 1, :, j - 1] = np.asarray(c).reshape(q, q)
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"theta": [pack(m.reshape(n * q, n * q))]})

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return blocks.groupBy(*keys).applyInPandas(lay, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", theta array<double>")


def fit_families(msa: DataFrame, clusters: DataFrame, cfg: GlassoConfig, searching: bool = True, share: float = 0.62) -> DataFrame:
    """Alignment to fits: msa (family, seq_id, seq; equally long in a family) and ordered clusters (family, cluster_idx, seq_id) give sequence weights, full covariances of all 21 letters at all positions, one for each cluster, and the family's joint fit.

    Weights are those of the whole family, by sequence. lambda and beta are sized by the clusters that there are. Results go to Parquet by family with write_fits."""
    from seqnet.functions.residues import normalize
    from seqnet.operators.msa import covariance_blocks, weights

    cfg = cfg if cfg.offset else replace(cfg, offset=63)
    wts = weights(msa, share)
    own = msa.withColumn("seq", normalize(msa["seq"])).join(clusters, ["family", "seq_id"]).join(wts, ["family", "seq_id"])
    own = own.selectExpr("concat(cluster_idx, ':', family) as family", "seq_id", "seq", "wt")
    cov = packed(covariance_blocks(own.select("family", "seq_id", "seq"), own.select("family", "seq_id", "wt")), ["family"])
    total = own.groupBy("family").agg({"wt": "sum"}).withColumnRenamed("sum(wt)", "wt")
    both = cov.join(total, "family").selectExpr("substring(family, instr(family, ':') + 1) as family", "cast(substring_index(family, ':', 1) as int) as cluster_idx", "wt", "theta")
    return fit_time_varying_glasso(both, cfg, searching)


def write_fits(fits: DataFrame, path: str, cfg: GlassoConfig) -> None:
    """Fits with the settings they were made with, a folder for each family; earlier fits of the same families are replaced."""
    from dataclasses import asdict

    from pyspark.sql import functions as F

    args = F.create_map(*[F.lit(str(x)) for kv in asdict(cfg).items() for x in kv])
    fits.withColumn("args", args).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("family").parquet(path)


def chain_problem(clusters: DataFrame, lam: float, beta: float, loads: DataFrame | None = None, edge_loads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (family, node, lam) and edges (family, src, dst, kind, coef) of the fit's graph: temporal edges between consecutive clusters, a lasso edge for each node. loads (family, node, lam) and edge_loads (family, src, dst, coef), such as read from CSV, override lam and beta."""
    from pyspark.sql import functions as F

    from seqnet.operators.cluster import chain_edges

    nodes = clusters.select("family", F.col("cluster_idx").alias("node")).distinct()
    nodes = nodes.withColumn("lam", F.lit(lam)) if loads is None else nodes.join(loads, ["family", "node"], "left").withColumn("lam", F.coalesce("lam", F.lit(lam)))
    chain = chain_edges(clusters).select("family", "src", "dst", F.lit("temporal").alias("kind"))
    chain = chain.withColumn("coef", F.lit(beta)) if edge_loads is None else chain.join(edge_loads.select("family", "src", "dst", "coef"), ["family", "src", "dst"], "left").select("family", "src", "dst", "kind", F.coalesce("coef", F.lit(beta)).alias("coef"))
    return nodes, chain.unionByName(nodes.select("family", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit("lasso").alias("kind"), F.col("lam").alias("coef")))

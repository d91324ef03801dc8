"""Fits by rounds over tasks equal the solver's in one task."""

import numpy as np
import pytest

from seqnet.operators import consensus, glasso, matrix


def covariances(spark, sizes, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for family, k in sizes.items():
        for c in range(k):
            x = rng.normal(size=(30, n)) @ (np.eye(n) + 0.3 * rng.normal(size=(n, n)))
            rows.append((family, 2 * c, float(rng.integers(20, 60)), matrix.pack(np.cov(x.T)).tolist()))
    return spark.createDataFrame(rows, "family string, cluster_idx int, wt double, theta array<double>"), rows


def solved(rows, family, cfg, lam=None, beta=None):
    own = sorted(r for r in rows if r[0] == family)
    w = np.array([r[2] for r in own])
    w = w / w.sum()
    return glasso.solve([matrix.unpack(np.array(r[3])) for r in own], lam or cfg.lam, beta or cfg.beta, cfg.penalty, list(w / w.min()), cfg.max_iters, cfg.rho, cfg.eps_abs, cfg.eps_rel)


@pytest.mark.parametrize("penalty", ["l1", "l2", "laplacian", "linf", "perturbation"])
def test_rounds_equal_the_solver(spark, penalty):
    cov, rows = covariances(spark, {"five": 5, "one": 1, "two": 2}, 6)
    cfg = glasso.GlassoConfig(lam=0.05, beta=0.04, penalty=penalty, max_iters=20 if penalty == "l1" else 5, rho=1.3)
    got = {(r.family, r.cluster_idx): r for r in consensus.fit_over_tasks(cov, cfg).collect()}
    assert len(got) == 8
    for family, k in (("five", 5), ("one", 1), ("two", 2)):
        want = solved(rows, family, cfg)
        for c in range(k):
            r = got[family, 2 * c]
            assert np.abs(np.array(r.theta) - matrix.pack(want["theta"][c])).max() < 1e-8
            assert (r.converged, r.iterations) == (want["converged"], want["iterations"])


def test_families_leave_when_they_converge(spark):
    cov, rows = covariances(spark, {"a": 3, "b": 1, "c": 5}, 4, 2)
    cfg = glasso.GlassoConfig(lam=0.1, beta=0.05, max_iters=80, eps_abs=1e-2, eps_rel=1e-2)
    got = {(r.family, r.cluster_idx): r for r in consensus.fit_over_tasks(cov, cfg).collect()}
    wants = {f: solved(rows, f, cfg) for f in "abc"}
    assert all(w["converged"] for w in wants.values()) and len({w["iterations"] for w in wants.values()}) > 1
    for (family, c), r in got.items():
        assert r.converged and r.iterations == wants[family]["iterations"]
        assert np.abs(np.array(r.theta) - matrix.pack(wants[family]["theta"][c // 2])).max() < 1e-8
    assert consensus.fit_over_tasks(cov.limit(0), glasso.GlassoConfig(max_iters=1)).count() == 0


def test_coefficients_by_node_and_edge(spark):
    cov, rows = covariances(spark, {"f": 3}, 4, 5)
    loads = spark.createDataFrame([("f", 2, 0.2)], "family string, node int, lam double")
    edge_loads = spark.createDataFrame([("f", 0, 2, 0.3)], "family string, src int, dst int, coef double")
    clusters = spark.createDataFrame([("f", c, 0) for c in (0, 2, 4)], "family string, cluster_idx int, seq_id int")
    nodes, edges = glasso.chain_problem(clusters, 0.05, 0.02, loads, None)
    assert {(r.node, r.lam) for r in nodes.collect()} == {(0, 0.05), (2, 0.2), (4, 0.05)}
    own = spark.createDataFrame([("f", 0, 2, "temporal", 0.3), ("f", 2, 4, "temporal", 0.02)], edges.schema)
    cfg = glasso.GlassoConfig(lam=0.05, beta=0.02, max_iters=10)
    got = consensus.fit_over_tasks(cov, cfg, nodes, own).orderBy("cluster_idx").collect()
    want = solved(rows, "f", cfg, [0.05, 0.2, 0.05], [0.3, 0.02])
    assert all(np.abs(np.array(r.theta) - matrix.pack(t)).max() < 1e-8 for r, t in zip(got, want["theta"]))
    dense = spark.createDataFrame([("f", c, 0) for c in range(3)], "family string, cluster_idx int, seq_id int")
    coefs = {(r.src, r.dst): r.coef for r in glasso.chain_problem(dense, 0.05, 0.02, None, spark.createDataFrame([("f", 0, 1, 0.3)], edge_loads.schema))[1].where("kind = 'temporal'").collect()}
    assert coefs == {(0, 1): 0.3, (1, 2): 0.02}

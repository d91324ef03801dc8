"""Quantiles over ranges, places, and the kernel of the density search's inverse."""

import numpy as np
from pyspark.sql import functions as F

from seqnet.operators import glasso, reports


def test_quantiles_of_any_group(spark):
    rng = np.random.default_rng(2)
    rows = [("big", None, float(v)) for v in np.exp(rng.normal(0, 6, 5000))] + [("ties", 1, float(v)) for v in rng.integers(0, 3, 4000)] + [("one", 2, 7.5), ("two", 2, 1.0), ("two", 2, 2.0), ("none", 3, None), (None, None, 4.0), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b int, x double").repartition(4)
    got = {(r.a, r.b): r for r in reports.quantiles_avg(df, ["a", "b"], "x", (0.25, 0.5, 0.75, 1.0, 0.0)).collect()}
    assert set(got) == {("big", None), ("ties", 1), ("one", 2), ("two", 2), ("none", 3), (None, None)}
    for key, r in got.items():
        own = [v for a, b, v in rows if (a, b) == key and v is not None]
        for q in (0, 25, 50, 75, 100):
            assert r[f"q{q}"] is None if not own else np.isclose(r[f"q{q}"], np.quantile(own, q / 100), rtol=1e-12)
        assert r["mean"] is None if not own else np.isclose(r["mean"], np.mean(own))
    assert reports.quantiles_avg(df.limit(0), ["a", "b"], "x").count() == 0


def test_groups_are_spread(spark):
    """A group of most rows is in many ranges, none of which is larger than its share."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("k"), (F.col("id") * 7919 % 20_011).alias("x"))
        placed = reports.placed(df, ["k"], ["x"])
        ranges = df.repartitionByRange("k", "x").groupBy(F.spark_partition_id()).count().collect()
        assert len(ranges) == 4 and max(r["count"] for r in ranges) < 0.4 * 20_000
        got = placed.collect()
        for k in ("small", "hot"):
            own = sorted((r.x, r.place) for r in got if r.k == k)
            assert [p for _, p in own] == list(range(len(own)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_bins_of_skewed_values(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.exp(rng.normal(0, 8, 997)), [1e300]])
    df = spark.createDataFrame([("a", float(v), i, float(i)) for i, v in enumerate(x)], "k string, x double, tie int, y double")
    got = sorted(tuple(r) for r in reports.equal_count_bins(df, "x", "y", "tie", 7, ["k"]).select("bin", "mean", "lo", "hi").collect())
    order = np.argsort(x, kind="stable")
    parts = np.array_split(order, 7)
    assert all(b == i + 1 and np.isclose(m, p.mean()) and lo == x[p[0]] and hi == x[p[-1]] for (b, m, lo, hi), (i, p) in zip(got, enumerate(parts)))


def test_kernel_of_the_largest_evidence():
    rng = np.random.default_rng(1)
    for case in range(4):
        x = rng.uniform(0.3, 2, (9, 3))
        y = x @ rng.normal(0, 1, (3, 2)) + 1.5 + 0.2 * rng.normal(size=(9, 2))
        found = glasso.evidence(glasso.fitted_kernel(x, y, np.random.default_rng(case)), x, y)
        grid = max(glasso.evidence(np.array([a, b, c]), x, y) for a in np.arange(-8, 8, 0.8) for b in np.arange(-8, 8, 0.8) for c in np.arange(-8, 3, 0.5))
        assert found >= grid - 1e-6
    # by the definition of the likelihood
    p, k = np.array([0.3, -0.2, -1.0]), None
    k = np.exp(0.3) * (np.exp(-0.4) + x @ x.T) + (np.exp(-1.0) + 1e-10) * np.eye(9)
    want = sum(-0.5 * v @ np.linalg.solve(k, v) - 0.5 * np.linalg.slogdet(k)[1] - 4.5 * np.log(2 * np.pi) for v in y.T)
    assert np.isclose(glasso.evidence(p, x, y), want)


def test_inverse_finds_a_linear_law():
    """Where lambda falls linearly with density, the inverse is read off; the trials of a search come near the target."""
    rng = np.random.default_rng(3)
    dens = rng.uniform(0.02, 0.05, (9, 4))
    lams = 0.006 - 0.08 * dens + 1e-6 * rng.normal(size=dens.shape)
    got = glasso.inverse_lambda(dens, lams, 0.03, np.random.default_rng(0))
    assert np.allclose(got, 0.006 - 0.08 * 0.03, rtol=0.02)
    assert glasso.inverse_lambda([[0.5], [0.6]], [[50.0], [60.0]], 0.03, rng).shape == (1,) and (glasso.inverse_lambda([[0.5], [0.6]], [[50.0], [60.0]], 0.03, rng) <= 10).all()


#: A recorded search for the density 0.03, its lambdas and densities by trial (columns are models), and the lambdas that it went on with.
LAMS = [[0.002, 0.002, 0.002, 0.002], [0.004, 0.004, 0.004, 0.004], [0.002, 0.002, 0.002, 0.002], [1e-05, 0.00708, 0.00249, 0.00571], [0.005782, 0.005516, 0.00073, 0.003437], [0.003759, 0.004423, 0.003913, 0.003456], [0.003767, 0.00412, 0.003697, 0.003893], [0.003681, 0.004118, 0.003622, 0.003889]]
DENS = [[0.04598, 0.07084, 0.06059, 0.07061], [0.01562, 0.02919, 0.02308, 0.02721], [0.04598, 0.07084, 0.06059, 0.07061], [0.31753, 0.01328, 0.04289, 0.01529], [0.00826, 0.01856, 0.12734, 0.03628], [0.01711, 0.02544, 0.0239, 0.03383], [0.01716, 0.02817, 0.02593, 0.02845], [0.0161, 0.02606, 0.02472, 0.02645]]
NEXT = [0.003597, 0.004086, 0.003547, 0.003861]


def test_inverse_of_a_recorded_search():
    got = glasso.inverse_lambda(DENS, LAMS, 0.03, np.random.default_rng(0))
    assert np.abs(got / NEXT - 1).max() < 0.02

"""A replayed stream of moments, merged on arrival, gives the batch's covariances and fits."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from seqnet.operators import glasso
from seqnet.operators.matrix import unpack
from seqnet.streaming import moments

COLS = ["x", "y", "z"]


def rows(rng, n):
    start = dt.datetime(2024, 3, 1)
    out = []
    for k in range(n):
        x = rng.gauss(0, 1)
        out.append((start + dt.timedelta(minutes=13 * k), rng.choice("ab"), x, x * 0.5 + rng.gauss(0, 1), rng.gauss(5, 2), "clash"))
    return out


SCHEMA = "ts timestamp, kind string, x double, y double, z double, family string"
BAD = [(dt.datetime(2024, 3, 1), "a", None, 1.0, 1.0, ""), (dt.datetime(2024, 3, 1), "a", float("nan"), 1.0, 1.0, ""), (dt.datetime(2024, 3, 1), "b", float("inf"), 1.0, 1.0, ""), (None, "b", 1.0, 1.0, 1.0, "")]


def test_covariances_by_numpy(spark):
    data = rows(random.Random(1), 500)
    df = spark.createDataFrame(data + BAD + [(dt.datetime(2024, 3, 1), None, 1.0, 2.0, 3.0, "n")], SCHEMA).repartition(3)
    m = moments.window_moments(df, COLS, "1 day", family="kind")
    assert m.where("family is null").count() == 1
    got = {(r.family, r.start): unpack(np.array(r.theta)) for r in moments.window_covariances(m).collect()}
    want = {}
    for t, kind, *v, _ in data:
        want.setdefault((kind, t.replace(hour=0, minute=0)), []).append(v)
    want = {k: np.cov(np.array(v).T) for k, v in want.items() if len(v) > 1}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert moments.window_covariances(moments.window_moments(df.where("false"), COLS, "1 day")).count() == 0


def test_replayed_stream(spark, tmp_path):
    data = rows(random.Random(2), 600)
    for k in range(6):
        part = spark.createDataFrame(data[k * 100 : (k + 1) * 100] + BAD, SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    # a row far ahead lets the watermark pass all windows before
    spark.createDataFrame([(dt.datetime(2025, 1, 1), "a", 1.0, 1.0, 1.0, "")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    m = moments.window_moments(stream, COLS, "1 day", late="2 days", family="kind")
    for _ in range(2):  # the second run finds nothing new
        moments.write_moments(m, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = moments.stored_moments(spark, str(tmp_path / "out"))
    batch = moments.window_moments(spark.createDataFrame(data, SCHEMA), COLS, "1 day", family="kind")
    theta = lambda d: {(r.family, r.start): (r.n, r.theta) for r in moments.window_covariances(d).collect()}
    got, want = theta(stored), theta(batch)
    assert got.keys() == want.keys() and len(got) == 12
    assert all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1], atol=1e-9) for k in want)
    cfg = glasso.GlassoConfig(lam=0.05, beta=0.02, max_iters=40)
    fit = lambda d: {(r.family, r.start): r.theta for r in moments.fit_windows(d, cfg, last=3, ridge=0.1).collect()}
    a, b = fit(stored), fit(batch)
    assert a.keys() == b.keys() and len(a) == 6 and all(np.allclose(a[k], b[k], atol=1e-6) for k in b)


def test_ridge_and_last(spark):
    df = spark.createDataFrame(rows(random.Random(3), 400), SCHEMA)
    m = moments.window_moments(df, COLS, "1 day")
    cfg = glasso.GlassoConfig(lam=0.05, beta=0.02, max_iters=500, eps_abs=1e-7, eps_rel=1e-7)
    own = [(r.start, r.n, unpack(np.array(r.theta)) + 0.1 * np.eye(3)) for r in moments.window_covariances(m).orderBy("start").collect()][-2:]
    w = [n / min(n for _, n, _ in own) for _, n, _ in own]
    want = glasso.solve([s for _, _, s in own], cfg.lam, cfg.beta, cfg.penalty, w, cfg.max_iters, cfg.rho, cfg.eps_abs, cfg.eps_rel)["theta"]
    got = {r.start: unpack(np.array(r.theta)) for r in moments.fit_windows(m, cfg, last=2, ridge=0.1).collect()}
    assert len(got) == 2 and all(np.allclose(got[t], x, atol=1e-6) for (t, _, _), x in zip(own, want))
    assert moments.fit_windows(m.where(F.lit(False)), cfg).count() == 0

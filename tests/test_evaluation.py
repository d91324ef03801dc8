"""From packed fits to records and sheets, against plain numpy; a folder is evaluated once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqnet.operators import cluster, evaluation, matrix

Q = 21


def made(seed=0, n=14):
    """Two fits with clusters (one final) and one without."""
    rng = np.random.default_rng(seed)
    rows = []
    for method, name, family, k in (("ours", "f_final", "f", 3), ("ours", "f_1", "f", 3), ("psicov", "g", "g", 1)):
        for c in range(k):
            m = rng.normal(size=(n * Q, n * Q)) * (rng.random((n * Q, n * Q)) < 0.02) * 0.01
            rows.append((method, name, family, c, matrix.pack(m + m.T).tolist()))
    return rows


FIT = "method string, name string, family string, cluster_idx int, theta array<double>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    n = 14
    native = [(f, i, j, float(rng.random() * 16), bool(rng.random() < 0.9)) for f in "fg" for i in range(1, n + 1) for j in range(i, n + 1)]
    clusters = [("f", 0, k) for k in range(9)] + [("f", 1, k) for k in range(4)] + [("f", 2, k) for k in range(4, 9)]
    seqs = [("f", k, f"SEQ{k}") for k in range(9)]
    c = spark.createDataFrame(clusters, "family string, cluster_idx int, seq_id int")
    return {
        "native": spark.createDataFrame(native, "family string, i int, j int, dist double, valid boolean"),
        "sizes": c.groupBy("family", "cluster_idx").agg(F.count("*").alias("n")),
        "targets": cluster.with_target(c, spark.createDataFrame(seqs, "family string, seq_id int, seq string"), spark.createDataFrame([("f", "SEQ6")], "family string, target string")),
        "lengths": spark.createDataFrame([("f", n), ("g", n)], "family string, seq_len int"),
    }, {(f, i, j): d <= 8 and v for f, i, j, d, v in native}


def plain(rows, hits, n=14, cutoff=1e-4):
    out = {}
    for name, method, family in sorted({(r[1], r[0], r[2]) for r in rows}):
        mats = [matrix.unpack(np.array(r[4])) for r in sorted(r for r in rows if r[1] == name)]
        w = np.array([9, 4, 5]) / 18 if family == "f" else np.array([1.0])
        mats.append(sum(x * m for x, m in zip(w, mats)))
        for k, m in enumerate(mats):
            m = np.where(np.abs(m) < cutoff, 0, m)
            score = np.array([[np.abs(m[Q * i : Q * i + 20, Q * j : Q * j + 20]).sum() for j in range(n)] for i in range(n)])
            off = sum((np.abs(m[Q * i : Q * i + Q, Q * j : Q * j + Q]) >= 1e-3).sum() for i in range(n) for j in range(n) if i != j)
            s1, s2 = off / (n * Q) ** 2, 2 * sum(score[i, j] >= 0.1 for i in range(n) for j in range(i + 1, n)) / n**2
            flags = (family == "f" and k == 2, family == "g" or "final" in name, k == len(mats) - 1)
            for ty, lo, hi in (("NORMAL", 5, 9), ("NORMAL", 10, 23), ("NORMAL", 23, None), ("TOP_L", 5, None), ("TOP_L", 9, None), ("TOP_L", 12, None), ("TOP_L", 24, None)):
                best = sorted((-round(score[i - 1, j - 1], 9), i, j) for i in range(1, n + 1) for j in range(i + lo, n + 1) if hi is None or j - i <= hi)
                for cut, top in [(str(v), v) for v in (1, 2, 5, 10, 25, 50, 100)] if ty == "NORMAL" else [("L", n), ("L/2", n // 2), ("L/5", n // 5), ("L/10", n // 10)]:
                    if best and top:
                        out[method, name, family, k, ty, lo, cut] = (sum(hits[family, i, j] for _, i, j in best[:top]) / top, s1, s2, *flags)
    return out


def test_records_of_fits(spark, tables):
    t, hits = tables
    rows = made()
    fits = spark.createDataFrame(rows, FIT)
    got = evaluation.records(evaluation.scored(evaluation.models(fits, t["sizes"])), t["native"], t["targets"], t["lengths"]).collect()
    want = plain(rows, hits)
    assert len(got) == len(want)
    for r in got:
        w = want[r.method, r.name, r.target, r.model_idx, r.ty, r.min_sep, r.cutoff]
        assert np.allclose((r.precision, r.s1, r.s2), w[:3]) and (r.is_target, r.is_final, r.is_avg) == w[3:]
    assert any(r.is_target for r in got) and evaluation.models(fits.limit(0), t["sizes"]).count() == 0
    odd = spark.createDataFrame([("m", "zero", "f", 0, [0.0] * 231), ("m", "gone", "f", 0, None), ("m", "gone", "f", 1, [1.0] * 231)], FIT)
    assert evaluation.models(odd, t["sizes"]).count() == 0


def test_sheets_of_records(spark, tables):
    t, _ = tables
    rows = evaluation.records(evaluation.scored(evaluation.models(spark.createDataFrame(made(), FIT), t["sizes"])), t["native"], t["targets"], t["lengths"])
    meta = spark.createDataFrame([("f", 14, 100, 50.5), ("g", 14, 10, 5.0)], "target string, seq_len int, depth int, meff double")
    flat = rows.toPandas()
    for name, sheet in evaluation.sheets(rows, meta).items():
        ty, final = evaluation.SHEETS[name]
        own = flat[(flat.ty == ty) & ((flat.is_final == final) | (flat.method == "psicov"))]
        got = {(r.method, r.target, r.kind, r.min_sep, r.data_type): r for r in sheet.collect()}
        assert {k[3] for k in got} == set(own.min_sep) and all(r.seq_len == 14 for r in got.values())
        kinds = {"ALL": own.model_idx >= 0, "FIRST": own.model_idx == 0, "TARGET": own.is_target, "AVG": own.is_avg}
        for kind, mask in kinds.items():
            for (method, target, sep, cut), g in own[mask & (own.method == "ours")].groupby(["method", "target", "min_sep", "cutoff"]):
                assert np.isclose(got[method, target, kind, sep, "q75"][cut], np.quantile(g.precision, 0.75)) and np.isclose(got[method, target, kind, sep, "mean"][cut], g.precision.mean())


def test_folder_is_evaluated_once(spark, tables, tmp_path):
    t, _ = tables
    rows, path = made(), str(tmp_path / "out")
    run = lambda r: sorted((x.method, x.name) for x in evaluation.evaluate_folder(spark.createDataFrame(r, FIT), path, t["sizes"], t["targets"], t["native"], t["lengths"]).collect())
    key = lambda: {(r.method, r.name, r.model_idx, r.ty, r.min_sep, r.cutoff): r.precision for r in evaluation.stored_records(spark, path).collect()}
    assert evaluation.stored_records(spark, path).count() == 0
    assert run([r for r in rows if r[1] != "g"]) == [("ours", "f_1"), ("ours", "f_final")]
    first = key()
    assert run(rows) == [("psicov", "g")]
    both = key()
    assert run(rows) == [] and key() == both and set(first) < set(both) and all(both[k] == v for k, v in first.items())
    again = [(*r[:4], (np.array(r[4]) * 2 + 0.001).tolist()) if r[1] == "f_1" else r for r in rows]
    assert run(again) == [("ours", "f_1")]
    changed = key()
    assert set(changed) == set(both) and {k for k in both if changed[k] != both[k]} <= {k for k in both if k[1] == "f_1"}
    fresh = str(tmp_path / "fresh")
    evaluation.evaluate_folder(spark.createDataFrame(again, FIT), fresh, t["sizes"], t["targets"], t["native"], t["lengths"])
    assert changed == {(r.method, r.name, r.model_idx, r.ty, r.min_sep, r.cutoff): r.precision for r in evaluation.stored_records(spark, fresh).collect()}

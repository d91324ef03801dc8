"""Properties of the numeric operators, and readers on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqnet.functions import residues as R
from seqnet.operators import cluster, geometry, glasso, matrix, msa, prox
from seqnet.sources import readers


def spd(rng, n):
    a = rng.standard_normal((n, 3 * n))
    return a @ a.T / (3 * n)


@pytest.mark.parametrize("kind", ["l1", "l2", "laplacian", "linf", "perturbation"])
def test_edge_is_a_minimum(kind):
    rng = np.random.default_rng(0)
    sym = lambda: (lambda a: a + a.T)(rng.standard_normal((4, 4)))
    a, b, eta = sym(), sym(), 0.3
    psi = {"l1": lambda d: np.abs(d).sum(), "l2": lambda d: np.linalg.norm(d, axis=0).sum(), "laplacian": lambda d: (d * d).sum(), "linf": lambda d: np.abs(d).max(0).sum()}
    x, y = prox.edge(a, b, eta, kind)
    if kind == "perturbation":
        assert np.allclose(x + y, a + b) and np.linalg.norm(x - y) < np.linalg.norm(a - b)
        return
    f = lambda x, y: eta * psi[kind](x - y) + ((x - a) ** 2).sum() / 2 + ((y - b) ** 2).sum() / 2
    for _ in range(200):
        dx, dy = (0.01 * rng.standard_normal((4, 4)) for _ in range(2))
        assert f(x + dx, y + dy) >= f(x, y) - 1e-12


def test_zero_difference_has_no_nan():
    assert np.isfinite(prox.edge(np.eye(3), np.eye(3), 1.0, "l2")[0]).all()


def test_logdet_is_stationary():
    rng = np.random.default_rng(1)
    s, a = spd(rng, 5), spd(rng, 5)
    x = prox.logdet(s, a, 2.0)
    assert np.abs(-np.linalg.inv(x) + s + 2.0 * (x - a)).max() < 1e-9


@pytest.mark.parametrize("kind", ["l1", "l2", "laplacian", "linf"])
def test_solver(kind):
    rng = np.random.default_rng(2)
    s = [spd(rng, 5) for _ in range(3)]
    fit = glasso.solve(s, 0.05, 0.05, kind, max_iters=3000, eps_abs=1e-8, eps_rel=1e-8)
    x = fit["x"]
    best = glasso.objective(x, s, 0.05, 0.05, kind)
    for _ in range(100):
        d = [(lambda m: 1e-3 * (m + m.T))(rng.standard_normal((5, 5))) for _ in x]
        assert glasso.objective([a + b for a, b in zip(x, d)], s, 0.05, 0.05, kind) >= best - 1e-6
    assert np.linalg.eigvalsh(x[0])[0] > 0


def test_limits():
    rng = np.random.default_rng(3)
    s = [spd(rng, 4) for _ in range(3)]
    one = [glasso.solve([m], 0.1, [], max_iters=2000, eps_abs=1e-7, eps_rel=1e-7)["theta"][0] for m in s]
    free = glasso.solve(s, 0.1, 0.0, max_iters=2000, eps_abs=1e-7, eps_rel=1e-7)["theta"]
    assert np.abs(np.array(one) - np.array(free)).max() < 3e-3  # the stopping rule has a fixed slack of 1e-4
    tied = glasso.solve(s, 0.1, 1e3, max_iters=3000, eps_abs=1e-7, eps_rel=1e-7)["theta"]
    assert np.abs(tied[0] - tied[2]).max() < 1e-2
    diag = glasso.solve(s, 1e3, 0.0, max_iters=2000)["theta"][0]
    assert np.abs(diag - np.diag(np.diag(diag))).max() == 0


def test_search_reaches_the_density():
    rng = np.random.default_rng(4)
    s = [spd(rng, 8) for _ in range(2)]
    got = glasso.search(s, glasso.GlassoConfig(lam=0.05, beta=0.01, target_density=0.3, density_tol=0.08, trials=25))
    assert max(abs(d - 0.3) for d in got["density"]) < 0.2


def test_pack_shrink_project():
    rng = np.random.default_rng(5)
    m = spd(rng, 6)
    assert np.allclose(matrix.unpack(matrix.pack(m)), m)
    low = np.outer(np.arange(4.0), np.arange(4.0))
    np.linalg.cholesky(matrix.shrink(low)[0])
    assert np.linalg.matrix_rank(matrix.project(m, 2)) <= 2


def test_clusters():
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ARND"), 12)) for _ in range(30)] + ["WWWWYYYYWWWW"] * 5
    d = cluster.blosum_distance(seqs)
    assert np.allclose(d, d.T) and d.min() >= 0
    groups, between = cluster.agglomerate(d, 4)
    assert sorted(i for g in groups for i in g) == list(range(35)) and len(groups) == 4
    assert any(set(range(30, 35)) <= set(g) for g in groups)
    assert 0 in cluster.ordered(groups, between, 0)[0]


def test_agglomerate_large_is_complete_linkage():
    rng = np.random.default_rng(7)
    p = rng.random((140, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    groups, between = cluster.agglomerate(d, 110, balance_below=0)
    for a in range(len(groups)):
        for b in range(a):
            assert abs(between[a][b] - d[np.ix_(groups[a], groups[b])].max()) < 1e-12


def test_geometry(spark):
    rows = [("f", 0, [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], None, [0.0, 0.0, 1.0]), ("f", 1, [5.0, 1.0, 0.0], [5.0, 0.0, 0.0], None, None, [5.0, 0.0, 1.0])]
    c = spark.createDataFrame(rows, "family string, res int, n array<double>, ca array<double>, cb array<double>, cg array<double>, o array<double>")
    got = {(r.i, r.j, r.atom_pair): r.dist for r in geometry.distances(c).collect()}
    assert got[0, 1, "CaCa"] == 5 and got[0, 1, "CbCb"] is None and got[0, 0, "CaCa"] == 0
    fixed = geometry.repaired(geometry.distances(c)).where("i = 0 and j = 0 and atom_pair = 'CaCa'").first()
    assert fixed.dist == 1e-4


def test_readers(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nAR\nND\n\n>two\nCQEG\n")
    assert [(r.name, r.seq) for r in readers.fasta(spark, str(tmp_path / "a.fasta")).orderBy("seq_id").collect()] == [("one x", "ARND"), ("two", "CQEG")]
    assert readers.first_sequence(spark, str(tmp_path / "a.fasta")).first().seq == "AR"
    assert readers.depth(spark, str(tmp_path / "a.fasta")).first().depth == 2
    (tmp_path / "c.clstr").write_text(">Cluster 0\n0 >seq-1... *\n1 >seq-2... at\n>Cluster 1\n0 >seq-3... *\n")
    got = readers.cluster_file(spark, str(tmp_path / "c.clstr")).orderBy("name").collect()
    assert [(r.cluster_idx, r.name) for r in got] == [(0, "seq-1"), (0, "seq-2"), (1, "seq-3")]
    (tmp_path / "m.txt").write_text("x\nprecision matrix\n1.0 2.0\n3.0 4.5\n\nrest\n")
    assert [r.v for r in readers.named_matrix(spark, str(tmp_path / "m.txt"), "precision matrix").orderBy("r", "c").collect()] == [1.0, 2.0, 3.0, 4.5]
    (tmp_path / "p.pdb").write_text("ATOM      1  CA  GLY A   7      11.104   6.134  -6.504  1.00  0.00\nENDMDL\nATOM      1  CA  GLY A   8      11.104   6.134  -6.504\n")
    assert [(r.residue, r.res_no, r.x) for r in readers.atoms(spark, str(tmp_path / "p.pdb")).collect()] == [("GLY", 7, 11.104)]


def test_scalars(spark):
    r = spark.range(1).select(R.his_tag(__import__("pyspark").sql.functions.lit("MHHHHAAAAAAAAAAAAAAAAA")).alias("h")).first().h
    assert r[:5] == [1, 1, 1, 1, 1] and sum(r) == 5


def test_streaming_counts(spark, tmp_path):
    import datetime as dt

    from seqnet.streaming.windows import windowed_counts

    rows = [(dt.datetime(2024, 1, 1 + k % 3), k % 2, "a") for k in range(6)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == 6


def test_pairs_of_blocks_are_spread(spark):
    """Of 20 blocks of one family, each pair is compared once, in more than one task where nothing is broadcast."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(400).select(F.lit("f").alias("family"), F.col("id").alias("seq_id"), F.lit("ARND").alias("seq"))
        pairs = msa._block_pairs(rows, 20)
        got = pairs.select("ba", "bb", F.size("sa").alias("a"), F.size("sb").alias("b"), F.spark_partition_id().alias("p")).collect()
        blocks = {r.ba: r.a for r in got}
        assert len(got) == len(blocks) * (len(blocks) + 1) // 2 == len({(r.ba, r.bb) for r in got}) and sum(blocks.values()) == 400
        by = {p: sum(r.p == p for r in got) for p in {r.p for r in got}}
        assert len(by) == 4 and max(by.values()) < len(got) / 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

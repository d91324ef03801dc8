"""Readers and writers on small files, and fits of small alignments from end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqnet.operators import cluster, contacts, geometry, glasso, matrix, msa
from seqnet.sources import readers


def test_sequence_files(spark, tmp_path):
    (tmp_path / "one.fasta").write_text(">only one\nARND\nCQ\n")
    (tmp_path / "two.fasta").write_text(">a\nAR\n>b\nND\n")
    assert readers.single_sequence(spark, str(tmp_path / "one.fasta")).first().seq == "ARNDCQ"
    with pytest.raises(Exception, match="more than one record"):
        readers.single_sequence(spark, str(tmp_path / "two.fasta")).collect()
    (tmp_path / "even.a2m").write_text("ARND\nA-ND\n\n")
    (tmp_path / "odd.a2m").write_text("ARND\nAR\n")
    assert sorted(r.seq for r in readers.a2m(spark, str(tmp_path / "even.a2m")).collect()) == ["A-ND", "ARND"]
    with pytest.raises(Exception, match="unequal length"):
        readers.a2m(spark, str(tmp_path / "odd.a2m")).collect()
    rows = spark.createDataFrame([("x", "ARbZ"), ("y", "ND")], "name string, seq string")
    assert sorted(r.seq for r in readers.rewritten(rows).collect()) == ["AR--", "ND"]
    readers.write_fasta(rows.coalesce(1), str(tmp_path / "out"))
    assert sorted((r.name, r.seq) for r in readers.fasta(spark, str(tmp_path / "out")).collect()) == [("x", "ARbZ"), ("y", "ND")]
    rows = spark.createDataFrame([("tr-12-x rest", "ARU"), ("plain", "AND"), ("same", "CCC")], "name string, seq string")
    assert sorted((r.name, r.seq) for r in readers.converted(rows, "CCC").collect()) == [("plain", "AND"), ("target", "CCC"), ("tr12", "ARX")]
    with pytest.raises(Exception, match="unknown letter"):
        readers.converted(spark.createDataFrame([("a", "A1")], "name string, seq string"), "C").collect()
    (tmp_path / "named.txt").write_text(">seq-7 old\nAA\nCC\n\n>other\nGG\n>seq-8\nTT\n")
    assert sorted((r.name, r.seq) for r in readers.named_sequences(spark, str(tmp_path / "named.txt")).collect()) == [("seq-7", "CC"), ("seq-8", "TT")]


def test_folders_and_jobs(spark, tmp_path):
    for name in ("fam1_0.npy", "fam1_final.npy", "fam2.npy"):
        (tmp_path / name).write_text("x")
    got = readers.families(spark, str(tmp_path)).collect()
    assert sorted((r.family, r.name) for r in got) == [("fam1", "fam1_0"), ("fam1", "fam1_final"), ("fam2.npy", "fam2")]
    sizes = spark.createDataFrame([("a", 10), ("b", 5000), ("c", 9000), ("d", 13000)], "family string, n_seqs long")
    assert sorted((r.family, r.k) for r in readers.jobs(sizes).collect()) == [("a", 3), ("b", 4), ("c", 5)]


def atom_line(no, name, residue, chain, res_no, x):
    return f"ATOM  {no:5d} {name:^4s} {residue:3s} {chain}{res_no:4d}    {x:8.3f}{1.0:8.3f}{2.0:8.3f}"


def test_structure_files(spark, tmp_path):
    lines = ["SEQRES   1 A    3  GLY ALA MSE VAL", atom_line(1, "CA", "GLY", "A", 7, 1.5), atom_line(2, "CA", "VAL", "A", 9, 2.5), atom_line(3, "CA", "ALA", "A", 8, 3.5), atom_line(4, "CA", "TRP", "B", 1, 4.5), "ENDMDL", atom_line(5, "CA", "TYR", "A", 1, 9.0)]
    (tmp_path / "s.pdb").write_text("\n".join(lines) + "\n")
    atoms = readers.atoms(spark, str(tmp_path / "s.pdb"))
    assert sorted((r.chain, r.seq) for r in readers.chain_sequences(atoms).collect()) == [("A", "GAV"), ("B", "W")]
    assert readers.one_chain(atoms, "B").count() == 1
    assert [(r.chain, r.seq) for r in readers.seqres(spark, str(tmp_path / "s.pdb")).collect()] == [("A", "GAV")]
    head = "data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in ("group_PDB", "id", "label_atom_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"))
    (tmp_path / "s.cif").write_text(head + 'ATOM 1 CA GLY A 7 1.5 1.0 2.0 1\nATOM 2 "C5\'" ALA A 8 3.5 1 2 1\nATOM 3 CA TYR A 1 9 9 9 2\n')
    got = sorted((r.chain, r.res_no, r.residue, r.atom, r.x) for r in readers.mmcif_atoms(spark, str(tmp_path / "s.cif")).collect())
    assert got == [("A", 7, "GLY", "CA", 1.5), ("A", 8, "ALA", "C5'", 3.5)]
    (tmp_path / "ann.csv").write_text("file,chain,res_no,ss8,acc,phi,psi\ns.pdb,A,7,G,0.05,-60.0,30.0\ns.pdb,A,8,-,,1.0,2.0\n")
    mapping = spark.createDataFrame([("f", 0, "s.pdb", "A", 7), ("f", 1, "s.pdb", "A", 8), ("f", 2, None, None, None)], "family string, res int, file string, chain string, res_no int")
    got = geometry.annotated(mapping, readers.annotation(spark, str(tmp_path / "ann.csv"))).orderBy("res").collect()
    assert [(r.missing, r.ss8, r.ss3, r.pacc, r.acc) for r in got] == [(0, "G", "H", 5, 0), (0, "L", "C", 45, 2), (1, "L", "C", 45, 2)]


def test_sheets(spark, tmp_path):
    sheet = spark.createDataFrame([("a", 0.123456789, 3), ("b", None, 4)], "method string, mean double, n int")
    readers.write_sheet(sheet, str(tmp_path / "sheet"))
    assert sorted(map(tuple, readers.read_sheet(spark, str(tmp_path / "sheet"), sheet.schema.simpleString()[7:-1].replace(":", " ")).collect())) == [("a", 0.12346, 3), ("b", None, 4)]


def test_virtual_cb_and_coordinates(spark):
    n, ca, c = [1.45, 0.0, 0.0], [0.0, 0.0, 0.0], [-0.5, 1.4, 0.0]
    lit = lambda v: F.array(*map(F.lit, v))
    v = np.array(spark.range(1).select(geometry.virtual_cb(lit(n), lit(ca), lit(c)).alias("v")).first().v)
    axis = np.array(c) / np.linalg.norm(c)
    assert abs(np.linalg.norm(v) - 1.45) < 1e-9 and abs(v @ axis - np.array(n) @ axis) < 1e-9  # a turn about CA-C
    side = lambda x: np.array(x) - (np.array(x) @ axis) * axis
    a, b = side(n), side(v)
    turn = np.degrees(np.arctan2(np.cross(a, b) @ axis, a @ b))
    assert abs(turn + 120) < 1e-6
    atoms = spark.createDataFrame([("s", "A", 1, "GLY", "N", *n), ("s", "A", 1, "GLY", "CA", *ca), ("s", "A", 1, "GLY", "C", *c), ("s", "A", 2, "SER", "OG", 1.0, 2.0, 3.0)], "file string, chain string, res_no int, residue string, atom string, x double, y double, z double")
    mapping = spark.createDataFrame([("f", 0, "s", "A", 1), ("f", 1, "s", "A", 2), ("f", 2, None, None, None)], "family string, res int, file string, chain string, res_no int")
    got = geometry.coordinates(mapping, atoms).orderBy("res").collect()
    assert got[0].cb == ca and np.allclose(got[0].vcb, v) and got[1].cg == [1.0, 2.0, 3.0] and got[1].ca is None and got[2].letter is None


def brute_covariance(seqs, wts):
    alphabet, q, n = "ARNDCQEGHILKMFPSTWYV-", 21, len(seqs[0])
    x = np.zeros((len(seqs), n * q))
    for k, s in enumerate(seqs):
        for p, ch in enumerate(s):
            x[k, p * q + alphabet.index(ch)] = 1
    total = sum(wts)
    f = (1 + wts @ x) / (q + total)
    m = (1 / q + (x * wts[:, None]).T @ x) / (q + total) - np.outer(f, f)
    for p in range(n):
        own = slice(p * q, (p + 1) * q)
        m[own, own] = np.diag(f[own] - f[own] ** 2)
    return m


@pytest.fixture(scope="module")
def alignment(spark):
    r = np.random.default_rng(3)
    rows = [(fam, k, "".join(r.choice(list("ARND-"), 5))) for fam in ("f", "g") for k in range(40)]
    return spark.createDataFrame(rows, "family string, seq_id long, seq string")


def test_full_covariance_brute_force(spark, alignment, monkeypatch):
    w = msa.weights(alignment)
    seqs = {(r.family, r.seq_id): r.seq for r in alignment.collect()}
    wt = {(r.family, r.seq_id): r.wt for r in w.collect()}
    for (fam, k), s in seqs.items():
        near = sum(sum(a == b and a != "-" for a, b in zip(s, t)) > 0.62 * len(s.replace("-", "")) for (g, j), t in seqs.items() if g == fam and j != k)
        assert abs(wt[fam, k] - 1 / (1 + near)) < 1e-12
    monkeypatch.setattr(msa, "BLOCK", 7)  # many blocks give the same weights
    assert {(r.family, r.seq_id): r.wt for r in msa.weights(alignment).collect()} == wt
    one = {(r.family, r.seq_id): r.wt for r in msa.weights_by_mismatch(alignment).collect()}
    for (fam, k), s in seqs.items():
        near = sum(int(5 * 0.38) > sum(a != b for a, b in zip(s, t)) for (g, j), t in seqs.items() if g == fam and j != k)
        assert abs(one[fam, k] - 1 / (1 + near)) < 1e-12
    packed = {r.family: matrix.unpack(np.array(r.theta)) for r in glasso.packed(msa.covariance_blocks(alignment, w), ["family"]).collect()}
    for fam in "fg":
        keys = [k for k in seqs if k[0] == fam]
        assert np.allclose(packed[fam], brute_covariance([seqs[k] for k in keys], np.array([wt[k] for k in keys])))


def test_fit_of_families(spark, alignment, tmp_path):
    clusters = cluster.with_all_first(alignment, cluster.random_clusters(alignment, 2, 1), 3)
    cfg = glasso.GlassoConfig(lam=0.02, beta=0.01, max_iters=30, final_iters=60, trials=3, target_density=0.05, density_tol=0.01, offset=63, target_shift=0.001, selected=(0,), single=True)
    fits = glasso.fit_families(alignment, clusters, cfg)
    glasso.write_fits(fits, str(tmp_path / "fits"), cfg)
    back = spark.read.parquet(str(tmp_path / "fits")).orderBy("family", "cluster_idx").collect()
    assert [(r.family, r.cluster_idx) for r in back] == [(f, k) for f in "fg" for k in range(3)] and back[0].args["penalty"] == "l1" and back[0].lam == back[1].lam
    for r in back:
        m = matrix.unpack(np.array(r.theta))
        assert m.shape == (105, 105) and np.allclose(m, m.T) and abs(glasso.density_of(m, 1e-3, 63) - r.density) < 1e-12
    scores = {(r.family, r.model_idx, r.i, r.j): r.score for r in contacts.contact_scores(spark.read.parquet(str(tmp_path / "fits"))).collect()}
    m = np.abs(matrix.unpack(np.array(back[1].theta)))
    assert abs(scores["f", 1, 2, 4] - m[21:41, 63:83].sum()) < 1e-9 and len(scores) == 2 * 3 * 10
    glasso.write_fits(fits.where("family = 'g'"), str(tmp_path / "fits"), cfg)  # replaces that family only
    assert spark.read.parquet(str(tmp_path / "fits")).count() == 6


def test_letters_in_batches(spark):
    rows = spark.createDataFrame([("a", "arx-"), ("a", None), (None, "r" * 7), ("b", "")], "family string, t string")
    got = {(r.family, r.pos, r.aa): r.w for r in msa.letter_counts(rows, 3, "ar-").collect()}
    assert got == {("a", 1, 0): 1, ("a", 2, 1): 1, ("a", 3, 2): 1, ("a", 1, 2): 1, ("a", 2, 2): 1, **{("a", 3, 2): 2}, (None, 1, 1): 3, (None, 2, 1): 2, (None, 3, 1): 2, (None, 2, 2): 1, (None, 3, 2): 1}


def test_shapes():
    v = np.array([1.0, 1e-9, 2.0])
    assert (matrix.unpack_banded(v, 1e-6) == np.array([[1.0, 0.0], [0.0, 2.0]])).all()


def test_greedy_clusters_in_rounds(spark):
    r = np.random.default_rng(5)
    heads = ["".join(r.choice(list("ARNDCQEG"), 12)) for _ in range(9)]
    rows = []
    for fam, size in (("f", 150), ("g", 7)):
        for k in range(size):
            s = list(heads[r.integers(0, 9)])
            for _ in range(r.integers(0, 5)):
                s[r.integers(0, 12)] = str(r.choice(list("ARND-")))
            rows.append((fam, k, "".join(s)))
    df = spark.createDataFrame(rows, "family string, seq_id long, seq string")
    want = {}
    for fam in "fg":
        own = sorted(((f, k, s) for f, k, s in rows if f == fam), key=lambda v: (-len(v[2].replace("-", "")), v[1]))
        found = []
        for f, k, s in own:
            hit = next((i for i, h in enumerate(found) if sum(a == b != "-" for a, b in zip(s, h)) / max(1, len(s.replace("-", ""))) >= 0.7), None)
            if hit is None:
                found.append(s)
                hit = len(found) - 1
            want[f, k] = hit
    for batch in (2048, 10):
        assert {(x.family, x.seq_id): x.cluster_idx for x in cluster.greedy_clusters(df, 0.7, batch).collect()} == want

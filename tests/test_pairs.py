"""All pairs in cells: every pair once whatever the blocks, in several tasks, with the values of plain code."""

import itertools
import math
import time

import numpy as np
from pyspark.sql import functions as F

from seqnet.operators import cluster, contacts, evaluation, geometry, matrix, msa, pairs


def test_every_pair_once_and_in_several_tasks(spark):
    rows = spark.range(700).select((F.col("id") % 2).cast("string").alias("f"), F.col("id").alias("n"), (F.col("id") * 3).alias("g"))
    rows = rows.unionByName(spark.createDataFrame([("c", 5, 1), ("c", 5, 2), ("c", 6, 3)], rows.schema))
    made = pairs.id_pairs(rows, "f", "n", ("g",))
    want = [(f, i, j) for f in "01" for i, j in itertools.combinations(range(int(f), 700, 2), 2)]
    got = [(r.f, r.i, r.j, r.g_i, r.g_j) for r in made.collect()]
    assert sorted(x[:3] for x in got if x[0] != "c") == sorted(want) and all(a == 3 * i and b == 3 * j for f, i, j, a, b in got if f != "c")
    assert sorted(x for x in got if x[0] == "c") == [("c", 5, 6, 1, 3), ("c", 5, 6, 2, 3)]
    # a small input's pairs are not made by one task
    assert made.groupBy(F.spark_partition_id()).count().count() > 1
    both = pairs.all_pairs(rows.select("f", F.col("n").alias("i")), rows.select("f", F.col("n").alias("j")), "f", F.col("i"), F.col("j"))
    assert both.count() == 2 * 350**2 + 9 and both.where("f <> 'c'").select("f", "i", "j").distinct().count() == 2 * 350**2


def test_rounded_is_round(spark):
    v = [0.5, 1.0000005, -1.0000005, 2.5e-7, -2.5e-7, 0.1234565, 1e13 + 0.3, -7.0, 123.4567891, float("inf"), float("nan"), None, *np.random.default_rng(3).normal(size=500).tolist()]
    rows = spark.createDataFrame([(x,) for x in v], "x double").select(F.round("x", 6).alias("a"), pairs.rounded(F.col("x"), 6).alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]


def test_orientations_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 8)
    xyz = np.random.default_rng(5).normal(size=(30, 4, 3))
    spot = lambda r, k: None if (r + k) % 11 == 0 else xyz[r, k].tolist()
    c = spark.createDataFrame([("f", r, *[spot(r, k) for k in range(4)]) for r in range(30)], "family string, res int, n array<double>, ca array<double>, cb array<double>, vcb array<double>")

    def dihedral(*p):
        p = [np.array(x) for x in p]
        u, v, w = p[1] - p[0], p[2] - p[1], p[3] - p[2]
        return math.degrees(math.atan2(np.dot(np.cross(np.cross(u, v), np.cross(v, w)), v) / np.linalg.norm(v), np.dot(np.cross(u, v), np.cross(v, w)))) if v.any() else None

    got = {(r.i, r.j): r for r in geometry.cb_orientations(c).collect()}
    assert len(got) == 900
    for i, j in got:
        atoms = spot(i, 1), spot(i, 2) or spot(i, 3), spot(j, 2) or spot(j, 3), spot(j, 1)
        want = 0.0 if i == j else dihedral(*atoms) if all(atoms) else None
        assert got[i, j].omega is None if want is None else abs(got[i, j].omega - want) < 1e-9
    ca = {(r.i, r.j): r for r in geometry.ca_orientations(c.select("family", "res", "ca")).collect()}
    for i, j in ca:
        four = [spot(x, 1) if x < 30 else None for x in (i, i + 1, j, j + 1)]
        want = 0.0 if i == j else dihedral(*four) if all(four) else None
        assert ca[i, j].d1234 is None if want is None else abs(ca[i, j].d1234 - want) < 1e-9


def test_linkage_of_thousands_takes_seconds():
    x = np.random.default_rng(2).normal(size=(3000, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    began = time.process_time()
    groups, _ = cluster.agglomerate(d, 4)
    assert sorted(m for g in groups for m in g) == list(range(3000))
    assert time.process_time() - began < 6  # all minima anew at each merge take several times that


def test_substitution_distances_in_several_tasks(spark):
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("ARNDCQEG-"), 15)) for _ in range(600)]
    made = cluster.blosum_pairs(spark.createDataFrame([("f", k, s) for k, s in enumerate(seqs)], "family string, seq_id bigint, seq string"))
    assert made.groupBy(F.spark_partition_id()).count().count() > 1
    want = cluster.blosum_distance(seqs)
    got = {(r.i, r.j): r.d for r in made.collect()}
    assert len(got) == 600 * 599 // 2 and all(got[i, j] == want[i, j] for i, j in got)


def test_weights_meet_sequences_without_a_broadcast(spark):
    rows = spark.createDataFrame([("f", 1, "AR-X"), ("f", 2, "ARND"), ("g", 1, "-AAA"), ("g", 3, "QAAA"), ("g", 4, "")], "family string, seq_id bigint, seq string")
    wt = spark.createDataFrame([("f", 1, 0.5), ("f", 2, 1.0), ("g", 1, 0.25), ("g", 3, 1.0)], "family string, seq_id bigint, wt double")
    for df in (msa.weighted_freq(rows, wt), msa.pair_freq(rows, wt), msa.covariance_blocks(rows, wt)):
        assert "SortMergeJoin [family" in df._jdf.queryExecution().executedPlan().toString().replace("(skew=true)", "")
    key = lambda r: (r.family, r.pos, r.aa)
    got, want = ({key(r): r.freq for r in df.collect()} for df in (msa.weighted_freq(rows, wt), msa.column_freq(msa.cells(rows), wt)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_equal_letters_by_products():
    rng = np.random.default_rng(6)
    x, y = (msa._letters(["".join(rng.choice(list("ARND-"), 9)) for _ in range(n)]) for n in (40, 30))
    assert (msa._equal(x, y) == (x[:, None] == y[None]).sum(2)).all()
    assert (msa._equal(x, y, "-") == ((x[:, None] == y[None]) & (x[:, None] != 45)).sum(2)).all()


def test_best_of_models_are_those_of_all_pairs(spark):
    """Ties, several batches and bands that few pairs are in: the records are those that ranking every pair gives."""
    n = 230
    ids = spark.createDataFrame([(f, k) for f in "ab" for k in range(n)], "family string, n bigint")
    p = pairs.id_pairs(ids, "family", "n").select("family", "i", "j", ((F.col("i") * 31 + F.col("j") * 17) % 23).cast("double").alias("dist"), ((F.col("i") + F.col("j")) % 19 != 0).alias("valid"))
    score = lambda m: ((F.col("i") * 7 + F.col("j") * (m + 3)) % 13) / F.lit(13.0)
    names = spark.createDataFrame([("m", f + "_final", f, m, m, m == 1, 0.0) for f in "ab" for m in range(2)], "method string, name string, family string, at int, model_idx int, is_avg boolean, s1 double")
    targets = spark.createDataFrame([("a", 0, False), ("a", 1, True)], "family string, cluster_idx int, is_target boolean")
    lengths = spark.createDataFrame([("a", 60), ("b", 40)], "family string, seq_len int")
    got = evaluation.records_of_pairs(p.withColumn("scores", F.array(score(0), score(1))), names, targets, lengths)
    rows = p.join(names, "family").withColumn("score", F.when(F.col("at") == 0, score(0)).otherwise(score(1)))
    want = evaluation.records(rows.select("method", "name", "family", "model_idx", "is_avg", "s1", "i", "j", "score"), p, targets, lengths)
    key = lambda r: tuple(str(r[c]) for c in sorted(want.columns))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_pruned_rows_hold_the_best(spark):
    """Ties, scores that are no numbers or null, and keys in several tasks and batches."""
    score = F.when(F.col("i") % 37 == 0, None).when(F.col("i") % 91 == 0, float("nan")).otherwise((F.col("i") * 7 % 5).cast("double"))
    rows = spark.range(25000).select((F.col("id") % 3).cast("string").alias("f"), (F.col("id") * 31 % 25000).alias("i"), (F.col("id") % 11).alias("j")).withColumn("score", score).repartition(3)
    few = contacts.pruned(rows, ["f"], 150)
    assert few.count() <= 3 * 3 * 150
    want, got = (contacts.ranked(df, ["f"]).where("rank <= 150").collect() for df in (rows, few))
    assert sorted(map(repr, want)) == sorted(map(repr, got))


def test_entries_of_a_cell_are_grouped_where_they_are(spark):
    """Neither the mean model nor the check for symmetry moves a row for each entry; results are those without cells."""
    ids = spark.createDataFrame([(f, k) for f in "ab" for k in range(300)], "family string, n bigint")
    p = pairs.id_pairs(ids, "family", "n").select("family", *pairs.CELL, F.col("i").alias("r"), F.col("j").alias("c"), (F.col("i") * F.col("j") % 7).cast("double").alias("v"))
    m = matrix.unpack_long(p, ["family"], pairs.CELL).withColumn("v", F.when((F.col("family") == "b") & (F.col("r") == 5) & (F.col("c") == 9), -1.0).otherwise(F.col("v")))
    assert {r.family for r in matrix.symmetric_only(m, ["family"], within=pairs.CELL).select("family").distinct().collect()} == {"a"}
    ij = pairs.all_pairs(ids.withColumnRenamed("n", "i"), ids.withColumnRenamed("n", "j"), "family", F.expr("i div 3"), F.col("j")).where("i < j")
    fits = ij.select("family", *pairs.CELL, (F.col("i") % 3).cast("int").alias("model_idx"), F.expr("i div 3").alias("i"), F.lit(0).alias("a"), "j", F.lit(0).alias("b"), (F.col("i") + F.col("j") / 7).alias("v"))
    sizes = fits.groupBy("family", "model_idx").agg(F.count("*").alias("n"))
    with_cells, without = (contacts.with_mean_model(fits, sizes, within).where("is_avg") for within in (pairs.CELL, ()))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(family")
    assert exchanges(with_cells) < exchanges(without)
    key = lambda df: sorted((r.family, r.model_idx, r.i, r.j, round(r.v, 9)) for r in df.collect())
    assert key(with_cells) == key(without)


def test_linkage_of_groups_that_are_known(spark):
    s = spark.createDataFrame([("f", k, k % 4) for k in range(60)], "family string, n bigint, g bigint")
    p = pairs.id_pairs(s, "family", "n", ("g",)).withColumn("d", (F.col("i") * F.col("j") % 9).cast("double"))
    known = cluster.linkage(p.select("family", F.col("g_i").alias("ga"), F.col("g_j").alias("gb"), "d"))
    joined = cluster.linkage(p.select("family", "i", "j", "d"), s.withColumnRenamed("n", "seq_id"))
    own = {}
    for i in range(60):
        for j in range(i + 1, 60):
            if i % 4 != j % 4:
                own.setdefault(tuple(sorted((i % 4, j % 4))), []).append(i * j % 9)
    for out in (known, joined):
        got = {(r.ga, r.gb): (r.largest, r.q80, r["mean"]) for r in out.collect()}
        assert got.keys() == own.keys() and all(np.allclose(got[k], (max(v), np.quantile(v, 0.8), np.mean(v))) for k, v in own.items())

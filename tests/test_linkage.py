"""Linkage by rounds of reciprocal nearest neighbours equals merging one by one."""

import random

import numpy as np
from pyspark.sql import functions as F

from seqnet.operators import cluster, linkage


def family(rng, name, n, length):
    """Distinct enough that no two distances tie often: sequences drift from a few origins."""
    origins = ["".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(length)) for _ in range(5)]
    return [(name, 3 * k + 1, "".join(c if rng.random() < 0.6 else rng.choice("ARNDCQEGHILKMFPSTWYV-") for c in rng.choice(origins))) for k in range(n)]


def test_distances_of_blocks():
    rng = random.Random(0)
    seqs = [s for _, _, s in family(rng, "f", 40, 30)] + ["-" * 30]
    whole = cluster.blosum_distance(seqs)
    np.fill_diagonal(whole, 0)
    got = linkage.distances_between(seqs[:15], seqs[15:])
    assert np.allclose(got, whole[:15, 15:])


def parts(rows):
    out = {}
    for f, c, s in rows:
        out.setdefault(f, {}).setdefault(c, set()).add(s)
    return {f: [frozenset(v[c]) for c in sorted(v)] for f, v in out.items()}


def test_rounds_equal_one_by_one(spark):
    rng = random.Random(7)
    rows = family(rng, "big", 120, 60) + family(rng, "mid", 33, 60) + family(rng, "two", 2, 60)
    df = spark.createDataFrame(rows, "family string, seq_id bigint, seq string").repartition(3)
    for below in (100,):
        got = parts(map(tuple, linkage.linked_clusters(df, 3, below, block=16).collect()))
        for name in ("big", "mid", "two"):
            own = sorted(r for r in rows if r[0] == name)
            groups, between = cluster.agglomerate(cluster.blosum_distance([r[2] for r in own]), 3, below)
            assert got[name] == [frozenset(own[i][1] for i in g) for g in cluster.ordered(groups, between, 0)]


def test_large_families_are_linked_by_rounds(spark):
    rng = random.Random(3)
    rows = family(rng, "a", 24, 40) + family(rng, "b", 12, 40)
    df = spark.createDataFrame(rows, "family string, seq_id bigint, seq string")
    got = parts(map(tuple, cluster.phylo_clusters(df, 2, most=20).collect()))
    assert got == parts(map(tuple, cluster.phylo_clusters(df, 2).collect())) and set(got) == {"a", "b"}
    assert cluster.phylo_clusters(df.where(F.lit(False)), 2).count() == 0

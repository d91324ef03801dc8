"""Covariances as blocks equal one-hot products, however the sequences are dealt and passed on."""

import random

import numpy as np
import pytest

from seqnet.functions.residues import ALPHABET
from seqnet.operators import glasso, msa
from seqnet.operators.matrix import unpack

SCHEMA = "family string, seq_id bigint, seq string"


def alignment(rng, family, n, length, letters=ALPHABET):
    return [(family, 5 * k, "".join(rng.choice(letters) for _ in range(length))) for k in range(n)]


def by_hand(rows, wts, pseudo=1.0):
    q = len(ALPHABET)
    length = len(rows[0][2])
    x = np.zeros((len(rows), length, q))
    for r, (_, _, s) in enumerate(rows):
        for p, c in enumerate(s):
            if c in ALPHABET:
                x[r, p, ALPHABET.index(c)] = 1
    w = np.array([wts[r[1]] for r in rows])
    pair = np.einsum("r,ria,rjb->iajb", w, x, x)
    own = np.einsum("r,ria->ia", w, x)
    f = (pseudo + own) / (q * pseudo + own.sum(1, keepdims=True))
    out = (pseudo / q + pair) / (q * pseudo + w.sum()) - np.einsum("ia,jb->iajb", f, f)
    for i in range(length):
        out[i, :, i] = np.diag(f[i] - f[i] ** 2)
    return out


@pytest.mark.parametrize("held,parts,records", [(24_000_000, 3, 10000), (10_000, 5, 7), (100, 4, 3)])
def test_blocks(spark, monkeypatch, held, parts, records):
    monkeypatch.setattr(msa, "HELD", held)
    rng = random.Random(5)
    rows = alignment(rng, "a", 60, 9) + alignment(rng, "b", 25, 4, "ACD-X") + alignment(rng, "one", 1, 6)
    wts = [(f, i, 1 / rng.randint(1, 5)) for f, i, _ in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        m, w = spark.createDataFrame(rows, SCHEMA).repartition(parts), spark.createDataFrame(wts, "family string, seq_id bigint, wt double")
        got = {}
        for r in msa.covariance_blocks(m, w).collect():
            assert (r.i, r.j) not in got.setdefault(r.family, {}) and r.i <= r.j
            got[r.family][r.i, r.j] = np.array(r.cov).reshape(21, 21)
        theta = {r.family: unpack(np.array(r.theta)) for r in glasso.packed(msa.covariance_blocks(m, w), ["family"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {"a", "b", "one"}
    for f, blocks in got.items():
        own = [r for r in rows if r[0] == f]
        want = by_hand(own, {i: x for g, i, x in wts if g == f})
        n = len(own[0][2])
        assert len(blocks) == n * (n + 1) // 2
        assert all(np.allclose(c, want[i - 1, :, j - 1], atol=1e-12) for (i, j), c in blocks.items())
        assert np.allclose(theta[f], want.reshape(21 * n, 21 * n), atol=1e-12)


def test_positions_without_letters_and_no_rows(spark):
    m = spark.createDataFrame([("a", 1, "AXC"), ("a", 2, "CZ-")], SCHEMA)
    w = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.5)], "family string, seq_id bigint, wt double")
    assert {(r.i, r.j) for r in msa.covariance_blocks(m, w).collect()} == {(1, 1), (1, 3), (3, 3)}
    assert msa.covariance_blocks(m.where("false"), w).count() == 0 and msa.full_covariance(m.where("false"), w).count() == 0


def test_plan_holds_no_row_for_each_cell(spark):
    m = spark.createDataFrame(alignment(random.Random(1), "a", 30, 12), SCHEMA)
    w = m.selectExpr("family", "seq_id", "1.0D as wt")
    blocks = msa.covariance_blocks(m, w)
    assert blocks.count() == 12 * 13 // 2
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan

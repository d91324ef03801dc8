"""Spelling variants, substring dedup and centroid clustering against brute force, over hostile rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqnet.llm import centroids, substring_dedup, variants


def plain_near(words):
    """All pairs of distance one, by their definition."""
    out = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            if cut in out:
                out[w].add(cut)
                out[cut].add(w)
        for v in words:
            if len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 1:
                out[w].add(v)
    return out


def hostile_words(seed, letters, longest):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(400)})


@pytest.mark.parametrize("letters, longest", [("a", 30), ("ab", 7), ("abé", 6), ("abcdefghij", 4)])
def test_trie_finds_all_of_distance_one(letters, longest):
    words = hostile_words(longest, letters, longest)
    trie = variants.Trie.unpack(variants.Trie(words, [i + 1 for i in range(len(words))]).pack())
    near = plain_near(words)
    strangers = [w for w in hostile_words(99, letters + "x", longest) if w not in near]
    for w in words + strangers:
        got = list(trie.near(w))
        assert len(got) == len(set(got))
        want = near[w] if w in near else {v for v in words if v in plain_near(sorted({v, w}))[w]}
        assert {g for g, _ in got} == want and all(words[n - 1] == g for g, n in got)
    assert not list(variants.Trie([], []).near("abc"))


def plain_variants(counts, ratio=5):
    near, form = plain_near(list(counts)), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts.get(form[w]), root)
    return out


def test_variants_over_shards_and_groups(spark):
    rng = random.Random(5)
    counts = {w: 5 ** rng.randint(1, 6) for w in hostile_words(3, "abé", 7)} | {"z" * 3000: 5, "z" * 3001: 3000, "z" * 2999 + "y": 25}
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 7, "x")], "word string, n bigint, form string")
    for shard, group in ((1 << 20, 4 << 20), (200, 500)):
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.spelling_variants(rows, shard_bytes=shard, group_bytes=group).collect()}
        assert got == plain_variants(counts)
    assert variants.spelling_variants(rows.limit(0)).count() == 0


def test_word_counts_of_hostile_rows(spark):
    texts = ["Éclair ÉCLAIR éclair abcdefG abcdefg", None, "", "x" * 5, "ß" * 7 + "1" + "Words Words", "İstanbul " + "longer " * 3000, "déjà-vus naïveté×÷þ"]
    rng = random.Random(1)
    texts += [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(5, 8))) for _ in range(300)) for _ in range(40)]
    rows = [(i, t, i) for i, t in enumerate(texts)] * 2 + [(None, "nullified words", 0)] * 6
    want = {}
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                want[w] = want.get(w, 0) + 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word bigint")
    assert {r.word: r.n for r in variants.word_counts(df).collect()} == {w: n for w, n in want.items() if n >= 5}
    assert variants.word_counts(df.limit(0)).count() == 0


def plain_repeats(rows, window):
    """Ranges of later windows: rows as (id, text) in document order."""
    seen, out = set(), []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = True
            seen.add(key)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        out.append((len(w), edge, hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def passages_table():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "naïve x", "A", "a"]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, line, copied = fresh(60), fresh(10), fresh(400)
    texts = [" ".join(fresh(rng.randint(0, 60)) + common[rng.randint(0, 30) :] + fresh(rng.randint(0, 80)) + line) for _ in range(40)]
    near = [" ".join(copied[:i] + ["changed"] + copied[i:]) for i in range(0, 400, 23)]
    odd = ["spam " * 500, "spam " * 19, "spam " * 20, "a b c " * 100, "\n".join(fresh(30)) + "\t", None, "", "  ", " ".join(common), " ".join(common).replace(" ", "\n"), " ".join(line * 2), " ".join(line * 5).upper(), " ".join(fresh(5000) + copied + fresh(20))]
    texts += near + odd + [texts[0]] * 3 + [near[0]] * 4
    rng.shuffle(texts)
    return texts


def test_substring_dedup(spark):
    texts = passages_table()
    df = spark.createDataFrame([(i, t, f"x{i}", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, extra string, block int").repartition(5)
    want = plain_repeats(list(enumerate(texts)), 20)
    for block, chunk in ((300_000, 1024), (700, 40)):
        got = {r.doc_id: r for r in substring_dedup.substring_dedup(df, ["doc_id", "extra"], block_words=block, chunk=chunk).select("d.*", "n_words", "ranges", "kept_sha256").collect()}
        assert {i: (r.n_words, r.ranges, r.kept_sha256) for i, r in got.items()} == dict(enumerate(want))
        assert all(r.extra == f"x{i}" for i, r in got.items())
    for i, t in enumerate(texts):
        assert hashlib.sha256(substring_dedup.kept_text(t or "", want[i][1]).encode()).hexdigest() == want[i][2]


def test_substring_dedup_of_odd_rows(spark):
    """Null ids come first, repeated rows are one document, an empty table gives no rows."""
    long = " ".join(f"p{i}" for i in range(50))
    df = spark.createDataFrame([(None, long), (7, long), (7, long), (8, None), (9, "own " + long), (9, "own " + long)], "doc_id bigint, text string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.ranges) for r in substring_dedup.substring_dedup(df, ["doc_id"]).select("d.doc_id", "n_words", "ranges").collect())
    assert got == [((False, 0), 50, []), ((True, 7), 50, [0, 50]), ((True, 7), 50, [0, 50]), ((True, 8), 0, []), ((True, 9), 51, [1, 51]), ((True, 9), 51, [1, 51])]
    assert substring_dedup.substring_dedup(df.limit(0), ["doc_id"]).count() == 0


def test_texts_in_pieces(monkeypatch):
    """Digests and hashes don't depend on where a long text is cut."""
    rng = random.Random(4)
    text = " ".join("x" * rng.choice([1, 2, 3, 40]) + str(rng.randint(0, 99)) for _ in range(2000)).encode()
    gone = [3, 10, 500, 501, 1200, 1990]
    want = substring_dedup.joined_sha(text, gone), substring_dedup.hashed(text)[0].tolist(), substring_dedup.hashed(text)[1].tolist()
    kept = [w for i, w in enumerate(text.split()) if not any(a <= i < b for a, b in zip(gone[::2], gone[1::2]))]
    assert want[0] == hashlib.sha256(b" ".join(kept)).digest()
    for step in (7, 64, 1000):
        monkeypatch.setattr(substring_dedup, "STEP", step)
        assert (substring_dedup.joined_sha(text, gone), substring_dedup.hashed(text)[0].tolist(), substring_dedup.hashed(text)[1].tolist()) == want


def plain_lloyd(ids, vectors, k, rounds):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"3:{'null' if ids[i] is None else ids[i]}".encode()).hexdigest(), vectors[i]))[:k]
    centers = [vectors[i] for i in order]
    near = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for v in vectors]
    for _ in range(rounds):
        got = near()
        for j in range(len(centers)):
            own = [v for v, (_, a) in zip(vectors, got) if a == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    return near(), centers


@pytest.mark.parametrize("kind", ["ties", "spread"])
def test_centroids(spark, kind):
    rng = random.Random(6)
    value = (lambda: rng.choice([-1, 0, 1]) / 1024) if kind == "ties" else (lambda: rng.gauss(0, 3))
    rows = [(i % 150, [value() for _ in range(64)]) for i in range(200)]
    rows += [(i, v) for i, v in rows[:60]] * 3 + [(None, [0.5] * 64)] * 2  # repeated rows, a null id
    bad = [(900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [0.5] * 63 + [float("nan")]), (904, [float("-inf")] + [0.5] * 63), (905, [])]
    df = spark.createDataFrame([(i, v, 1.5) for i, v in rows + bad], "vec_id bigint, embedding array<double>, v double")
    seeds = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    found, centers = centroids.cluster_vectors(df, ["vec_id", "v"], seeds)
    whole = [[int(np.floor(1024 * x)) for x in v] for _, v in rows]
    want, plain = plain_lloyd([i for i, _ in rows], whole, 8, 10)
    assert centers.tolist() == plain
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.select("d.vec_id", "cluster", "distance").collect()), key=key) == sorted(((i, a, d) for (i, _), (d, a) in zip(rows, want)), key=key)
    full = centroids.with_inertia(found, centers).collect()
    assert {r.inertia for r in full} == {sum(d for d, _ in want)} and len(full) == len(rows)


def test_centroids_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64), (2, [1.0] * 64)], "vec_id bigint, embedding array<float>")
    found, centers = centroids.cluster_vectors(df, ["vec_id"], F.col("vec_id"))
    assert len(centers) == 3 and sorted((r.d.vec_id, r.distance) for r in found.collect()) == [(1, 0), (2, 0), (2, 0)]
    found, centers = centroids.cluster_vectors(df.limit(0), ["vec_id"], F.col("vec_id"))
    assert centroids.with_inertia(found, centers).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(df.select("vec_id", F.expr("transform(embedding, x -> cast(1e9 as double))").alias("embedding")), ["vec_id"], F.col("vec_id"))


def test_bounds_skip_and_stay_exact():
    rng = np.random.default_rng(0)
    means = rng.integers(-20000, 20000, (8, 64))
    v = (means[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 64))).astype(np.int64)
    c = v[:8].copy()
    a, upper, lower, old, computed = np.zeros(3000, np.int32), np.full(3000, np.inf), np.zeros((3000, 8)), None, 0
    for _ in range(10):
        if old is not None:
            upper, lower = centroids.moved(a, upper, lower, old, c)
        a, upper, lower, n = centroids.assign(v, a.copy(), upper, lower, c, centroids.between(c))
        computed += n
        exact = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (a == exact.argmin(1)).all()  # argmin takes the first of equals
        d = np.sqrt(exact.astype(float))
        assert (upper >= d[np.arange(3000), a]).all() and (lower <= d).all()
        old, c = c, np.array([v[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(8)])
    assert computed < 10 * 3000 * 8 / 3


def test_findings_before_the_first_update(spark, tmp_path):
    from seqnet.llm import secrets

    rows = spark.createDataFrame([(1, "password = abcdefabcdef12"), (2, None)], "doc_id bigint, text string")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    assert [(r.d.doc_id, r.found) for r in ledger.findings(rows).orderBy("d.doc_id").collect()] == [(1, []), (2, [])]
    ledger.update(rows)
    assert [len(r.found) for r in ledger.findings(rows).orderBy("d.doc_id").collect()] == [1, 0]

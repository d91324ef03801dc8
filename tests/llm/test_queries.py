"""Registered queries of the corpus operators and the pipeline, on the driver's smallest tables and on small tables, against DuckDB or brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqnet.llm import bpe, langid, queries, quality_model, secrets

from .test_ops import plain_base, words

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def result(spark, name):
    return queries.QUERIES[next(q for q in queries.QUERIES if q.startswith(f"{name}_"))](spark, DIR)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    df, want = queries.QUERIES[name](spark, DIR), con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=repr) and got


def groups_of(texts):
    """Smallest key of each text's group, and the size of its set, by comparing all pairs."""
    sets, up = {}, {k: k for k in texts}
    for k, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}, {k: len(s) for k, s in sets.items()}


@needs_tables
def test_op3(spark, docs):
    group, size = groups_of({k: r.text for k, r in docs.items()})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, "op3").collect()} == {k: (size[k], group[k]) for k in docs}


@needs_tables
def test_op4(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    for r in result(spark, "op4").collect():
        ids = lib.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(lib.decode(ids, skip_special_tokens=False)))


@needs_tables
def test_op5(spark, docs):
    for r in result(spark, "op5").collect():
        base = plain_base(docs[r.doc_id].text or "")
        said = [f"{k}:{i}:{j}" for k, i, j in base]
        assert r.base_sha256 == sha(",".join(said)) and set(said) <= set(r.spans.split(",") if r.spans else [])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@needs_tables
def test_op6(spark, docs):
    for r in result(spark, "op6").collect():
        base = plain_secrets((docs[r.doc_id].text or "").replace("ſ", "_"))
        said = [f"{k}:{i}:{j}" for k, i, j in base]
        assert r.base_sha256 == sha(",".join(said)) and set(said) <= set(r.spans.split(",") if r.spans else [])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))


def test_op6_base_brute_force():
    r = random.Random(16)
    bits = ["password", "PassWd", "api_key", "apikey", "TOKEN", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123", "0123456789abcdef", "aB3+/_.=-x", "é", "\n"]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert [s for s in secrets.scan_text(t) if s[0] in secrets.BASE] == plain_secrets(t), t


def test_op6_scans_only_what_is_new(spark, tmp_path):
    """Versions of files: only contents that no earlier run has seen are scanned, with new rules all are, and every path gets its findings."""
    secret = "token = abcdefghijklmnop"
    first = spark.createDataFrame([("a", 1, secret), ("b", 1, "nothing"), ("c", 1, secret), ("d", 1, None), ("d", 1, "")], "path string, version int, text string")
    second = first.unionByName(spark.createDataFrame([("a", 2, "password: 0123456789abc"), ("b", 2, "nothing"), ("e", 2, secret)], first.schema))
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    scanned = lambda: ledger.read().groupBy("version").count().collect()
    ledger.update(first)
    assert {r["version"]: r["count"] for r in scanned()} == {"1": 3}  # three distinct contents
    assert [r.found for r in secrets.scan_unseen(second, ledger.read()).collect()] and secrets.scan_unseen(second, ledger.read()).count() == 1
    ledger.update(second)
    assert {r["version"]: r["count"] for r in scanned()} == {"1": 4}
    ledger.update(second)
    assert {r["version"]: r["count"] for r in scanned()} == {"1": 4}
    ledger.update(second, "2")
    assert {r["version"]: r["count"] for r in scanned()} == {"1": 4, "2": 4}
    hits = sorted((r.d.path, r.d.version) for r in ledger.findings(second).where("size(found) > 0").collect())
    assert hits == [("a", 1), ("a", 2), ("c", 1), ("e", 2)]


@needs_tables
def test_op7(spark, docs):
    rows, load, slots, shards = result(spark, "op7").collect(), Counter(), {}, {}
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        shards.setdefault(docs[r.doc_id].text, set()).add(r.shard)
    assert len(rows) == len(docs) and all(len(s) == 1 for s in shards.values()) and set(load) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.01 * sum(load.values())


@needs_tables
def test_op8_brute_force(spark, docs):
    """Scores of a model that is counted and looked up in plain Python."""
    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in docs}
    count = {}
    for t, lang in sorted({(r.text, r.lang) for k, r in docs.items() if not held[k] and r.lang is not None and r.text is not None} | set()):
        n = sum(r.text == t and r.lang == lang and not held[k] for k, r in docs.items())
        for w, c in Counter(langid.LETTERS.findall(t.lower())).items():
            count.setdefault(w, Counter())[lang] += c * n
    langs = sorted({v for c in count.values() for v in c})

    def logs(table):
        total = {v: sum(c[v] for c in table.values()) for v in langs}
        return {w: np.array([math.log((c[v] + 0.1) / (total[v] + 0.1 * len(table))) for v in langs]) for w, c in table.items()}

    known, parts = logs(count), {}
    for n in range(1, langid.MAX_N + 1):
        table = {}
        for w, c in count.items():
            for g in {*langid.grams(w, n)}:
                table.setdefault(g, Counter()).update({v: 1 for v in c})
        parts[n] = logs(table)

    def score(w):
        if w in known:
            return known[w]
        for n in range(langid.MAX_N, 0, -1):
            found = [parts[n][g] for g in langid.grams(w, n) if g in parts[n]]
            if found:
                return sum(found) / len(found) - langid.SKIP * (langid.MAX_N - n + 1)
        return np.zeros(len(langs))

    right = total = 0
    for r in result(spark, "op8").collect():
        w = langid.LETTERS.findall((docs[r.doc_id].text or "").lower())
        assert r.held_out == held[r.doc_id]
        if not w:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        s = sum(score(x) for x in w)
        p = np.exp((s - s.max()) / math.sqrt(len(w)))
        assert r.lang_pred == langs[int(s.argmax())] and abs(r.score - p.max() / p.sum()) < 1e-3
        if r.held_out and docs[r.doc_id].lang is not None:
            right, total = right + (r.lang_pred == docs[r.doc_id].lang), total + 1
    assert right >= 0.9 * total > 0


@needs_tables
def test_op10_brute_force(spark, docs):
    """The compiled rules against the rules one by one."""
    whole, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    held = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in docs}
    rules, weights, intercept = quality_model.train(whole.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1), labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    right = total = 0
    for r in result(spark, "op10").collect():
        x = quality_model.features(docs[r.doc_id].text)
        on = sum(w for rule, w in zip(rules, weights) if all(x[j] <= at if op == "<=" else x[j] > at for j, op, at in rule))
        want = 1 / (1 + math.exp(-(on + intercept)))
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == held[r.doc_id]
        if r.held_out and quality.get(r.doc_id) in (0, 1):
            right, total = right + (r.predicted == quality[r.doc_id]), total + 1
    assert right >= 0.8 * total


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = SCHEMA + ", k long, g string, d string, t string, h string, host string, n int"


def test_models_on_odd_rows(spark):
    """Language, quality and secrets with long and repeated texts, ties, null ids and clashing columns."""
    r = random.Random(17)
    rows = [(i, words(r, 30), "en" if i % 2 else "fr", "s", 0, 1, "g", "d", "t", "h", "host", 1) for i in range(40)]
    rows += [(40, words(r, 40_000), "en", "s", 0, *[None] * 7), rows[3], rows[3], (None, words(r, 30), "en", None, None, *[None] * 7), (41, "qqq zzz", None, None, None, *[None] * 7), (42, None, *[None] * 10), (43, "token = abcdefghijklmnop", *[None] * 10), (43, "token = abcdefghijklmnop", *[None] * 10)]
    odd = spark.createDataFrame(rows, ODD)
    model = langid.train(odd)
    got = langid.predict(odd, model, ["doc_id", "n", "t"]).collect()
    assert len(got) == len(rows) and len({(x.lang_pred, x.score) for x in got if x.d.doc_id == 3}) == 1
    tie = langid.train(spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string"))
    assert langid.predict_text(langid.Scores(tie), "same words") == ("a", 0.5) and langid.predict_text(langid.Scores(tie, 1), "words same")[0] == "a"
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 0), (None, 1), (2, 7)], "doc_id long, quality int")
    scored = quality_model.score(odd, quality_model.train(odd, labels), ["doc_id", "n", "t"]).collect()
    assert len(scored) == len(rows) and len({x.score for x in scored if x.d.doc_id == 3}) == 1 and all(0 <= x.score <= 1 for x in scored)
    found = secrets.join_findings(odd, secrets.scan_unseen(odd)).collect()
    assert len(found) == len(rows) and [len(x.found) for x in found if x.d.doc_id == 43] == [1, 1]


# ---- the pipeline

def without_frequent(rows):
    """Rows {doc_id: (text, source)} that the quality rules keep, with their texts."""
    norm = lambda s: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), s))).strip(" ")
    hosts, seen = {}, {}
    for t, h in {v for v in rows.values() if v[0] is not None}:
        hosts[h] = hosts.get(h, 0) + 1
        for x in {norm(x) for x in t.split("\n") if WORD.search(x)}:
            seen[h, x] = seen.get((h, x), 0) + 1
    above = {k for k, n in seen.items() if n > 50 and n > 0.1 * hosts[k[0]]}
    out = {}
    for k, (t, h) in rows.items():
        w = WORD.findall(t or "")
        three = Counter(zip(w, w[1:], w[2:]))
        repeat = len({j for i in range(len(w) - 2) if three[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)})
        lost = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x) and (h, norm(x)) in above)
        if len(w) >= 50 and 100 * repeat <= 50 * len(w) and len(w) - lost >= 0.5 * len(w):
            out[k] = "\n".join(x for x in t.split("\n") if (h, norm(x)) not in above)
    return out


def without_repeats(texts, least=50):
    first, runs = {}, []
    for k in sorted(texts):
        lines = texts[k].split("\n")
        n = [len(WORD.findall(x)) for x in lines]
        ce = [*itertools.accumulate(n)]
        cs = [e - x for e, x in zip(ce, n)]
        for p in range(len(lines)):
            ahead = [i for i in range(len(lines)) if cs[p] <= cs[i] <= cs[p] + least - 1]
            back = [i for i in range(len(lines)) if ce[p] - least + 1 <= ce[i] <= ce[p]]
            if max(ce[i] for i in ahead) - cs[p] >= least:
                runs.append((0, k, p, max(ahead), p, max(ahead), "\n".join(lines[p : max(ahead) + 1])))
            if ce[p] - min(cs[i] for i in back) >= least:
                runs.append((1, k, min(back), p, p, p, "\n".join(lines[min(back) : p + 1])))
    for kind, k, a, _, _, _, t in runs:
        first[kind, t] = min(first.get((kind, t), (k, a)), (k, a))
    gone = {(k, p) for kind, k, a, _, lo, hi, t in runs if (k, a) > first[kind, t] for p in range(lo, hi + 1)}
    out = {}
    for k, t in texts.items():
        lines = t.split("\n")
        left = "\n".join(x for p, x in enumerate(lines) if (k, p) not in gone)
        if all((k, p) not in gone for p in range(len(lines))) or WORD.search(left):
            out[k] = left
    return out


def contaminated(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    have = f" {' '.join(norm(text))} "
    for t in items:
        w = norm(t)
        if any(f" {' '.join(w[i : i + 10])} " in have for i in range(max(1, len(w) - 9) if w else 0)):
            return True
    return False


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables with boilerplate of a host, repeated passages, near and exact copies, benchmark passages, junk."""
    r = random.Random(18)
    text = lambda n: "\n".join(words(r, r.randint(6, 14)) for _ in range(n))
    rows = [(i, f"Share this {10 + i} page with us\n{text(9)}", "en", "host", 0) for i in range(70)]
    passage, item = "\n".join(words(r, 12) for _ in range(6)), words(r, 25)
    rows += [(100 + i, f"{text(5)}\n{passage}\n{text(4)}", "en", f"s{i % 3}", 0) for i in range(8)]
    rows += [(200 + i, rows[i][1], "fr", "host", 0) for i in range(4)]
    for i in range(12):
        w = rows[30 + i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((300 + i, " ".join(w), "en", "other", 0))
    rows += [(400, f"{text(6)}\n{item.upper()}\n{text(4)}", "en", "s0", 0), (401, f"{text(6)} {' '.join(item.split()[3:12])} {text(4)}", "en", "s0", 0)]
    rows += [(500, "short", "en", "s1", 0), (501, "again and again " * 60, "en", "s1", 0), (502, "", None, None, None), (503, None, None, None, None)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, [item]


def test_pipeline_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    d, rows, items = corpus
    steps, docs = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, d), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    want = without_frequent({r[0]: (r[1], r[3]) for r in rows})
    assert steps["quality_rules"] == want and not any("share this" in want[k].lower() for k in range(70)) and len(want) == 96
    want = without_repeats(want)
    assert steps["line_dedup"] == want
    group, _ = groups_of(want)
    want = {k: t for k, t in want.items() if group[k] == k}
    assert steps["ngram_join"] == want
    want = {k: t for k, t in want.items() if not contaminated(t, items)}
    assert steps["decontaminate"] == want and 400 not in want and 401 in want
    lib = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert got.keys() == want.keys()
    for k, t in want.items():
        assert got[k].ids == lib.encode(t, add_special_tokens=False).ids and got[k].n_tokens == len(got[k].ids)


def test_pipeline_on_odd_rows(spark, tmp_path):
    r = random.Random(19)
    rows = [(1, words(r, 80), "en", None, None, *[None] * 7), (None, words(r, 80), None, "s", 1, 1, "g", "d", "t", "h", "host", 2), (3, None, *[None] * 10), (4, "", *[None] * 10), (5, words(r, 60_000), "en", "s", 0, *[None] * 7)]
    rows += [rows[0], rows[1], rows[3], (1, words(r, 70), "fr", "s", 0, *[None] * 7)]
    for name, data in (("odd", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, ODD).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for step, f in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stage(f(spark, docs, d), step)
            assert docs.columns == [c.strip().split()[0] for c in ODD.split(",")]
        out = corpus_pipeline.run(spark, d).collect()
        assert sorted(x.doc_id or -1 for x in out) == ([-1, 1, 1, 5] if data else [])

"""Corpus operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, and against brute force."""

import hashlib
import itertools
import json
import os
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqnet.llm import bpe, decontaminate, langid, line_dedup, ngram_join, pii, quality_model, quality_rules, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, g string, d string, h string"


def words(r, n):
    return " ".join(r.choice(["ab", "cde", "fgh", "ij", "klm", "nop", "qr", "stu", "vw", "xyz"]) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [words(r, r.choice([3, 4, 5, 6, 8, 9, 12, 20, 40, 90, 200])) for _ in range(60)]
    near = []
    for t in base * 2:
        w = t.split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    passage = "\n".join(words(r, 12) for _ in range(6))
    block = [f"{words(r, 20)}\n{passage}\n{words(r, 9)}" for _ in range(6)]
    odd = [None, "", " \n ", "x", base[0], base[0], block[0], "one line\n" * 90, "Ünïcode ß Σίσυφος ΣΑΣ 12 token = abcdefghijklmnop a.b@c.de +1 (499) 555-6503", "y " * 30000]
    return base + near + block + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", 0, "k", "g", "d", "h") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null id here", None, None, None, None, None, None, None), (7, "same id other text", "en", None, 0, "", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_join_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    want = sorted((doc if doc is not None else -1, len(sets[i]), least.get(find(i), -1)) for i, (doc, _) in enumerate(rows))
    out = ngram_join.ngram_groups(docs).collect()
    got = sorted((r.k if r.k != ngram_join.NO_ID else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in out)
    assert got == want
    assert ngram_join.ngram_groups(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("text = 'x'").count() == 1 and kept.where("text is null").count() == 1


def test_components_against_union_find(spark):
    r = random.Random(7)
    graphs = [[(1, 4), (4, 3), (3, 5), (5, 2)]]  # a node with two centres after the first round
    for n in (6, 8):
        graphs.append([*itertools.pairwise(r.sample(range(n), n))])
    for _ in range(2):  # two hubs of 20 members that share one
        x = r.sample(range(41), 41)
        graphs.append([(x[0], v) for v in x[2:22]] + [(x[1], v) for v in x[21:41]])
    for links in graphs:
        up = {v: v for e in links for v in e}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        got = [(x.v, x.comp) for x in ngram_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()]
        assert sorted({*got, *((c, c) for _, c in got)}) == sorted((v, find(v)) for v in up) and len({v for v, _ in got}) == len(got)


def test_word_hashes_do_not_depend_on_place_or_block():
    r = random.Random(9)
    some = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    text = "".join(w + r.choice([" ", "\n", "\t ", "\x0b"]) for w in some)
    old, ngram_join.BLOCK = ngram_join.BLOCK, 7
    try:
        cut = ngram_join.word_hashes(text.upper().replace("É", "é").encode())
    finally:
        ngram_join.BLOCK = old
    whole = ngram_join.word_hashes(text.encode())
    assert (cut == whole).all() and len(whole) == len(some) and len({*zip(some, whole.tolist())}) == len({*some}) == len({*whole.tolist()})
    assert not len(ngram_join.word_hashes(b" \n")) and not len(ngram_join.word_hashes(b""))


def test_parity_never_exceeds_the_difference():
    r = np.random.default_rng(3)
    for n in (0, 1, 9, 300, 600, 1100, 5000, 20000):
        a = np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], r.integers(0, 1 << 60, n // 4, dtype=np.uint64)]))
        size, bits = np.array([len(a), len(b)]), [ngram_join.parity(x).tobytes() for x in (a, b)]
        by = np.argsort(size, kind="stable")
        i, _, d = ngram_join.near_pairs(size[by], np.array([1, 2]), np.zeros(2, int), [bits[k] for k in by], False)
        apart = len(np.setxor1d(a, b))
        assert (not len(i) and 9 * apart > len(a) + len(b)) or d[0] <= apart


def test_near_pairs_brute_force():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = np.unique(r.integers(0, 1 << 60, int(r.choice([30, 500, 530, 1000, 4200])), dtype=np.uint64))
        sets += [base, base[r.random(len(base)) < r.choice([0.8, 0.9, 0.97])]]
    sets.sort(key=len)
    n, comp, block = np.array([*map(len, sets)]), r.integers(0, 40, 120), r.integers(0, 2, 120)
    bits = [ngram_join.parity(s).tobytes() for s in sets]
    similar = {(i, j) for i, j in itertools.combinations(range(120), 2) if comp[i] != comp[j] and len(np.intersect1d(sets[i], sets[j])) * 9 >= 4 * (n[i] + n[j])}
    for own in (np.zeros(120, int), block):
        i, j, _ = ngram_join.near_pairs(n, comp, own, bits, False)
        want = {(a, b) for a, b in similar if own is not block or block[a] != block[b]}
        assert want <= {*zip(i.tolist(), j.tolist())} and len(i) <= len(want) + 20
    i, j, _ = ngram_join.near_pairs(n, comp, np.zeros(120, int), bits, True)
    assert len({*j.tolist()}) == len(j) and (n[i] <= n[j]).all()


def counted(monkeypatch):
    """Rows that each scan of lists, and each exact comparison, hands on."""
    made = {}
    for name in ("_scanned", "_linked"):

        def wrapped(*a, f=getattr(ngram_join, name), name=name):
            out = ngram_join.stage(f(*a), "counted")
            made.setdefault(name, []).append(out.count())
            return out

        monkeypatch.setattr(ngram_join, name, wrapped)
    return made


def test_ngram_join_of_many_near_copies(spark, monkeypatch):
    r = random.Random(6)
    origin = words(r, 150).split()
    rows = []
    for i in range(2000):
        w = list(origin)
        w[i % 150] = f"own{i}"
        rows.append((i, " ".join(w)))
    docs, made = spark.createDataFrame(rows, "doc_id long, text string"), counted(monkeypatch)
    assert {x.component_id for x in ngram_join.ngram_groups(docs).collect()} == {0}
    assert max(made["_scanned"]) < 40_000 and sum(made["_linked"]) < 10_000


def test_ngram_join_of_many_texts_with_a_passage(spark, monkeypatch):
    r = random.Random(7)
    passage = words(r, 60)
    docs, made = spark.createDataFrame([(i, passage + " " + " ".join(f"w{r.random()}" for _ in range(25))) for i in range(2000)], "doc_id long, text string"), counted(monkeypatch)
    monkeypatch.setattr(ngram_join, "SAMPLE_DF", 10**9)  # as if no sample had shown the passage to be frequent
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 100)
    assert all(x.component_id == x.k for x in ngram_join.ngram_groups(docs).collect())
    assert sum(made["_scanned"]) < 10_000 and sum(made["_linked"]) == 0


def test_sample_of_any_table(spark):
    from seqnet.llm.common import distinct_sample, some_rows

    docs = spark.range(100_000).selectExpr("id", "'one text' as t")
    assert 200 < some_rows(docs, 300, "id", "t").count() < 400
    assert 200 < some_rows(docs, 3 * 10**8, "id", "t", total=10**11).count() < 400  # no rounding to none
    for k in range(4):  # tables of copies, whatever their hash
        copies = docs.selectExpr("id", f"concat('text ', id % {k + 1}, ' of {k}') as t")
        assert distinct_sample(copies, 300, "t").count() == k + 1
    assert distinct_sample(docs, 300, "id", "t").count() == 300
    assert distinct_sample(docs.limit(0), 300, "id").count() == 0


def test_language_samples_of_copies(spark):
    """Languages learn all their distinct texts, however many copies there are."""
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 'aa', 'bb') as lang", "if(id % 2 = 0, 'einer wort', 'other worte') as text")
    for k in range(3):
        model = langid.train(rows.withColumn("text", F.concat("text", F.lit(f" x{'y' * k}"))), 200)
        assert model["langs"] == ["aa", "bb"] and len(model["words"]) == 5
    many = spark.range(100_000).selectExpr("'aa' as lang", "concat('word', translate(cast(id % 50 as string), '0123456789', 'abcdefghij')) as text")
    assert len(langid.train(many, 60)["words"]) == 50


def test_line_dedup(docs, empty, texts):
    out = {(r.d.doc_id, r.d.text): r for r in line_dedup.line_dedup(docs).collect()}
    assert len(out) == docs.distinct().count()
    block = [i for i, t in enumerate(texts) if t and t.count("\n") == 7]
    assert out[block[0], texts[block[0]]].n_removed == 0
    for i in block[1:6]:
        assert out[i, texts[i]].n_removed == 6 and out[i, texts[i]].clean.count("\n") == 1
    copies = [r for r in out.values() if r.d.text == texts[block[0]]]
    assert sorted(r.n_removed for r in copies) == [0, 8]
    many = next(r for r in out.values() if r.d.text and r.d.text.startswith("one line"))
    assert many.n_lines == 91 and 60 < many.n_removed < 91
    assert next(r for r in out.values() if r.d.text is None).clean is None
    assert line_dedup.line_dedup(empty).count() == 0


def test_decontaminate(spark, docs, empty, texts, monkeypatch):
    w = texts[50].split() if len(texts[50].split()) >= 12 else next(t for t in texts if t and len(t.split()) >= 40).split()
    bench = spark.createDataFrame([(1, " ".join(w[:12])), (2, "zz yy"), (3, None), (4, ""), (5, " ".join(w[:12]))], "item_id long, text string")
    out = decontaminate.contamination(docs, bench, ["doc_id", "text"]).collect()
    assert len(out) == docs.count()
    for r in out:
        have = " " + " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", r.d.text or "")) + " "
        hits = [i for i in range(3) if " " + " ".join(w[i : i + 10]) + " " in have]
        assert r["items"] == (["1", "5"] if hits else [])
    hit = next(r for r in out if r["items"] and r.ranges[1] - r.ranges[0] == 12)
    lo, hi = decontaminate.spans(hit.d.text, hit.ranges)[0]
    assert hit.d.text[lo:hi].split() == w[:12]
    key = lambda r: (r.d.doc_id or -1, r.n_words, r.ranges, r["items"])
    for nodes in (300, 120):  # several blocks, and input in another order
        monkeypatch.setattr(decontaminate, "MOST_NODES", nodes)
        again = decontaminate.contamination(docs.repartition(5, "text"), bench, ["doc_id"]).collect()
        assert sorted(map(key, again)) == sorted(map(key, out))
    assert decontaminate.contamination(empty, bench, ["doc_id"]).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0), ["doc_id"]).where("size(ranges) > 0").count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    for r in bpe.encode(docs).collect():
        ids = lib.encode(r.d.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.encode(empty).count() == 0
    e = bpe.encoder(bpe.default_path())
    r = random.Random(12)
    some = ["a<|endoftext|>b", "x\x1cy", "q" * 5000, "é é ́", "it's I'LL", "''s 'S'd -'s x''", "ÀÉ×÷ß µª¿Ÿÿ", "ab12c,d!!e"]
    some += ["".join(r.choice("aBcde'stlmvrd 019,.!-é×ÉßÿŸ\u0301\u00b5ǅ漢\n") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    some += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (99, 100, 101, 102, 400)]
    for small in (False, True):
        e.chunks = bpe.Chunks(e.chunk, 3000 if small else bpe.CACHE_BYTES)
        for t in some:
            b = e.encode(t)
            ids = lib.encode(t, add_special_tokens=False).ids
            assert [*struct.unpack(f"<{len(b) // 4}I", b)] == ids and e.decode(b) == lib.decode(ids, skip_special_tokens=False)
    assert len(e.chunks) + len(e.chunks.old) < 40
    e.chunks = bpe.Chunks(e.chunk, bpe.CACHE_BYTES)


def test_bpe_in_batches(spark, monkeypatch):
    """Texts of a batch are cut together, but never across texts, and new words take a fraction of what they take one by one."""
    import time

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    e = bpe.encoder(bpe.default_path())
    r = random.Random(31)
    some = ["it'", "s", "it'r", "e", "", None, "'", "'s", "caf", "\u0301e", "a\u0301", "\u0301", "É", "×", " ", "x<|endoftext|>", "<|startoftext|><|endoftext|>y", "<|endof", "text|>", "A\u2003B\u00a0C\x85d", "\x00\x1f '\x1d"]
    some += ["".join(r.choice("aB'sTrev lL0 É×\u0301µ漢\u2028\n\x1c") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in some]
    for block, merged in ((bpe.BLOCK, bpe.MERGED), (20, 5)):  # the second cuts all texts at white space and merges few pieces at once
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "MERGED", merged)
        ids, ends = e.encode_all(pa.array(some).slice(1))
        assert [ids[i:j].tolist() for i, j in zip([0, *ends], ends)] == want[1:]
    monkeypatch.undo()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string").coalesce(1)
    assert {x.d.doc_id: x.ids for x in bpe.encode(rows).collect()} == dict(enumerate(want))

    vocab, merges = (spec := json.load(open(bpe.default_path(), encoding="utf-8"))["model"])["vocab"], spec["merges"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(6, 14))) for _ in range(40_000)]
    began = time.process_time()
    plain = []
    for w in words:
        s = [*w[:-1], w[-1] + "</w>"]
        while len(s) > 1 and (least := min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(s, s[1:]))))[0] < 1 << 30:
            s[least[1] : least[1] + 2] = [s[least[1]] + s[least[1] + 1]]
        plain += [vocab[x] for x in s]
    plainly, began = time.process_time() - began, time.process_time()
    got = e.encode(" ".join(words))
    assert [*struct.unpack(f"<{len(got) // 4}I", got)] == plain and time.process_time() - began < plainly / 2


def test_pii(docs, empty):
    model = pii.train(["some text to write numbers into, and more of it"], steps=3)
    out = pii.find(docs, model, ["doc_id", "text"]).collect()
    assert len(out) == docs.count()
    odd = next(r for r in out if r.d.text and "a.b@c.de" in r.d.text)
    assert [(s.kind, odd.d.text[s.start : s.stop]) for s in odd.base] == [("email", "a.b@c.de"), ("phone", "+1 (499) 555-6503")]
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.found} for r in out)
    assert pii.find(empty, model, ["doc_id"]).count() == 0


def plain_base(t):
    """The base kinds as their patterns say, one regular expression each."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(digits(m[0])[::-1])) % 10 == 0]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_brute_force():
    r = random.Random(14)
    texts = ["x@y @z.w a@b.c@d.e 1.2.3.4.5.6.7.8 999.1.1.1 4000 0000 0000 0002 +12345"]
    texts += ["".join(r.choice("12.@+- ()aZ_%é\n4") for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += [" ".join(pii.made_up(np.random.default_rng(k), pii.KINDS[k % 4]) + r.choice(["", ".", "7", "@x.y"]) for _ in range(2)) for k in range(400)]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t


def test_pii_reads_whole_spans():
    r = random.Random(8)

    class Marker:
        """Tags as email whatever isn't '#'."""

        def scores(self, x):
            out = np.zeros((*x.shape, pii.TAGS), np.float32)
            out[..., 2] = np.where((x == pii.SYMBOLS.index("#")) | (x == pii.PAD), -1, 1)
            return out

        def decode(self, s):
            return s.argmax(2)

    fill = "#" * 500
    for s in ("jo.miller at host dot com", "JO(at)host(DOT)com", "a" * 150 + "@" + "b" * 150 + ".com", "dot.com" + "x" * 300 + " At y"):
        for n in (0, 1, 15, 16, 60, 79, 80, 81, 95, 96, 97, 300):
            assert pii.network_spans(Marker(), [fill[:n] + s + fill]) == pii.network_spans(Marker(), [fill[:n] + s + fill], 1) == [[("email", n, n + len(s))]]
            assert pii.network_spans(Marker(), [fill[:n] + s]) == [[("email", n, n + len(s))]]
    # as if every window were read
    texts = ["##".join(r.choice([words(r, 9), "plain words at noon", "jo at host dot com", "a(at)b(dot)org", "+1 499 555 6503", "10 . 2 . 3 . 4"]) for _ in range(40)) for _ in range(30)]
    got, old = pii.network_spans(Marker(), texts), pii.hints
    try:
        pii.hints = lambda c: np.arange(len(c))
        assert got == pii.network_spans(Marker(), texts) and all(got)
    finally:
        pii.hints = old
    # no other character becomes one of the hint's in lower case
    assert {c for c in map(chr, range(0x110000)) if {*c.lower()} & {*"at()@ "}} == {*"aAtT()@ "}


def test_pii_stretches_in_pieces():
    """A stretch decoded by itself in pieces has the tags it has among others; memory follows the longest text's length, not its product with the number of stretches."""
    import tracemalloc

    rng = np.random.default_rng(3)
    model = pii.Tagger(pii.Tagger.start(rng))
    model.p["T"] = rng.normal(size=(pii.TAGS, pii.TAGS)).astype(np.float32)
    r = random.Random(6)
    text = "".join(r.choice("0123456789 .-@") for _ in range(9000))
    texts = [text, "a1 " * 40, "", "call 12 now " + "x" * 400 + " 7", "9" * 3000]
    assert pii.network_spans(model, texts, cells=150) == pii.network_spans(model, texts)
    codes = pii.coded(text)
    windows = np.stack([codes[f * pii.STRIDE : f * pii.STRIDE + pii.SPAN] for f in range(90)])
    held = dict(enumerate(model.scores(windows)))
    size = 89 * pii.STRIDE + pii.SPAN
    whole = model.decode(pii._stitched([(f * pii.STRIDE, held[f]) for f in range(90)], 0, size, 10**6)[None])[0]
    for piece in (1, 7, 1000):
        assert (pii._long(model, held, 0, 89, size, 10**6, piece) == whole).all()
    big = ["".join(r.choice("0123456789 ") for _ in range(200_000))] + ["12 at 7 " * 20] * 400
    tracemalloc.start()
    pii.network_spans(model, big)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 350e6, peak


def test_pii_gradient():
    rng = np.random.default_rng(0)
    m = pii.Tagger(pii.Tagger.start(rng))
    x, y = pii.labelled(rng, ["some text"], 3)
    _, g = m.step(x, y)
    for k in ("T", "V", "W", "b", "E", "c"):
        for j in (0, -2):
            i = np.unravel_index(np.argsort(np.abs(g[k]).ravel())[j - 1], g[k].shape)
            was = m.p[k][i]
            m.p[k][i] = was + 1e-2
            up = m.step(x, y)[0]
            m.p[k][i] = was - 1e-2
            down = m.step(x, y)[0]
            m.p[k][i] = was
            assert abs((up - down) / 2e-2 - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_pii_learns(spark):
    """Recall and precision of made-up spans that training hasn't seen, by kind, in documents that it hasn't seen."""
    rng = np.random.default_rng(99)
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").select("text").orderBy("doc_id").collect()]
    model = pii.train([t[:2000] for t in prose[:400]])
    test, texts, gold = prose[500:], [], []
    for kind in pii.KINDS:
        for _ in range(200):
            t = test[rng.integers(0, len(test))]
            at = int(rng.integers(0, max(1, len(t) - 400)))
            t, s = t[at : at + 400], pii.made_up(rng, kind)
            cut = max(0, t.find(" ", int(rng.integers(0, max(1, len(t) - 50)))))
            texts.append(f"{t[:cut]} {s} {t[cut:]}")
            gold.append((kind, cut + 1, cut + 1 + len(s)))
    near = [f"{t[:200]} {pii.near_miss(rng)} {t[200:400]}" for t in test[:400]]
    found, other = pii.all_spans(model, texts), pii.all_spans(model, near)
    meets = lambda s, g: s[0] == g[0] and s[1] < g[2] and g[1] < s[2]
    for kind in pii.KINDS:
        own = [k for k, g in enumerate(gold) if g[0] == kind]
        assert sum(any(meets(s, gold[k]) for s in found[k]) for k in own) >= 0.9 * len(own), kind
        # of what the network adds to the base spans of texts
        said = [(s, g) for t, x, g in zip(texts, found, gold) for s in x if s[0] == kind and (meets(s, g) or s not in pii.base_spans(t))]
        wrong = sum(s[0] == kind and s not in pii.base_spans(t) for t, x in zip(near, other) for s in x)
        assert sum(meets(s, g) for s, g in said) >= 0.9 * (len(said) + wrong), kind


def test_secrets(spark, docs, empty, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    ledger.update(docs.limit(10))
    ledger.update(docs)
    assert ledger.read().count() == docs.where("text is not null").select("text").distinct().count()
    out = ledger.findings(docs).collect()
    assert len(out) == docs.count()
    odd = next(r for r in out if r.d.text and "token" in r.d.text)
    assert [(s.kind, odd.d.text[s.start : s.stop]) for s in odd.found] == [("assign", "token = abcdefghijklmnop")]
    assert secrets.scan_unseen(docs, ledger.read()).count() == 0 and secrets.scan_unseen(docs, ledger.read(), "2").count() > 0
    assert secrets.join_findings(empty, ledger.read()).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    same = {}
    for r in docs.collect():
        same.setdefault(r.text, set()).add((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())))
    assert {(r.size, r.text_crc32) for r in rows} == set().union(*same.values())
    assert sharding.shard(empty).count() == 0
    assert {tuple(x) for x in sharding.shard(docs).select("k", "size", "text_crc32", "shard").collect()} == {tuple(x) for x in sharding.shard(docs.repartition(3)).select("k", "size", "text_crc32", "shard").collect()}


def plain_best_fit(sizes, capacity):
    """Loads and the sizes in each bin, by a plain search for the tightest bin."""
    left, held = [], []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in range(len(left)) if left[b] >= s]
        b = min(fit, key=lambda b: (left[b], b)) if fit else len(left)
        if b == len(left):
            left.append(capacity)
            held.append([])
        left[b] -= s
        held[b].append(s)
    return held


def spread(runs):
    held = {}
    for size, lo, hi, b, each in runs:
        for r in range(lo, hi):
            held.setdefault(b + (r - lo) // each, []).append(size)
    return held


def test_best_fit_equals_a_plain_search():
    r = random.Random(1)
    for most, n, capacity in ((60, 300, 100), (7, 500, 50), (120, 200, 100), (5, 40, 4)):
        sizes = [r.randint(1, most) for _ in range(n)]
        classes = [(s, sizes.count(s)) for s in {*sizes}]
        runs, bins = sharding.best_fit(classes, capacity)
        held = spread(runs)
        assert [sorted(held[b]) for b in range(bins)] == [sorted(x) for x in plain_best_fit(sizes, capacity)]
        ranks = {}
        for size, lo, hi, _, _ in runs:
            ranks.setdefault(size, []).extend(range(lo, hi))
        assert all(sorted(ranks[s]) == list(range(c)) for s, c in classes)
        assert sharding.best_fit(classes, capacity, bins - 1) is None and sharding.best_fit(classes, capacity, bins)[1] == bins


def test_shard_equals_plain_best_fit_on_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 50)
    monkeypatch.setattr(sharding, "BUCKET", 8)
    r = random.Random(2)
    texts = ["x" * r.randint(1, 30) + str(r.randint(0, 99)) for _ in range(600)] + ["same"] * 40 + [None] * 3 + ["long" * 40]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + len(t or "") + 1
    rows = sharding.shard(docs, capacity=150).collect()
    held, at = {}, {}
    for x in rows:
        held.setdefault(x.shard, set()).add(texts[x.k])
        at.setdefault(texts[x.k], set()).add(x.shard)
    assert all(len(v) == 1 for v in at.values()) and len(rows) == len(texts)
    want = plain_best_fit([*groups.values()], 150)
    assert [sorted(groups[t] for t in held[b]) for b in range(len(held))] == [sorted(x) for x in want]
    slots = {}
    for x in rows:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_of_a_hot_group(spark):
    for hot in (1 / 5, 1 / 3, 0.9995):
        big = int(500_000 * hot / (1 - hot))
        load = {b: sum(x) for b, x in spread(sharding.pack_into([(500, 1000), (big, 1)], 8)).items()}
        assert load[0] == big and len(load) == 8
        rest = [v for b, v in load.items() if b]
        assert max(rest) - min(rest) <= 500
    assert len(spread(sharding.pack_into([(9, 1), (5, 1), (1, 1)], 8))) == 3 and sharding.pack_into([], 8) == []
    assert spread(sharding.pack_into([(900, 3), (1, 80)], 8)).keys() == {*range(8)}
    # with a group of copies that holds a third of the bytes, and almost all of them
    for copies in (500, 100_000):
        docs = spark.range(1000 + copies).selectExpr("id as doc_id", "if(id < 1000, lpad(string(id), 99, 'x'), repeat('y', 99)) as text")
        load = {x.shard: (x.b, x.g) for x in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b"), F.countDistinct("text_crc32").alias("g")).collect()}
        assert set(load) == set(range(8))
        rest = sorted(load.values())[:-1]
        assert max(load.values()) == (100 * copies, 1) and rest[-1][0] <= 1.05 * rest[0][0]


def test_langid(spark, empty):
    r = random.Random(3)
    en, fr = "the and of with that house water".split(), "le les des avec maison eau être".split()
    rows = [(i, " ".join(r.choices(en if i % 2 else fr, k=12)), "en" if i % 2 else "fr") for i in range(60)] + [(61, None, "en"), (62, "12 !!", "fr"), (63, "houses thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.d.doc_id: x for x in langid.predict(docs, langid.train(docs), ["doc_id"]).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert got[61].lang_pred == got[62].lang_pred == "und" and got[63].lang_pred == "en" and 0 <= got[63].score <= 1
    none = langid.train(empty)
    assert {x.lang_pred for x in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}


def test_quality_rules(docs, empty):
    out = quality_rules.judge(docs)
    assert out.count() == docs.count() and out.where("kept and n_words < 50").count() == 0
    assert quality_rules.apply_rules(docs).columns == docs.columns
    assert quality_rules.judge(empty).count() == 0 and quality_rules.apply_rules(empty).count() == 0
    assert quality_rules.stats("a b c\na b c\n\n#") == (7, 7, 1, 1, 6)


def test_quality_rules_remove_lines(spark):
    r = random.Random(2)
    rows = [(i, f"shared line {i}0 of host\n{words(r, 80)}", "s") for i in range(60)] + [(100, "shared line 7 of host\n" * 30 + words(r, 40), "s"), (101, words(r, 80), "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x.text for x in quality_rules.apply_rules(docs, line_docs=5).collect()}
    assert set(got) == {*range(60), 101} and "shared" not in got[3]  # digits count as equal
    rows = [(i, f"shared line of host\n{words(r, 80)}", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all("shared" not in x.text and len(x.text.split()) == 80 for x in quality_rules.apply_rules(docs, line_docs=5).collect())


def test_quality_classifier(spark, empty):
    r = random.Random(4)
    rows = [(i, words(r, 60) if i % 2 else " ".join(x + "$$$" for x in words(r, 60).split())) for i in range(200)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    got = {x.d.doc_id: x for x in quality_model.score(docs, model, ["doc_id"]).collect()}
    assert sum(got[i].predicted == i % 2 for i in range(150, 200)) >= 48 and 0 <= got[300].score <= 1
    assert 0 < len(model[0]) < 100
    assert quality_model.score(docs, quality_model.train(docs, labels.limit(0)), ["doc_id"]).where(F.col("score") != 0.5).count() == 0
    assert quality_model.score(empty, model, ["doc_id"]).count() == 0

"""Documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and their components.

Equal sets fall into one class first; classes are the nodes. A class gets keys so that two similar classes share one at least:

- tokens are put in one order for all (those a bounded sample shows to be frequent come last, most frequent at the end; any order is right, this one gives short lists);
- similar sets of sizes n <= m share ceil(4 (n + m) / 9) tokens or more, so they share s among the first n - ceil(0.8 n) + s tokens of each, for any s;
- large sets have these tokens as keys, with an s that grows with the set (slack), and are scanned by inverted lists; small sets have all subsets of two tokens of theirs (s = 2) as keys;
- the boundary between small and large is the size at which the sampled cost of both ways is lowest; sets of 0.8 to 1 times the boundary go both ways, so that every pair is covered.

Keys with one class only are dropped, and so are large classes that share fewer than s keys with others. Lists with the same members are one list (a passage that the same texts share is one list, not one for each of
its tokens). Lists are then scanned twice, each time in blocks of bounded length:

- first, each class is linked with the nearest of the classes before it (by size) in its lists, NEAREST pairs for each class at most, where these are similar; a group of near copies becomes a component by that, at a cost in proportion to its members;
- then only lists that still hold several components are scanned, and pairs across components that can be similar are compared exactly. Long lists are dealt as pairs of blocks. Nothing is dropped or capped.

Scans use a parity bitmap of each class, as many bits as it has tokens (512 to 4096): each token flips one bit, so two bitmaps differ in no more bits than there are tokens in only one of the sets. Two sets of n and m tokens are
similar only if these are (n + m) / 9 at most; a pair whose bitmaps differ in more bits is told apart where the list is scanned, and never becomes a row. What stays quadratic is the number of bitmap comparisons in a list of texts that
share a rare token and belong to different components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, documents, pieces, row_key, some_rows, stage

SHINGLE = 5
#: Rows of the sample that sets the order of tokens and the boundary; neither has a bearing on the result.
SAMPLE_ROWS = 4000
#: A token is frequent if so many rows of the sample have it.
SAMPLE_DF = 4
#: Members of a list that are scanned together; longer lists are dealt in blocks of about so many.
BLOCK_ROWS = 512
#: Lists of one class or component are scanned in so many tasks (they share many pairs, which are then told once a task).
HOMES = 16
#: Pairs of a class in the first scan.
NEAREST = 4
#: Bits of a parity bitmap: the power of two not below the number of tokens, within these.
LEAST_BITS, MOST_BITS = 512, 4096
#: Logarithm of the bits in the bitmap of rows whose sets are needed again.
BITS = 27

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


#: A random number for each byte, A-Z as a-z, and the bytes that separate words.
_LETTER = np.array([int.from_bytes(hashlib.blake2b(bytes([b]).lower(), digest_size=8).digest(), "little") for b in range(256)], np.uint64)
_BLANK = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
#: Bytes hashed at once, but for longer words.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        while len(_powers[i]) < n:
            p = _powers[i]
            _powers[i] = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    return _powers


def _block_words(raw: np.ndarray) -> np.ndarray:
    n = len(raw)
    power, inverse = _grown(n + 1)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[raw] * power[:n], out=total[1:])
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _M[1])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text: polynomials of their bytes, as differences of one running sum."""
    raw, at, out = np.frombuffer(text, np.uint8), 0, []
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        if end < len(raw):  # cut at the last blank, or after a word that is longer than a block
            blanks = np.flatnonzero(_BLANK[raw[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                blanks = np.flatnonzero(_BLANK[raw[end:]])
                end = end + int(blanks[0]) + 1 if len(blanks) else len(raw)
        out.append(_block_words(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """60-bit hashes of the shingles of a text, in order."""
    h = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
    n = len(h)
    if not n:
        return h
    if n < size:
        whole = np.array([n], np.uint64)
        for i in range(n):
            whole = _mix(whole * _M[i] + h[i : i + 1])
        return whole >> np.uint64(4)
    s = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        s = _mix(s * _M[i % 5] + h[i : n - size + 1 + i])
    return s >> np.uint64(4)


def ordered(tokens: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Distinct tokens in the common order: the four highest bits hold how frequent the sample shows them to be."""
    if len(common) and len(tokens):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        tokens = np.where(common[at] == tokens, tokens | (level[at] << np.uint64(60)), tokens)
    return np.unique(tokens)


def slack(n: int) -> int:
    """Tokens that two large sets must share among their keys, the smaller with n tokens."""
    return 1 + n // 20


def prefix(n: int, more: int = 0) -> int:
    return min(n, n - -(-4 * n // 5) + 1 + more)


def keys(tokens: np.ndarray, bound: int) -> np.ndarray:
    n = len(tokens)
    if n < 4:  # no other set is similar
        return np.empty(0, np.uint64)
    out = []
    if n <= bound:
        p = tokens[: prefix(n, 1)]
        i, j = np.triu_indices(len(p), 1)
        out.append(_mix(_mix(p[i] * _M[3]) + p[j]) | np.uint64(1))
    if 5 * n >= 4 * bound:
        out.append(_mix(tokens[: prefix(n, slack(n) - 1)] * _M[4]) & ~np.uint64(1))
    return np.concatenate(out)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_long(np.concatenate([np.empty(0, np.uint64), *arrays]))))


def _sampled(docs: DataFrame, id_col: str, text_col: str, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent tokens of a sample, their levels, and the boundary. The sample has about ``rows`` rows, whatever the table's size."""

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([_lists([np.unique(shingles(t.as_py())) for t in b.column("t")])], ["s"])

    part = some_rows(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), rows, "i", "t")
    sets = stage(part.select("t").mapInArrow(each, "s array<bigint>").where("size(s) > 0"), "sample")
    top = sets.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c")).where(F.col("c") >= SAMPLE_DF).toPandas()
    common = top["x"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(common)
    common, count = common[by], top["c"].to_numpy(np.int64)[by]
    level = np.minimum(15, np.log2(np.maximum(count, 1)).astype(np.int64) + 1).astype(np.uint64)
    sizes = sets.select(F.size("s").alias("n")).groupBy("n").count().toPandas()
    return common, level, boundary(sizes["n"].to_numpy(), sizes["count"].to_numpy())


def boundary(n: np.ndarray, count: np.ndarray, list_cost: float = 2.0) -> int:
    """The size up to which subsets of two cost less than inverted lists: a row for each subset, against a row for each token and list_cost comparisons more for its less selective list."""
    best, at = None, 3
    for x in sorted({3, *(int(v) for v in n if v <= 200)}):
        small, large = n <= x, 5 * n >= 4 * x
        p = np.array([prefix(int(v), 1) for v in n])
        cost = float((count * p * (p - 1) / 2)[small].sum() + (1 + list_cost) * (count * np.maximum(p - 1, 1))[large].sum())
        if best is None or cost < best:
            best, at = cost, x
    return at


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bits that an odd number of tokens fall on, as 64-bit words. A bitmap of half as many bits is one half against the other."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length())) if len(tokens) else LEAST_BITS
    odd = np.bincount((_mix(tokens * _M[0]) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _signed(rows: DataFrame, shared, bound: int) -> DataFrame:
    """Rows k, g, t as k, g, n, cls, keys and bits (parity)."""

    def each(batches):
        common, level = shared.value
        for whole in batches:
            for b in pieces(whole):
                sets = [ordered(shingles(t.as_py()), common, level) for t in b.column("t")]
                bits = pa.array([parity(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("g"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), _lists([keys(s, bound) for s in sets]), bits], ["k", "g", "n", "cls", "keys", "bits"])

    return rows.mapInArrow(each, "k bigint, g bigint, n bigint, cls bigint, keys array<bigint>, bits binary")


def class_of(tokens: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def bitmap(rows: DataFrame) -> np.ndarray:
    """A bit for a hash of each (k, g). Its size is fixed (16 MB), whatever the number of rows; the more rows, the more others it lets pass."""
    bit = F.pmod(F.xxhash64("k", "g"), F.lit(1 << BITS))
    words = rows.select(bit.alias("bit")).selectExpr("cast(bit div 64 as int) as w", "shiftleft(1L, cast(bit % 64 as int)) as v").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def _sets(rows: DataFrame, shared, live: DataFrame) -> DataFrame:
    """cls and tokens x of rows k, g, t; of those only that the bitmap of live lets pass (all of live, and few others)."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(live))

    def each(batches):
        common, level = shared.value
        for whole in batches:
            bit = whole.column("bit").to_numpy()
            for b in pieces(whole.filter(pa.array((bits.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0))):
                sets = [ordered(shingles(t.as_py()), common, level) for t in b.column("t")]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "x"])

    rows = rows.select("t", F.pmod(F.xxhash64("k", "g"), F.lit(1 << BITS)).alias("bit"))
    return rows.mapInArrow(each, "cls bigint, x binary")


def _join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the table: never a broadcast, so that it behaves alike at every size."""
    return a.join(b.hint("merge"), on, how)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that are similar."""
    one = _join(pairs, sets.select(F.col("cls").alias("a"), F.col("x").alias("xa")), "a")
    both = _join(one, sets.select(F.col("cls").alias("b"), F.col("x").alias("xb")), "b").select("a", "b", "xa", "xb")

    def each(batches):
        for batch in batches:
            a, b, keep = batch.column("xa"), batch.column("xb"), []
            for i in range(batch.num_rows):
                u, v = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                n, m = len(u), len(v)
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                z = np.concatenate([u, v])
                z.sort(kind="stable")
                c = int((z[1:] == z[:-1]).sum())
                keep.append(100 * c >= percent * (n + m - c))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(each, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """Nodes of links (a, b) with the smallest node they reach (v, comp): large and small stars in turn until nothing changes."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _join(both, low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _join(large, low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small = stage(small, "small")
        edges = small
        # stars only: no node has two centres, and no centre has a centre of its own
        if not small.groupBy("a").count().where("count > 1").head(1) and not small.select(F.col("b").alias("a")).distinct().join(small.select("a"), "a", "left_semi").head(1):
            return edges.select(F.col("a").alias("v"), F.col("b").alias("comp"))


def _runs(batches, names: list[str]):
    """Tables of consecutive rows that agree in the named columns."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        at = np.array([t.column(c).to_numpy() for c in names])
        starts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()] if t.num_rows else [0]
        for i, j in zip(starts, starts[1:]):
            yield t.slice(i, j - i)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def near_pairs(n: np.ndarray, comp: np.ndarray, block: np.ndarray, bits: list[bytes], nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) across components, n[i] <= n[j], that the bitmaps don't tell apart, and the bits in which they differ. n must ascend. Where there are two blocks, pairs across these. With ``nearest``, of each j the pair with fewest such bits."""
    width = np.array([len(x) // 8 for x in bits])
    apart = block[0] != block[-1] or (block != block[0]).any()
    out, best, least = [], np.zeros(len(n), int), np.full(len(n), 1 << 40)
    for w in np.unique(width).tolist():
        lo, mid, hi = np.searchsorted(width, [w, w + 1, 2 * w + 1])
        m = np.empty((hi - lo, w), np.uint64)
        for r in range(lo, hi):
            x = np.frombuffer(bits[r], np.uint64)
            m[r - lo] = x if len(x) == w else x[:w] ^ x[w:]
        ends = np.searchsorted(n[:hi], 5 * n[lo:mid] // 4, side="right")
        for i in range(lo, mid):
            e = int(ends[i - lo])
            if e <= i + 1:
                continue
            may = comp[i + 1 : e] != comp[i]
            if apart:
                may &= block[i + 1 : e] != block[i]
            j = np.flatnonzero(may)
            if not len(j):
                continue
            d = np.bitwise_count(m[i + 1 - lo + j] ^ m[i - lo]).sum(axis=1).astype(np.int64)
            j = j + i + 1
            ok = 9 * d <= n[i] + n[j]
            j, d = j[ok], d[ok]
            if nearest:
                less = d < least[j]
                best[j[less]], least[j[less]] = i, d[less]
            elif len(j):
                out.append((np.full(len(j), i), j, d))
    if nearest:
        j = np.flatnonzero(least < 1 << 40)
        return best[j], j, least[j]
    return tuple(np.concatenate(x) if x else np.empty(0, int) for x in (zip(*out) if out else ((), (), ())))


def _scanned(lists: DataFrame, nearest: bool) -> DataFrame:
    """lists (key, home, rows, cls, n, comp, bits) -> pairs a, b and the share of bits in which they differ; a pair is told once for most of the lists it is in."""
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    dealt = lists.withColumn("blk", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    if nearest:
        dealt = dealt.withColumn("bi", F.col("blk")).withColumn("bj", F.col("blk"))
    else:
        every = F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda x: F.struct(F.least(x, "blk").alias("bi"), F.greatest(x, "blk").alias("bj")))
        dealt = dealt.withColumn("x", F.explode(every)).select("*", "x.bi", "x.bj").drop("x")
    dealt = dealt.withColumn("home", F.xxhash64("home", F.pmod("key", F.lit(HOMES)), "bi", "bj")).select("home", "key", "bi", "bj", "blk", "cls", "n", "comp", "bits")
    dealt = dealt.repartition("home").sortWithinPartitions("home", "key", "bi", "bj", "n", "cls")

    def each(batches):
        home, told, out = None, set(), []
        for t in _runs(batches, ["home", "key", "bi", "bj"]):
            own = t.column("home")[0].as_py()
            if own != home or len(told) > 200_000:
                home, told = own, set()
            n, cls = t.column("n").to_numpy(), t.column("cls").to_numpy()
            i, j, d = near_pairs(n, t.column("comp").to_numpy(), t.column("blk").to_numpy(), t.column("bits").to_pylist(), nearest)
            for a, b, x in zip(cls[j].tolist(), cls[i].tolist(), (d / (n[i] + n[j])).tolist()):
                if (a, b) not in told:
                    told.add((a, b))
                    out.append((a, b, x))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b", "d"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["a", "b", "d"])

    return dealt.mapInArrow(each, "a bigint, b bigint, d double")


def similar_classes(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of docs: k, g (row key), n (size of its set), comp (the component's class; null for an empty set)."""
    if percent != 80:
        raise ValueError("prefixes are laid out for a similarity of 0.8")
    spark = docs.sparkSession
    common, level, bound = _sampled(docs, id_col, text_col, sample_rows)
    shared = spark.sparkContext.broadcast((common, level))
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("t"))
    signed = stage(_signed(rows, shared, bound), "signed")

    # one exchange by key; Spark's window buffer goes to disk where a list is long
    by_key = Window.partitionBy("key")
    lists = signed.where("cls is not null").select(F.explode("keys").alias("key"), "cls")
    lists = lists.withColumn("lo", F.min("cls").over(by_key)).withColumn("hi", F.max("cls").over(by_key)).where("lo <> hi").select("key", "cls")
    lists = stage(lists.distinct(), "shared-keys")
    classes = signed.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.min(F.struct("k", "g")).alias("r"), F.first("bits").alias("bits"))
    enough = f"n <= {bound} or c >= 1 + ((4 * n + 4) div 5) div 20"
    live = stage(_join(lists.groupBy("cls").agg(F.count("*").alias("c")), classes, "cls").where(enough).select("cls", "n", "r", "bits"), "live-classes")
    lists = _join(lists, live.select("cls"), "cls", "left_semi")
    # lists with the same members become one
    hashed = F.xxhash64("cls")
    same = lists.groupBy("key").agg(F.bit_xor(hashed).alias("s"), F.bit_xor(F.xxhash64(hashed)).alias("x"), F.count("*").alias("rows"), F.min(hashed).alias("home")).where("rows > 1")
    same = same.groupBy("s", "x", "rows", "home").agg(F.min("key").alias("key")).select("key", "rows", "home")
    lists = stage(_join(lists, same, "key"), "lists")
    sets = _join(_sets(rows, shared, live.select("r.k", "r.g")), live.select("cls"), "cls", "left_semi")
    sets = stage(sets.groupBy("cls").agg(F.first("x").alias("x")), "sets")

    whole = _join(lists, live.select("cls", "n", "bits"), "cls").withColumn("comp", F.col("cls"))
    best = F.slice(F.sort_array(F.collect_set(F.struct("d", "b"))), 1, NEAREST)
    pairs = _scanned(whole, True).groupBy("a").agg(best.alias("x")).select("a", F.explode("x.b").alias("b"))
    links = stage(_linked(pairs, sets, percent), "links-near")
    comp = components(links)
    nodes = _join(live.select("cls"), comp, F.col("cls") == F.col("v"), "left").select("cls", F.coalesce("comp", "cls").alias("comp"))
    size = comp.groupBy("comp").agg(F.count("*").alias("size"))
    nodes = _join(nodes, size, "comp", "left").select("cls", "comp", F.coalesce("size", F.lit(0)).alias("size"))
    told = stage(_join(lists.drop("home"), nodes, "cls"), "told")
    # lists of one large component stay together, as they share its pairs
    across = told.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("size", F.xxhash64("comp").alias("h"))).alias("home")).where("lo <> hi").select("key", "home.h")
    whole = _join(_join(told.drop("size"), across.withColumnRenamed("h", "home"), "key"), live.select("cls", "n", "bits"), "cls")
    pairs = _scanned(whole, False).select("a", "b").distinct()
    found = stage(_linked(pairs, sets, percent), "links-across")
    comp = components(links.unionByName(found))
    return _join(signed.select("k", "g", "n", "cls"), comp, F.col("cls") == F.col("v"), "left").select("k", "g", "n", F.coalesce("comp", "cls").alias("comp"))


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of docs: k, g (row key), n_shingles, component_id (the smallest doc_id reachable by links).

    Null, empty and blank texts have no shingles and are linked with nothing: component_id is their own doc_id. Texts shorter than a shingle are one shingle as a whole.
    A null doc_id is never a component's smallest unless all are null; then component_id is null. Repeated rows and equal texts belong to one class. Extra columns are ignored. Empty table: no rows.
    """
    rows = stage(similar_classes(docs, 80, id_col, text_col, sample_rows), "rows")
    least = rows.where("comp is not null").groupBy("comp").agg(F.min(F.when(F.col("k") != F.lit(NO_ID), F.col("k"))).alias("least"))
    own = F.when(F.col("k") != F.lit(NO_ID), F.col("k"))
    return _join(rows, least, "comp", "left").select("k", "g", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), own).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs without all but one of each group: the one with the smallest doc_id (null ids last), of equal ids and texts a single row. Rows without words stay."""
    rows = stage(similar_classes(docs, 80, id_col, text_col, sample_rows), "rows")
    one = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct((F.col("k") == F.lit(NO_ID)).alias("last"), "k", "g")).alias("r")).select("r.k", "r.g", F.lit(True).alias("one"))
    stay = stage(one.unionByName(rows.where("comp is null").select("k", "g", F.lit(False).alias("one")).distinct()), "stay")
    whole = docs.select(F.struct("*").alias("d"), *row_key(id_col, text_col)).join(stay.hint("merge"), ["k", "g"])
    return whole.withColumn("nth", F.row_number().over(Window.partitionBy("k", "g").orderBy("k"))).where("nth = 1 or not one").select("d.*")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    out = ngram_groups(documents(spark, sf_dir))
    return out.select(F.when(F.col("k") != F.lit(NO_ID), F.col("k")).alias("doc_id"), "n_shingles", "component_id")

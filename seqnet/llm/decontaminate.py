"""Finds benchmark passages in documents with Aho-Corasick automata over normalised windows of words.

Both sides are lower-cased (A-Z) and cut into words; a window is ``window`` consecutive words of an item. An automaton holds each distinct window once, with blanks
around its words, and scans a document's words once. A hit's end is mapped to word numbers and, for ``spans``, back to code points of the original text.

A benchmark of up to MOST_NODES characters of windows is one automaton. The windows of a larger one are cut into blocks of that size. So that not every text is scanned for every block, one pass
over all texts then looks each window of words up in a bitmap of fixed size first; texts without a match hold no window, and only the others are scanned by each block's automaton.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, stage
from .ngram_join import _mix, word_hashes

WINDOW = 10
#: Characters of windows (an upper bound of nodes) in one automaton, of some 40 bytes each, and eight for each item that has the window.
MOST_NODES = 2_000_000
#: Logarithm of the bits in the bitmap of windows, and the bits that a window sets.
BITS, MARKS = 27, 4
#: Word characters: digits, letters a-z after lower-casing, everything outside ASCII.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_built: dict = {}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def windows(items: list[tuple[str, str | None]], size: int) -> list[tuple[str, int, list[str]]]:
    """Each distinct window with its number of words and the items it comes from."""
    found: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            part = w[i : i + size]
            found.setdefault(b" ".join(part), (len(part), set()))[1].add(item)
    return [(k.decode("utf-8", "surrogatepass"), n, sorted(ids)) for k, (n, ids) in found.items()]


def automaton(found):
    """found: (window, number of words, its items)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for text, n, ids in found:
        a.add_word(f" {text} ", (n, ids))
    if len(a):
        a.make_automaton()
    return a


def scan(a, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit word ranges [from, to) in order and merged, items with hits."""
    w = words(text)
    if not w or not len(a):
        return len(w), [], set()
    line = f" {b' '.join(w).decode('utf-8', 'surrogatepass')} "
    ends, ids = [], set()
    for end, (n, own) in a.iter(line):
        ends.append((end, n))
        ids.update(own)
    ranges: list[list[int]] = []
    at = count = 0
    for end, n in ends:  # by end
        count += line.count(" ", at, end)
        at = end
        ranges.append([count - n, count])
    ranges.sort()
    out: list[tuple[int, int]] = []
    for lo, hi in ranges:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return len(w), out, ids


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null and item_id is not null")


def _windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows w with their number of words and, sorted, their items; made where the items are."""

    def each(batches):
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text")):
                got = windows([(item, text.as_py())], size)
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([item] * len(got), pa.string())], ["w", "n", "item_id"])

    return items.mapInArrow(each, "w string, n int, item_id string").groupBy("w").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("item_id")).alias("ids"))


def _pass(rows: DataFrame, own: DataFrame) -> tuple[DataFrame, object]:
    """rows (d, t) with n_words, ranges as a flat list and item ids, by the automaton of own windows; and the broadcast, to be dropped after use."""
    found = sorted((r["w"], r["n"], r["ids"]) for r in own.collect())
    key = hashlib.sha256(repr(found).encode("utf-8", "surrogatepass")).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def each(batches):
        if key not in _built:
            _built.clear()
            _built[key] = automaton(shared.value)
        a = _built[key]
        for whole in batches:
            for batch in pieces(whole):
                got = [scan(a, t.as_py()) for t in batch.column("t")]
                yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array([n for n, _, _ in got], pa.int64()), pa.array([[x for r in rs for x in r] for _, rs, _ in got], pa.list_(pa.int64())), pa.array([sorted(ids) for _, _, ids in got], pa.list_(pa.string()))], ["d", "n_words", "ranges", "items"])

    kind = rows.schema["d"].dataType.simpleString()
    return rows.mapInArrow(each, f"d {kind}, n_words bigint, ranges array<bigint>, items array<string>"), shared


def window_hashes(text: str | bytes | None, size: int) -> np.ndarray:
    """63-bit hashes of all windows of ``size`` words of a text."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    h = word_hashes(raw.translate(TABLE))
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return out >> np.uint64(1)


def marks(hashes: np.ndarray) -> np.ndarray:
    """The MARKS bits of each hash (rows)."""
    step = _mix(hashes * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return np.array([(hashes + np.uint64(i) * step) >> np.uint64(20) for i in range(MARKS)], np.uint64).T & np.uint64((1 << BITS) - 1)


def _bitmap(found: DataFrame) -> np.ndarray:
    """The bits of all windows, 16 MB whatever their number."""

    def each(batches):
        for b in batches:
            bits = [marks(window_hashes(w.as_py(), n.as_py())).ravel() for w, n in zip(b.column("w"), b.column("n"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *bits]).astype(np.int64))], ["bit"])

    bits = found.select("w", "n").mapInArrow(each, "bit bigint").selectExpr("cast(bit div 64 as int) as i", "shiftleft(1L, cast(bit % 64 as int)) as v").groupBy("i").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[bits["i"].to_numpy()] = bits["v"].to_numpy()
    return out.view(np.uint64)


def _possible(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (d, t) with n_words, t only where the bitmap lets a window of the text pass, and a number of the row."""
    shared = rows.sparkSession.sparkContext.broadcast((_bitmap(found), [r["n"] for r in found.select("n").distinct().collect()]))

    def each(batches):
        bitmap, sizes = shared.value
        for whole in batches:
            for b in pieces(whole):
                n, keep = [], []
                for t in b.column("t"):
                    t = t.as_py()
                    n.append(len(words(t)))
                    hit = False
                    for size in sizes:
                        if n[-1] >= size and not hit:
                            bit = marks(window_hashes(t, size))
                            hit = bool(((bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).all(axis=1).any())
                    keep.append(t if hit else None)
                yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(n, pa.int64()), pa.array(keep, pa.string())], ["d", "n_words", "t"])

    out = rows.mapInArrow(each, f"d {rows.schema['d'].dataType.simpleString()}, n_words bigint, t string")
    return stage(out.withColumn("row", F.monotonically_increasing_id()), "possible")


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Per row of docs: ``d`` (the columns of carry as a struct), n_words, ranges (hit words as from, to, from, to, ...; disjoint, ascending), items (sorted ids).

    Null or empty text has no words; a document without words, or a benchmark without items, has no hits. Items without text, words or id are skipped; items of the same text
    all count. An item shorter than a window is one window. Repeated rows get a result each. Extra columns are ignored unless carried.
    The size of the benchmark's windows is looked up first: up to MOST_NODES characters go into one automaton. Of a larger benchmark, the driver holds one block at a time.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("d"), F.col(text_col).alias("t"))
    found = stage(_windows(_items(benchmark), window), "windows")
    total = found.agg(F.sum(F.octet_length("w") + 2 + 8 * F.size("ids")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // MOST_NODES))
    if blocks == 1:
        return _pass(rows, found)[0]
    found = stage(found.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks)).cast("int")).repartition("block"), "blocks")
    rows = _possible(rows, found)
    few = rows.where("t is not null").select(F.struct("row").alias("d"), "t")
    merged = None
    for b in range(blocks):
        more, shared = _pass(few, found.where(F.col("block") == b))
        more = stage(more.where("size(ranges) > 0").select("d.row", "ranges", "items"), f"block-{b}")
        shared.destroy()
        merged = more if merged is None else merged.unionByName(more)
    pairs = "array_sort(flatten(collect_list(transform(sequence(0, size(ranges) div 2 - 1), i -> struct(ranges[2 * i] as lo, ranges[2 * i + 1] as hi)))))"
    merged = merged.groupBy("row").agg(F.expr(pairs).alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = "element_at(s, -1)"
    joined = f"aggregate(p, cast(array() as array<bigint>), (s, x) -> if(size(s) > 0 and x.lo <= {last}, if(x.hi > {last}, concat(slice(s, 1, size(s) - 1), array(x.hi)), s), concat(s, array(x.lo, x.hi))))"
    out = rows.select("d", "n_words", "row").join(merged.select("row", F.expr(joined).alias("ranges"), "items"), "row", "left")
    return out.select("d", "n_words", F.coalesce("ranges", F.array().cast("array<bigint>")).alias("ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def spans(text: str, ranges: list[int]) -> list[tuple[int, int]]:
    """Hit ranges of words as code point spans of the original text."""
    at = [m.span() for m in WORD_RE.finditer(text)]
    return [(at[lo][0], at[hi - 1][1]) for lo, hi in zip(ranges[::2], ranges[1::2])]


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    out = out.withColumn("n_hit", F.expr("aggregate(transform(filter(sequence(0, size(ranges)), i -> i % 2 = 1 and i < size(ranges)), i -> ranges[i] - ranges[i - 1]), 0L, (s, x) -> s + x)"))
    return out.select("d.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
win as (select item_id, unnest([array_to_string(w[i : i + 9], ' ') for i in range(1, greatest(2, len(w) - 8))]) as t, least(10, len(w)) as n from iw where len(w) > 0),
sizes as (select distinct n from win),
pos as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from dw, sizes where len(w) >= n),
hit as (select p.doc_id, p.i, p.n, win.item_id from (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as t from pos) p join win on p.t = win.t and p.n = win.n),
words as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item_id::varchar as item from hit) group by 1)
select dw.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""

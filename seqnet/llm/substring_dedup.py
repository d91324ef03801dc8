"""Removes repeated passages of words: every window of ``window`` words that also starts earlier in the corpus.

1. Each text is measured: its number of words, a digest of its words, and anchors. An anchor is the least-hashed gram of a window, so equal windows have equal anchors; only anchors that occur twice are looked at from here on. Of texts with the same words only the first goes on, the others are repeats as a whole.
2. Windows with a recurring anchor are hashed, once for each block of documents, and confirmed: those that occur twice have a first place, given by the number of words before it in the corpus. Windows that come first side by side make up the recurring passages, cut from their documents.
3. Each block of documents gets the passages whose windows it holds, compiles an Aho-Corasick automaton over their tiles (stretches of words, one of which every window holds), and streams its stretches of such windows through it. A tile's occurrence is carried on to both sides, word by word, so hashes decide
   only which passages a block is given, never what is removed. A passage that all blocks hold is sent once to each block, not to each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, drop_stage, pieces, row_key, stage, stage_kinds
from .ngram_join import _BLANK, _grown, _mix

WINDOW = 20
#: Words of an anchor's gram.
GRAM = 8
#: Words of a block of documents (a longer document is a block by itself), and of a chunk of passages.
BLOCK_WORDS, CHUNK = 300_000, 1024
#: Bytes hashed or split at once.
STEP = 1 << 20
#: Logarithm of the bits of the bitmap of documents to look at, and the bits that a document sets.
BITS, MARKS = 27, 3
_LETTER = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, key=b"case").digest(), "little") for b in range(256)], np.uint64)


def parts(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of pieces of some STEP bytes, cut at blanks; a longer word is not cut."""
    at = 0
    while at < len(raw):
        end = min(at + STEP, len(raw))
        if end < len(raw):
            blanks = np.flatnonzero(_BLANK[np.frombuffer(raw, np.uint8, end - at, at)])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                while end < len(raw) and not _BLANK[raw[end]]:
                    end += 1
        yield at, raw[at:end]
        at = end


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length. ASCII white space separates them."""
    for _, part in parts(raw):
        yield part.split()


def joined_sha(raw: bytes, gone: list[int] = ()) -> bytes:
    """SHA-256 of the words joined by blanks, without those in the ranges [gone[0], gone[1]), [gone[2], gone[3]), ..."""
    out, n, i, first = hashlib.sha256(), 0, 0, True
    for w in words(raw):
        kept, at = [], 0
        while at < len(w):
            lo, hi = (gone[i], gone[i + 1]) if i < len(gone) else (n + len(w), n + len(w))
            kept += w[at : max(at, min(len(w), lo - n))]
            at = max(at, min(len(w), hi - n))
            if hi - n > len(w) or i >= len(gone):
                break
            i += 2
        if kept:
            out.update((b"" if first else b" ") + b" ".join(kept))
            first = False
        n += len(w)
    return out.digest()


def kept_text(text: str, gone: list[int]) -> str:
    """The words of a text, joined by blanks, without those in the ranges."""
    w = text.encode("utf-8", "surrogatepass").split()
    keep = np.ones(len(w), bool)
    for lo, hi in zip(gone[::2], gone[1::2]):
        keep[lo:hi] = False
    return b" ".join(x for x, k in zip(w, keep) if k).decode("utf-8", "surrogatepass")


def hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and where they start."""
    h, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at, part in parts(raw):
        b = np.frombuffer(part, np.uint8)
        n = len(b)
        power, inverse = _grown(n + 1)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~_BLANK[b]
        edge = np.flatnonzero(np.diff(inside))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[b] * power[:n], out=total[1:])
        h.append(_mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
        starts.append(start + at)
    return np.concatenate(h), np.concatenate(starts)


def rolled(h: np.ndarray, size: int, total: np.ndarray, odd: int = 1) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from running sums."""
    n = max(0, len(h) - size + 1)
    return _mix((total[size : size + n] - total[:n]) * _grown(len(h) + 1)[1][:n] * np.uint64(odd))


def sums(h: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _grown(len(h) + 1)[0][: len(h)], out=total[1:])
    return total


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words its anchor's hash and place: the leftmost gram of the least hash."""
    value, place, step = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 1 << 20
    for at in range(0, max(0, len(h) - window + 1), step):
        own = h[at : at + step + window - 1]
        g = rolled(own, gram, sums(own))
        low = np.uint64((1 << 24) - 1)
        m = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        width, have = window - gram + 1, 1
        while have < width:
            more = min(have, width - have)
            m = np.minimum(m[: len(m) - more], m[more:])
            have += more
        p = (m & low).astype(np.int64)
        value.append(g[p])
        place.append(p + at)
    return np.concatenate(value), np.concatenate(place)


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, the text each belongs to, and the number of words of each text."""
    h, start = hashed(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    own = np.searchsorted(ends, start, side="right")
    return h, own, np.bincount(own, minlength=len(texts))


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def measured(docs: DataFrame, carry: list[str], window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind 0, one for each document: d, k, g, n_words, sha (of the words), s (64 bits of sha); and of kind 1, one for each distinct anchor of a document: a (a hash of 63 bits), again (whether it occurs again in the document), s."""

    def each(batches):
        for whole in batches:
            for b in pieces(whole):
                texts = _bytes(b.column("t"))
                h, own, n = _laid(texts)
                value, place = anchors(h, window, gram)
                inner = own[: len(value)] == own[window - 1 :] if len(value) else np.empty(0, bool)
                place, at = np.unique(place[inner], return_index=True)
                value, doc = value[inner][at] >> np.uint64(1), own[place] if len(place) else place
                by = np.lexsort((value, doc))
                value, doc = value[by], doc[by]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                again = np.diff(np.append(np.flatnonzero(new), len(value))) > 1
                shas = [joined_sha(t) for t in texts]
                s, m, w = np.array([int.from_bytes(x[:8], "little", signed=True) for x in shas], np.int64), len(texts), int(new.sum())
                d = b.column("d")
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), d, b.column("k"), b.column("g"), pa.array(n, pa.int64()), pa.array(shas, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(s)], names)
                yield pa.RecordBatch.from_arrays([pa.array([1] * w, pa.int32()), pa.nulls(w, d.type), pa.nulls(w, pa.int64()), pa.nulls(w, pa.int64()), pa.nulls(w, pa.int64()), pa.nulls(w, pa.binary()), pa.array(value[new].view(np.int64)), pa.array(again), pa.array(s[doc[new]])], names)

    names = ["kind", "d", "k", "g", "n_words", "sha", "a", "again", "s"]
    rows = docs.select(F.struct(*carry).alias("d"), F.col(text_col).alias("t"), *row_key(id_col, text_col))
    return rows.mapInArrow(each, f"kind int, d {rows.schema['d'].dataType.simpleString()}, k bigint, g bigint, n_words bigint, sha binary, a bigint, again boolean, s bigint")


def firsts(rows: DataFrame, window: int) -> DataFrame:
    """k, g, ``at``, n_words, s of the first document of each sequence of words with a window: at is the number of words before it, in the order of k and g, of such documents."""
    first = rows.where(F.col("n_words") >= window).groupBy("sha").agg(F.min(F.struct("k", "g", "n_words", "s")).alias("f")).select("f.*")
    ranges = stage(first.repartitionByRange("k", "g").withColumn("part", F.spark_partition_id()), "first-ranges")
    sizes = ranges.groupBy("part").agg(F.sum("n_words").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    own = F.sum("n_words").over(Window.partitionBy("part").orderBy("k", "g")) - F.col("n_words")
    return ranges.withColumn("own", own).join(F.broadcast(before), "part").select("k", "g", (F.col("own") + F.col("before")).alias("at"), "n_words", "s")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of the column ``key``, 16 MB however many there are; the more, the more rows pass that needn't. The driver gets them in pieces of 8 kB."""

    def lay(key: tuple, part: pa.Table) -> pa.Table:
        out = np.zeros(1 << 10, np.int64)
        out[part.column("i").to_numpy() & 1023] = part.column("v").to_numpy()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["c", "b"])

    bits = keys.select(F.explode(F.array(*_marks(F.col("key")))).alias("bit")).selectExpr("cast(bit div 64 as int) as i", "shiftleft(1L, cast(bit % 64 as int)) as v").groupBy("i").agg(F.bit_or("v").alias("v"))
    out = np.zeros((1 << (BITS - 16), 1 << 10), np.int64)
    for r in bits.groupBy(F.shiftright("i", 10).alias("c")).applyInArrow(lay, "c int, b binary").toLocalIterator():
        out[r["c"]] = np.frombuffer(r["b"], np.int64)
    return out.ravel().view(np.uint64)


def _marks(key) -> list:
    """Numbers of the bits of a key."""
    return [F.xxhash64(key, F.lit(i)).bitwiseAND((1 << BITS) - 1) for i in range(MARKS)]


def _known(bitmap: np.ndarray, column) -> np.ndarray:
    bit = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, MARKS)
    return ((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def among(rows: DataFrame, key, keys: DataFrame, once: list[str] = ()) -> DataFrame:
    """rows whose key may be in the column ``key`` of keys, so that the others aren't shuffled. Of rows that agree in the columns ``once``, most repeats go too."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def each(batches):
        bitmap, seen = shared.value, set()
        for b in batches:
            keep = _known(bitmap, b.column("bits"))
            if once:
                for i, x in zip(np.flatnonzero(keep), zip(*[b.column(c).filter(pa.array(keep)).to_pylist() for c in once])):
                    keep[i] = x not in seen
                    seen.add(x)
                if len(seen) > 200_000:
                    seen.clear()
            yield b.drop_columns(["bits"]).filter(pa.array(keep))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("bits", F.array(*_marks(key))).mapInArrow(each, kind)


_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("k", pa.int64()), ("g", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("t", pa.string()), ("h", pa.int64()), ("h2", pa.int32()), ("gp", pa.int64()), ("again", pa.bool_())])
OCCURRENCES = "kind int, block int, k bigint, g bigint, at bigint, start bigint, t string, h bigint, h2 int, gp bigint, again boolean"


def _occurrences(window: int, gram: int):
    """For cogroups of a block's texts and its documents with recurring anchors: rows of kind 0, one for each stretch of words in windows with such anchors (``start``: its first word's number; ``t``: its words), and of kind 1, one for each distinct such window (by its hashes h, h2), with its first place in the block."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = {(k, g): (at, a) for k, g, at, a in zip(*[right.column(c).to_pylist() for c in ("k", "g", "at", "anchors")])}
        texts = {}
        for k, g, t in zip(*[left.column(c).to_pylist() for c in ("k", "g", "t")]):
            if (k, g) in wanted:
                texts[k, g] = t.encode("utf-8", "surrogatepass")
        keys = sorted(texts, key=lambda x: wanted[x][0])
        raw = [texts[x] for x in keys]
        h, own, n = _laid(raw)
        value, _ = anchors(h, window, gram)
        value >>= np.uint64(1)
        known = np.unique(np.array([a for x in keys for a in wanted[x][1]], np.int64)).view(np.uint64)
        inner = own[: len(value)] == own[window - 1 :] if len(value) else np.empty(0, bool)
        inner &= known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value if len(known) else False
        at = np.flatnonzero(inner)
        start, base = np.cumsum(n) - n, np.array([wanted[x][0] for x in keys], np.int64)
        block = (right if right.num_rows else left).column("block")[0].as_py()

        covered = np.zeros(len(h) + 1, np.int32)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
        covered = np.cumsum(covered)[:-1] > 0
        change = np.flatnonzero((covered[1:] != covered[:-1]) | (own[1:] != own[:-1])) + 1 if len(h) else np.empty(0, int)
        low, high = np.concatenate([[0], change]).astype(int), np.concatenate([change, [len(h)]]).astype(int)
        low, high = (low[covered[low]], high[covered[low]]) if len(h) else (low[:0], high[:0])
        ks, gs, ats, starts, ts = [], [], [], [], []
        for i in np.unique(own[low]) if len(low) else ():
            mine = own[low] == i
            for (lo, hi), t in zip(zip(low[mine] - start[i], high[mine] - start[i]), stretches(raw[i], low[mine] - start[i], high[mine] - start[i])):
                ks.append(keys[i][0])
                gs.append(keys[i][1])
                ats.append(int(base[i]))
                starts.append(int(lo))
                ts.append(t.decode("utf-8", "surrogatepass"))
        m = len(ks)
        one = pa.table([pa.array(v, f.type) if v is not None else pa.nulls(m, f.type) for v, f in zip([[0] * m, [block] * m, ks, gs, ats, starts, ts, None, None, None, None], _SCHEMA)], schema=_SCHEMA)

        gp = base[own[at]] + at - start[own[at]] if len(at) else at
        other = _mix(h + np.uint64(77))
        h1, h2 = rolled(h, window, sums(h))[at], (rolled(other, window, sums(other))[at] >> np.uint64(33)).astype(np.int32)
        by = np.lexsort((gp, h2, h1))
        h1, h2, gp = h1[by], h2[by], gp[by]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        again = np.diff(np.append(np.flatnonzero(new), len(h1))) > 1
        w = int(new.sum())
        two = pa.table([pa.array(v, f.type) if v is not None else pa.nulls(w, f.type) for v, f in zip([np.ones(w, np.int32), np.full(w, block, np.int32), None, None, None, None, None, h1[new].view(np.int64), h2[new], gp[new], again], _SCHEMA)], schema=_SCHEMA)
        return pa.concat_tables([one, two])

    return each


def stretches(raw: bytes, lows, highs) -> Iterator[bytes]:
    """The words of a text from lows[i] to highs[i] (ascending, disjoint), joined by blanks."""
    n, i, held = 0, 0, []
    for w in words(raw):
        at = 0
        while i < len(lows):
            held += w[max(at, lows[i] - n) : max(0, highs[i] - n)]
            if highs[i] - n > len(w):
                break
            yield b" ".join(held)
            at, held, i = max(0, highs[i] - n), [], i + 1
        n += len(w)


def _confirmed(chunk: int):
    """From windows sorted by hashes and place, those that occur again: block, c (the chunk that the window's first place is in), gp (the place, of the first one only), again."""

    def each(batches):
        key, origin, held = None, 0, None  # of the last window: its first place, and the first row as long as it is alone
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h, h2, gp, block, again = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "h2", "gp", "block", "again"))
            new = np.ones(n, bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            new[0] = key != (h[0], h2[0])
            starts = np.flatnonzero(new)
            number = np.cumsum(new)  # 0: goes on with the last batch's window
            first = np.concatenate([[origin], gp[starts]])[number]
            alone = new & ~again
            alone[:-1] &= new[1:]
            last = n - 1 if alone[-1] else None
            out = ~alone
            parts = [(block[out], first[out] // chunk, gp[out], gp[out] == first[out], again[out])]
            if held is not None:
                if not new[0]:
                    parts.insert(0, tuple(np.array([x]) for x in held))
                held = None
            if last is not None:
                held = (block[last], gp[last] // chunk, gp[last], True, False)
            key, origin = (h[-1], h2[-1]), int(first[-1])
            bs, cs, ps, own, ag = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(bs, pa.int32()), pa.array(cs, pa.int64()), pa.array(ps, pa.int64(), mask=~own), pa.array(ag, pa.bool_())], ["block", "c", "gp", "again"])

    return each


def _passages(window: int, chunk: int):
    """For cogroups of a block's stretches and the places gp at which windows come first: the passages (c, gp, words) they make up, cut where a chunk ends."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        gp = np.unique(right.column("gp").to_numpy())
        cs, gps, texts = [], [], []
        ends = np.flatnonzero((np.diff(gp) > 1) | (gp[1:] // chunk > gp[:-1] // chunk)) + 1 if len(gp) else np.empty(0, int)
        lows, highs = gp[np.concatenate([[0], ends]).astype(int)] if len(gp) else gp, gp[np.concatenate([ends, [len(gp)]]).astype(int) - 1] if len(gp) else gp
        for at, start, t in zip(left.column("at").to_pylist(), left.column("start").to_pylist(), left.column("t")):
            at += start
            raw, n = t.as_py().encode("utf-8", "surrogatepass"), at
            i = int(np.searchsorted(lows, at))
            held: list[bytes] = []  # words from place n on that a passage may still need
            for w in words(raw):
                held += w
                while i < len(lows) and highs[i] + window <= n + len(held):
                    cs.append(int(lows[i]) // chunk)
                    gps.append(int(lows[i]))
                    texts.append(b" ".join(held[lows[i] - n : highs[i] + window - n]).decode("utf-8", "surrogatepass"))
                    i += 1
                drop = int(min(len(held), (lows[i] if i < len(lows) else n + len(held)) - n))
                held, n = held[drop:], n + drop
        return pa.table([pa.array(cs, pa.int64()), pa.array(gps, pa.int64()), pa.array(texts, pa.string())], names=["c", "gp", "words"])

    return each


class PassageAutomaton:
    """Locates passages (place of the first word, words) by tiles of ``tile`` words, one every ``step`` words, one of which each window holds."""

    def __init__(self, passages: list[tuple[int, list[bytes]]], window: int):
        import ahocorasick

        self.window, self.tile = window, max(1, window * 7 // 10)
        step = window - self.tile + 1
        self.id: dict[bytes, int] = {}
        self.place = [at for at, _ in passages]
        self.ids = [np.array([self.id.setdefault(w, len(self.id) + 1) for w in ws], np.int32) for _, ws in passages]
        tiles: dict[tuple, list] = {}
        for p, ids in enumerate(self.ids):
            own = ids.tolist()
            for o in range(0, len(own) - self.tile + 1, step):
                tiles.setdefault(tuple(own[o : o + self.tile]), []).append((p, o))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, where in tiles.items():
            self.automaton.add_word(key, where)
        if tiles:
            self.automaton.make_automaton()

    def later(self, raw: bytes, at: int) -> list[int]:
        """Words (as from, to, from, to, ...; disjoint, ascending) of a text, which has ``at`` words before it, in windows of passages that come earlier."""
        if not len(self.automaton):
            return []
        ids = np.concatenate([np.empty(0, np.int32), *[np.fromiter(map(self.id.get, w, repeat(0)), np.int32, len(w)) for w in words(raw)]])
        ranges, read, step = [], {}, 1 << 17
        for lo in range(0, len(ids), step):
            for end, where in self.automaton.iter(tuple(ids[lo : lo + step + self.tile - 1].tolist())):
                q = lo + end - self.tile + 1
                for p, o in where:
                    shift = q - o  # the passage's word i stands against the text's word shift + i
                    if at + shift <= self.place[p] or read.get((p, shift), -1) >= q:
                        continue
                    own = self.ids[p]
                    first, last = max(0, -shift), min(len(own), len(ids) - shift)
                    wrong = np.flatnonzero(own[first:last] != ids[shift + first : shift + last]) + first
                    i = int(np.searchsorted(wrong, o))
                    a, b = (int(wrong[i - 1]) + 1 if i else first), (int(wrong[i]) if i < len(wrong) else last)
                    read[p, shift] = shift + b - 1
                    if b - a >= self.window:
                        ranges.append((shift + a, shift + b))
        out: list[int] = []
        for a, b in sorted(ranges):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return out


def _removed(window: int):
    """For cogroups of a block's stretches and its passages: k, g, lo, hi of words that go."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        found = PassageAutomaton([(gp, w.encode("utf-8", "surrogatepass").split()) for gp, w in zip(right.column("gp").to_pylist(), right.column("words").to_pylist())], window)
        ks, gs, los, his = [], [], [], []
        for k, g, at, start, t in zip(*[left.column(c).to_pylist() for c in ("k", "g", "at", "start")], left.column("t")):
            gone = found.later(t.as_py().encode("utf-8", "surrogatepass"), at + start)
            for lo, hi in zip(gone[::2], gone[1::2]):
                ks.append(k)
                gs.append(g)
                los.append(start + lo)
                his.append(start + hi)
        return pa.table([pa.array(v, pa.int64()) for v in (ks, gs, los, his)], names=["k", "g", "lo", "hi"])

    return each


def _digests(rows: DataFrame) -> DataFrame:
    """k, g, ranges and ``kept``, the digest of the words that stay, of rows k, g, t, gone (structs of lo and hi)."""

    def each(batches):
        for whole in batches:
            for b in pieces(whole):
                ranges = []
                for gone in b.column("gone").to_pylist():
                    own: list[int] = []
                    for lo, hi in sorted((x["lo"], x["hi"]) for x in gone):
                        if own and lo <= own[-1]:
                            own[-1] = max(own[-1], hi)
                        else:
                            own += [lo, hi]
                    ranges.append(own)
                kept = [joined_sha(t, r) for t, r in zip(_bytes(b.column("t")), ranges)]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("g"), pa.array(ranges, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["k", "g", "ranges", "kept"])

    return rows.mapInArrow(each, "k bigint, g bigint, ranges array<bigint>, kept binary")


def substring_dedup(docs: DataFrame, carry: list[str], window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: ``d`` (the carried columns as a struct), n_words, ranges (removed words as from, to, from, to, ...; disjoint, ascending) and kept_sha256 (of the kept words, joined by blanks).

    A word goes if a window over it has words that also start earlier: in a document of a smaller id, or in the same one further up; repeats may overlap. Null and empty texts have no words, and texts shorter than a window lose nothing. A null id comes before
    all others; rows of one id are ordered by a hash of their texts, and rows that agree in id and text are one document and get one result. Texts are read whole, in pieces. Other columns only come with ``carry``, whatever their names. Empty table: no rows.
    """
    gram = min(gram, window)
    rows, spread = stage_kinds(measured(docs, carry, window, gram, id_col, text_col), "measured")
    rows, spread = rows.select("d", "k", "g", "n_words", "sha", "s"), spread.select("a", "again", "s")
    first = stage(firsts(rows, window), "firsts")
    total = first.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, total // block_words)
    block = F.pmod(F.xxhash64("k", "g"), F.lit(blocks)).cast("int").alias("block")

    # documents with anchors that recur, in another sequence of words or in their own
    twice = spread.groupBy("a").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.max("again").alias("again")).where("lo < hi or again")
    twice = stage(twice.select("a"), "recurring")
    wanted = among(spread.select("a", "s"), F.col("a"), twice.select(F.col("a").alias("key"))).distinct().join(twice, "a", "left_semi").groupBy("s").agg(F.collect_set("a").alias("anchors"))
    wanted = stage(first.join(wanted, "s").select(block, "k", "g", "at", "anchors"), "wanted")
    drop_stage(spread)

    # windows with such anchors, once for each block, and where they come first
    texts = docs.select(F.col(text_col).alias("t"), *row_key(id_col, text_col)).where("t is not null").select(block, "k", "g", "t")
    looked_at = among(texts, F.xxhash64("k", "g"), wanted.select(F.xxhash64("k", "g").alias("key")), ["k", "g"])
    left, spots = stage_kinds(looked_at.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_occurrences(window, gram), OCCURRENCES), "occurrences")
    left = left.select("block", "k", "g", "at", "start", "t")
    seen = stage(spots.select("h", "h2", "gp", "block", "again").repartition("h", "h2").sortWithinPartitions("h", "h2", "gp").mapInArrow(_confirmed(chunk), "block int, c bigint, gp bigint, again boolean"), "confirmed")
    drop_stage(spots)
    passages = left.select("block", "at", "start", "t").groupBy("block").cogroup(seen.where("gp is not null").select("block", "gp").groupBy("block")).applyInArrow(_passages(window, chunk), "c bigint, gp bigint, words string")
    needs = seen.where("gp is null or again").select("block", "c").distinct()
    given = needs.join(stage(passages, "passages"), "c").select("block", "gp", "words")

    gone = stage(left.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_removed(window), "k bigint, g bigint, lo bigint, hi bigint"), "removed")
    gone = gone.groupBy("k", "g").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    losing = among(texts.select("k", "g", "t"), F.xxhash64("k", "g"), gone.select(F.xxhash64("k", "g").alias("key")), ["k", "g"])
    digests = stage(_digests(losing.join(gone.hint("merge"), ["k", "g"])), "digests").dropDuplicates(["k", "g"])
    out = rows.join(first.select("k", "g", "at").hint("merge"), ["k", "g"], "left").join(digests.hint("merge"), ["k", "g"], "left")
    copy = F.col("at").isNull() & (F.col("n_words") >= window)
    ranges = F.when(copy, F.array(F.lit(0).cast("long"), F.col("n_words"))).otherwise(F.coalesce("ranges", F.array().cast("array<bigint>")))
    kept = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "sha"))))
    return out.select("d", "n_words", ranges.alias("ranges"), kept.alias("kept_sha256"))


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), ["doc_id"])
    n = F.expr("aggregate(sequence(0, size(ranges)), 0L, (s, i) -> s + if(i % 2 = 1 and i < size(ranges), ranges[i] - ranges[i - 1], 0L))")
    return out.select("d.doc_id", "n_words", n.alias("n_removed"), "kept_sha256")


SQL = r"""
with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)),
later as (select doc_id, i from (select doc_id, i, min((doc_id, i)) over (partition by t) as first from win) where (doc_id, i) > first),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from later),
lists as (select doc_id, list(j) as js, count(*) as n from gone group by doc_id)
select w.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(case when js is null then array_to_string(w, ' ') else coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda j: not list_contains(js, j)), lambda j: w[j]), ' '), '') end) as kept_sha256
from w left join lists using (doc_id)
"""

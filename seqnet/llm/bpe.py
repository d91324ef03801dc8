"""Encodes texts with a public BPE vocabulary and decodes the ids again.

A text is cut where no token can reach across: around added tokens, at white space, between the pieces of the vocabulary's split pattern, and inside a piece between two
bytes that are neighbours in no vocabulary token (a merge over such a cut would make a token that holds the pair). The texts of a batch are cut as arrays of bytes, each
distinct piece of theirs is encoded once, all fragments together, and the ids are put back in order. Chunks that the library has to cut are remembered by a worker, in a
cache that is bounded in bytes. The tokenizer's file is a parameter; nothing is trained.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces

#: Bytes (about) that each of the two generations of a worker's cache holds, and the longest chunk in it in characters.
CACHE_BYTES, CACHE_CHARS = 12 << 20, 64
#: Bytes of texts that are cut together, and bytes of distinct pieces that are merged together; only a stretch without white space, or a piece, can be longer.
BLOCK, MERGED = 4 << 20, 1 << 18
#: Fixed value: the split pattern that cut() follows for ASCII characters and Latin-1 letters, whose case and kind no Unicode version changes. Chunks with other characters and other patterns go through the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII white space of the split pattern. Python's also holds U+001C to U+001F; other white space is left to the library.
WHITE = re.compile("[\t-\r ]")
#: Kinds of bytes, of ASCII by themselves: white space, letters, digits, other characters, chunks for the library.
SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
KINDS = np.array([SPACE if 9 <= b <= 13 or b == 32 else DIGIT if 48 <= b < 58 else LETTER if chr(b).isalpha() and b < 128 else SYMBOL for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
#: Symbols from which a fragment is merged with a heap, in n log n.
LONG = 100
#: Rank of a pair that isn't merged.
NEVER = 1 << 30


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks(dict):
    """Ids of chunks by text. When a generation is full it becomes the old one, from which chunks that come again are taken over; the old one before it goes."""

    def __init__(self, find, most: int):
        self.find, self.most, self.size, self.old = find, most, 0, {}

    def all(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those that aren't known are found together."""
        out = [*map(self.get, chunks)]
        lost = [c for c, ids in zip(chunks, out) if ids is None]
        known = {c: self.old[c] for c in lost if c in self.old}
        new = [c for c in lost if c not in known]
        known |= zip(new, self.find(new) if new else ())
        for c, ids in known.items():
            if len(c) <= CACHE_CHARS:
                self.size += 180 + len(c) + len(ids)
                if self.size > self.most:
                    self.old, self.size = dict(self), 0
                    self.clear()
                self[c] = ids
        return [known[c] if ids is None else ids for c, ids in zip(chunks, out)]


class Encoder:
    """Encoding as the tokenizers library does it, for files with a split pattern, byte letters and word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # for its normaliser and split pattern, which follow a Unicode version of its own
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens, default=-1) + 1)]
        self.token_array = pa.array(self.tokens, pa.large_string())
        self.added_re = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.plain = PATTERN in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\") and "Lowercase" in json.dumps(spec["normalizer"])
        letters = byte_letters()
        self.bytes = {ord(c): chr(b) for b, c in letters.items()}
        #: Ids of single bytes, inside a piece and at its end, and whether two bytes are neighbours in any token.
        self.single = np.array([[vocab.get(letters[b] + e, -1) for b in range(256)] for e in ("", end)], np.int64)
        self.inside, byte = np.zeros((256, 256), bool), {c: b for b, c in letters.items()}
        for t in vocab:
            known = [byte.get(c) for c in (t.removesuffix(end) if end else t)]
            for x, y in zip(known, known[1:]):
                if x is not None and y is not None:
                    self.inside[x, y] = True
        #: Rank of each merge by its two ids, the same as sorted arrays (a last key matches none), and the id that it makes.
        self.rank, self.made = {}, np.full(len(model["merges"]), -1, np.int64)
        for i, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[x] << 32 | vocab[y]] = i
            self.made[i] = vocab[x + y]
        pairs = np.array([*self.rank.items(), ((1 << 63) - 1, NEVER)], np.int64)
        self.pairs, self.order = pairs[np.argsort(pairs[:, 0])].T.copy()
        self.chunks = Chunks(self.chunk, CACHE_BYTES)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        i = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[i] == key, self.order[i], NEVER)

    def merge(self, ids: np.ndarray, last: np.ndarray) -> None:
        """Merges in fragments, whose last symbols are marked: in each, lowest rank first, then leftmost. In place; a symbol that went into the one before it becomes -1.

        A round is one merge in each fragment that has any left.
        """
        at, symbols, last = np.arange(len(ids)), ids.copy(), last.copy()
        rank, i = np.full(len(ids), NEVER), np.flatnonzero(~last)
        rank[i] = self.ranks(ids[i], ids[i + 1])
        starts = np.flatnonzero(np.append(True, last[:-1]))
        sizes = np.diff(starts, append=len(ids))
        for i, n in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist()):
            ids[i : i + n] = self.merge_long(ids[i : i + n].tolist())
            rank[i : i + n] = NEVER
        while True:
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            live = least < NEVER << 32
            if not live.any():
                return
            first = least[live] & 0xFFFFFFFF
            symbols[first] = ids[at[first]] = self.made[least[live] >> 32]
            ids[at[first + 1]] = -1
            last[first] = last[first + 1]
            keep = np.repeat(live, np.diff(starts, append=len(rank)))
            keep[first + 1] = False
            first = (np.cumsum(keep) - 1)[first]
            at, symbols, last, rank = at[keep], symbols[keep], last[keep], rank[keep]
            starts = np.flatnonzero(np.append(True, last[:-1]))
            rank[first] = NEVER
            i = first[~last[first]]
            rank[i] = self.ranks(symbols[i], symbols[i + 1])
            i = first[first > 0] - 1
            i = i[~last[i]]
            rank[i] = self.ranks(symbols[i], symbols[i + 1])

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one fragment by a heap and a linked list."""
        n = len(symbols)
        nxt, prv, heap = [*range(1, n), -1], [*range(-1, n - 1)], []
        for i in range(n - 1):
            if (r := self.rank.get(symbols[i] << 32 | symbols[i + 1])) is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i] = int(self.made[r])
            symbols[j] = -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            if prv[i] >= 0 and (r := self.rank.get(symbols[prv[i]] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, (r, prv[i], symbols[prv[i]], symbols[i]))
            if nxt[i] >= 0 and (r := self.rank.get(symbols[i] << 32 | symbols[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[nxt[i]]))
        return symbols

    def cut(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of texts that lie one after the other in UTF-8 and begin at the given places: the bytes without white space in lower case, where pieces begin in these, which are chunks for the library (in their own case), and the number of pieces before each text.

        À to ÿ are two bytes, 0xC3 and one from 0x80 to 0xBF, of which 0x97 and 0xB7 make no letters.
        """
        n = len(data)
        kind, low, first = KINDS[data], LOWER[data], np.zeros(n + 1, bool)
        first[begins] = True
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
        kind[second] = kind[second - 1] = LETTER
        low[second[data[second] < 0x9F]] += 32
        other = (data >= 128) & (kind != LETTER) if self.plain else kind != SPACE
        if other.any():
            begin = first[:-1].copy()
            begin[1:] |= kind[:-1] == SPACE
            begin = np.flatnonzero(begin)
            whole = np.repeat(np.logical_or.reduceat(other, begin), np.diff(begin, append=n)) & (kind != SPACE)
            kind[whole], low[whole] = OTHER, data[whole]
        starts = first[:-1] | (kind == DIGIT)
        starts[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero((data == 39) & (kind == SYMBOL) & starts)
        for suffixes in (("s", "t", "m", "d"), ("re", "ve", "ll")):  # after a ', in the same text
            size = len(suffixes[0])
            near = at[at + size < n]
            tails = np.stack([low[near + i] for i in range(1, size + 1)])
            fits = np.any([(tails == np.frombuffer(x.encode(), np.uint8)[:, None]).all(0) for x in suffixes], 0)
            near = near[fits & ~np.any([first[near + i] for i in range(1, size + 1)], 0)]
            starts[near + 1] = False
            starts[near[near + size + 1 < n] + size + 1] = True
        keep = kind != SPACE
        starts &= keep
        before = np.append(0, np.cumsum(starts))[begins]
        at = np.flatnonzero(starts[keep])
        return low[keep], at, kind[keep][at] == OTHER, before

    def pieces(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of the split pattern, which lie one after the other in UTF-8, and how many each has: forced cuts, then all fragments together."""
        if len(sizes) > 1 and len(data) > MERGED:
            half = len(sizes) // 2
            at = int(sizes[:half].sum())
            return tuple(map(np.concatenate, zip(self.pieces(data[:at], sizes[:half]), self.pieces(data[at:], sizes[half:]))))
        ends = np.zeros(len(data), np.int8)
        ends[np.cumsum(sizes) - 1] = 1
        ids, word = self.single[ends, data], np.repeat(np.arange(len(sizes)), sizes)
        if (ids < 0).any():  # the library leaves bytes out that have no token
            word, data, ids = word[ids >= 0], data[ids >= 0], ids[ids >= 0]
        if len(ids):
            self.merge(ids, np.append((word[1:] != word[:-1]) | ~self.inside[data[:-1], data[1:]], True))
        return ids[ids >= 0].astype("<u4"), np.bincount(word[ids >= 0], minlength=len(sizes))

    def chunk(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of texts without added tokens, cut by the library; white space in them separates."""
        words, ends = [], [0]
        for text in texts:
            words += [p.translate(self.bytes).encode("latin-1") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
            ends.append(len(words))
        ids, counts = self.pieces(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        out, at = ids.tobytes(), (4 * np.append(0, np.cumsum(counts))[ends]).tolist()
        return [out[i:j] for i, j in zip(at, at[1:])]

    def block(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin at these places, and where each text's ids end."""
        low, at, other, before = self.cut(data, begins) if len(data) else [np.zeros(0, np.int64)] * 4
        if not len(at):
            return np.zeros(0, "<u4"), np.zeros(len(begins), np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(low))), pa.py_buffer(low)]).dictionary_encode()
        words, which = found.dictionary, found.indices.to_numpy()
        odd = np.zeros(len(words), bool)
        odd[which] = other
        sizes = pc.binary_length(words).to_numpy()
        ids, counts = self.pieces(np.frombuffer(words.buffers()[2], np.uint8)[: sizes.sum()][np.repeat(~odd, sizes)], sizes[~odd])
        if odd.any():
            more = [np.frombuffer(b, "<u4") for b in self.chunks.all([w.decode() for w in words.filter(pa.array(odd)).to_pylist()])]
            ids, counts = np.concatenate([ids, *more]), np.append(counts, [*map(len, more)])
        place = np.empty(len(words), np.int64)
        place[np.argsort(odd, kind="stable")] = np.arange(len(words))
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), pa.array(ids)).take(pa.array(place[which]))
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()[np.append(before[1:], len(at))]

    def parts(self, text: str):
        """Stretches of a text of some BLOCK characters, cut before white space, each with the id of the added token that follows, if any (else -1)."""
        at = 0
        for m in [*(self.added_re.finditer(text) if self.added_re else ()), None]:
            end = m.start() if m else len(text)
            while end - at > BLOCK and (white := WHITE.search(text, at + BLOCK, end)):
                yield text[at : white.start()], -1
                at = white.start()
            yield text[at:end], self.added[m[0]] if m else -1
            at = m.end() if m else end

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after the other, and where each text's ids end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        if at[-1] - at[0] <= BLOCK and not any(pc.any(pc.match_substring(texts, a)).as_py() for a in self.added):
            return self.block(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at[:-1] - at[0])
        ids, ends, added, last, some, size = [], [], [], [], [], 0
        for text in texts:
            for part, token in self.parts(text.as_py()):
                some.append(part.encode())
                added.append(token)
                size += len(some[-1])
                if size >= BLOCK:
                    self.add(some, ids, ends)
                    some, size = [], 0
            last.append(len(added) - 1)
        self.add(some, ids, ends)
        ids, ends, added = np.concatenate(ids), np.concatenate(ends), np.array(added)
        here = added >= 0
        return np.insert(ids, ends[here], added[here].astype("<u4")), (ends + np.cumsum(here))[last]

    def add(self, some: list[bytes], ids: list[np.ndarray], ends: list[np.ndarray]) -> None:
        """Appends the ids of some texts, and where each one's end of all."""
        got, at = self.block(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])[:-1])
        ends.append(at + sum(map(len, ids)))
        ids.append(got)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.large_string()))[0].tobytes()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), self.token_array.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))

    def decode(self, ids: bytes) -> str:
        return self.decode_all(np.frombuffer(ids, "<u4"), np.array([len(ids) // 4]))[0].as_py()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    """The vocabulary file where the package public_tokenizers or /opt/tokenizers is."""
    try:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")
    except ImportError:
        return "/opt/tokenizers/word_bpe_49k.json"


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", digests_only: bool = False, with_decoded: bool = True) -> DataFrame:
    """Per row of docs: ``d`` (the row as a struct, with digests_only: doc_id alone), n_tokens, ids (array; not with digests_only), ids_sha256, decoded (not with digests_only, or without with_decoded), decoded_sha256.

    Null and empty texts have no ids and decode to an empty text. Lone surrogates can't occur in Spark's strings. Very long texts are encoded whole, in time proportional to n log n of the longest
    fragment. Repeated rows get a result each; the other columns, whatever their names, stay in ``d``. ``path`` must be readable on all executors, or be in spark.files by its base name.
    """
    path = path or default_path()
    base = os.path.basename(path)

    def each(batches):
        own = path if os.path.exists(path) else SparkFiles.get(base) if os.path.exists(SparkFiles.get(base)) else default_path()
        e = encoder(own)
        for whole in batches:
            for batch in pieces(whole):
                ids, ends = e.encode_all(batch.column("t"))
                decoded = e.decode_all(ids, ends)
                begins, view = np.append(0, ends[:-1]), memoryview(ids.tobytes())
                cols = {"d": batch.column("d"), "n_tokens": pa.array(ends - begins)}
                if not digests_only:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view("<i4")))
                cols["ids_sha256"] = pa.array([hashlib.sha256(view[4 * i : 4 * j]).hexdigest() for i, j in zip(begins.tolist(), ends.tolist())], pa.string())
                if with_decoded and not digests_only:
                    cols["decoded"] = decoded.cast(pa.string())
                cols["decoded_sha256"] = pa.array([hashlib.sha256(s.as_buffer()).hexdigest() for s in decoded], pa.string())
                yield pa.RecordBatch.from_arrays([*cols.values()], [*cols])

    rows = docs.select(F.struct("doc_id" if digests_only else "*").alias("d"), F.col(text_col).alias("t"))
    kind = rows.schema["d"].dataType.simpleString()
    more = "ids_sha256 string, decoded_sha256 string" if digests_only else f"ids array<int>, ids_sha256 string, {'decoded string, ' if with_decoded else ''}decoded_sha256 string"
    return rows.mapInArrow(each, f"d {kind}, n_tokens bigint, {more}")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), digests_only=True).select("d.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

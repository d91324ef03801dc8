"""Groups spelling variants: words of distance one (one code point inserted, deleted or replaced), found by Levenshtein automata on shards of a compact trie.

Counting and following forms are DataFrame plans. The vocabulary is cut, in code-point order, into shards of a bounded number of bytes, each a compact trie (edges are labelled by strings), and bounded groups of shards are broadcast one after the other. A word's
automaton of distance one is run on every shard depth-first: down the word's own path without an error, and at each place where the trie leaves that path on along the three ways to spend the one error, after which a single path is left. Near words are reduced where they
are found, to their number and the best of them, so a word gives one row for each group, however many neighbours it has.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stage

#: Code points of a word, its occurrences, and how many times as frequent its form must be.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many (document, run) pairs loses a code point.
SLIPS = 199
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words in a shard (one longer word is a shard by itself), and in a group of shards, which takes some 30 times as much in a worker.
SHARD_BYTES, GROUP_BYTES = 1 << 20, 4 << 20


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = SLIPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: distinct words of the texts, after slips, with at least so many code points and occurrences."""
    whole = RUN.replace("+", f"{{{least_length},}}")  # shorter runs can't give a word
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(whole), 0)).alias("raw"))
    runs = runs.select("k", F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(F.translate("raw", UPPER, LOWER)).alias("w"))
    runs = runs.select("w", F.crc32(F.encode(F.concat("k", F.lit(":"), "w"), "UTF-8")).alias("h"), F.length("w").alias("len"))
    at = (F.col("h") % F.col("len")).cast("int")
    words = runs.select(F.when(F.col("h") % slips != 0, F.col("w")).otherwise(F.concat(F.col("w").substr(F.lit(1), at), F.col("w").substr(at + 2, F.col("len")))).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A compact trie over sorted distinct words. Node v is reached by ``label[v]`` and has the children first[v], first[v] + 1, ...; ``heads[v]`` are the first code points of their labels in order, ``n[v]`` is the count of the word that ends at v, or 0."""

    def __init__(self, words: list[str], counts: list[int]):
        self.label, self.heads, self.first, self.n = [""], [""], [0], [0]
        todo = [(0, 0, len(words), 0)]  # node, its words, their code points on the way to it
        while todo:
            v, lo, hi, depth = todo.pop()
            if lo < hi and len(words[lo]) == depth:
                self.n[v] = counts[lo]
                lo += 1
            self.first[v] = len(self.label)
            heads = []
            while lo < hi:
                head, end = words[lo][depth], self._end(words, lo, hi, depth)
                a, b = words[lo], words[end - 1]
                to = depth + 1
                most = min(len(a), len(b))
                while to < most and a[to] == b[to]:
                    to += 1
                heads.append(head)
                todo.append((len(self.label), lo, end, to))
                self.label.append(a[depth:to])
                self.heads.append("")
                self.first.append(0)
                self.n.append(0)
                lo = end
            self.heads[v] = "".join(heads)

    @staticmethod
    def _end(words: list[str], lo: int, hi: int, depth: int) -> int:
        """The first word after lo whose code point at depth is another one."""
        head, step = words[lo][depth], 1
        while lo + step < hi and words[lo + step][depth] == head:
            step *= 2
        left, right = lo + step // 2, min(hi, lo + step)
        while left + 1 < right:
            mid = (left + right) // 2
            if words[mid][depth] == head:
                left = mid
            else:
                right = mid
        return left + 1

    def rest(self, v: int, w: str, i: int) -> int:
        """The node at which the code points of w from i on end, followed from node v; -1 if there is no such word."""
        while i < len(w):
            at = self.heads[v].find(w[i])
            if at < 0:
                return -1
            v = self.first[v] + at
            s = self.label[v]
            if not w.startswith(s, i):
                return -1
            i += len(s)
        return v if self.n[v] else -1

    def tail(self, v: int, k: int, w: str, i: int) -> int:
        """The same from within the label of v, of which k code points have been read."""
        s = self.label[v]
        if len(s) - k == 1:  # most labels are short
            return self.rest(v, w, i + 1) if i < len(w) and w[i] == s[k] else -1
        if k < len(s):
            if not w.startswith(s[k:], i):
                return -1
            i += len(s) - k
        return self.rest(v, w, i)

    def near(self, w: str):
        """(word, count) of each word of distance one: the automaton's errorless path depth-first, and from each of its places the ways that spend the error where a word first leaves w."""
        heads, first, label, n = self.heads, self.first, self.label, self.n
        v, i, size = 0, 0, len(w)
        while True:
            if i == size - 1 and n[v]:  # w's last code point deleted
                yield w[:i], n[v]
            own = w[i] if i < size else ""
            ahead, go = heads[v], -1
            child = first[v] - 1
            for x in ahead:
                child += 1
                if x == own:
                    go = child
                    continue
                s = label[child]
                if i < size:
                    # w[i] replaced by x; a label that goes on otherwise than w can't be followed
                    if (len(s) == 1 or w.startswith(s[1:], i + 1)) and (t := self.rest(child, w, i + len(s))) >= 0:
                        yield w[:i] + x + w[i + 1 :], n[t]
                    if i + 1 < size and w[i + 1] == x and w.startswith(s, i + 1) and (t := self.rest(child, w, i + 1 + len(s))) >= 0:  # w[i] deleted
                        yield w[:i] + w[i + 1 :], n[t]
                if (len(s) == 1 or w.startswith(s[1:], i)) and (t := self.rest(child, w, i + len(s) - 1)) >= 0:  # x inserted before w[i]
                    yield w[:i] + x + w[i:], n[t]
            if go < 0:
                return
            s = label[go]
            if not w.startswith(s, i):  # the path is left within a label, at its code point k
                k, most = 1, min(len(s), size - i)
                while k < most and s[k] == w[i + k]:
                    k += 1
                p = i + k
                if k == len(s):
                    return
                if p < size:
                    if (t := self.tail(go, k + 1, w, p + 1)) >= 0:
                        yield w[:p] + s[k] + w[p + 1 :], n[t]
                    if (t := self.tail(go, k, w, p + 1)) >= 0:
                        yield w[:p] + w[p + 1 :], n[t]
                if (t := self.tail(go, k + 1, w, p)) >= 0:
                    yield w[:p] + s[k] + w[p:], n[t]
                return
            v, i = go, i + len(s)

    def pack(self) -> bytes:
        import marshal

        return marshal.dumps((self.label, self.heads, self.first, self.n))

    @classmethod
    def unpack(cls, raw: bytes) -> Trie:
        import marshal

        out = cls.__new__(cls)
        out.label, out.heads, out.first, out.n = marshal.loads(raw)
        return out


def trie_shards(vocabulary: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed tries (part, shard, bytes, trie) over ranges of the vocabulary's words; a word longer than a shard has one of its own."""

    def each(batches):
        words, counts, size, shard = [], [], 0, 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([Trie(words, counts).pack()], pa.binary())], ["shard", "bytes", "trie"])

        for b in batches:
            for w, n in zip(b.column("word"), b.column("n").to_pylist()):
                w = w.as_py()
                if words and size + len(w) > shard_bytes:
                    yield made()
                    words, counts, size, shard = [], [], 0, shard + 1
                words.append(w)
                counts.append(n)
                size += len(w)
        if words:
            yield made()

    sorted_words = vocabulary.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return sorted_words.mapInArrow(each, "shard int, bytes bigint, trie binary").withColumn("part", F.spark_partition_id())


_open: dict = {}


def _neighbours(vocabulary: DataFrame, group: list, name: str) -> DataFrame:
    """word, n_near, best (a struct of minus the count and the word): over the words of a group of shards."""
    shared = vocabulary.sparkSession.sparkContext.broadcast([bytes(r["trie"]) for r in group])

    def each(batches):
        if name not in _open:
            _open.clear()
            _open[name] = [Trie.unpack(t) for t in shared.value]
        tries = _open[name]
        for b in batches:
            words, many, best_n, best = [], [], [], []
            for w in b.column("word"):
                w = w.as_py()
                count, top, form = 0, 0, None
                for trie in tries:
                    for near, n in trie.near(w):
                        count += 1
                        if n > top or (n == top and near < form):
                            top, form = n, near
                if count:
                    words.append(w)
                    many.append(count)
                    best_n.append(-top)
                    best.append(form)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(many, pa.int64()), pa.StructArray.from_arrays([pa.array(best_n, pa.int64()), pa.array(best, pa.string())], ["minus", "form"])], ["word", "n_near", "best"])

    out = stage(vocabulary.select("word").repartition(F.col("word")).mapInArrow(each, "word string, n_near bigint, best struct<minus: bigint, form: string>"), "near")
    shared.destroy()
    return out


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per word of a vocabulary (distinct word, n): word, n, n_near, form, form_n, root.

    Two words are near if they differ by one code point inserted, deleted or replaced. ``form`` is the near word of the largest n (ties: the first in code-point order) if that is at least ``ratio`` (2 or more) times the word's n, else null;
    root follows forms to the last one, and is the word itself if it has none. Null words are left out; other columns are ignored; an empty vocabulary gives no rows. Words of any length are whole.
    """
    words = vocabulary.where("word is not null").select("word", "n")
    shards = stage(trie_shards(words, shard_bytes), "tries")
    groups, size = [[]], 0
    for r in shards.select("part", "shard", "bytes").orderBy("part", "shard").toLocalIterator():  # a row for each shard
        if groups[-1] and size + r["bytes"] > group_bytes:
            groups.append([])
            size = 0
        groups[-1].append((r["part"], r["shard"]))
        size += r["bytes"]
    found = []
    for i, group in enumerate(groups if groups[0] else []):
        (part, shard), (last_part, last_shard) = group[0], group[-1]
        after = (F.col("part") > part) | ((F.col("part") == part) & (F.col("shard") >= shard))
        before = (F.col("part") < last_part) | ((F.col("part") == last_part) & (F.col("shard") <= last_shard))
        rows = shards.where(after & before).select("trie").collect()  # one bounded group
        found.append(_neighbours(words, rows, f"{shards.inputFiles()[0]}-{i}"))
    if not found:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root"))
    near = reduce(DataFrame.unionByName, found).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    good = -F.col("best.minus") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"))
    out = stage(out, "forms")
    return out.join(_roots(out.where("form is not null").select("word", F.col("form").alias("to"))), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, to; to has a count several times as large, so chains are short and free of cycles) lead. Each round doubles the steps."""
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        links = stage(links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("went")), "links")
        if links.where("went").isEmpty():
            return links.select("word", F.col("to").alias("root"))
        links = links.drop("went")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    words = stage(word_counts(documents(spark, sf_dir)), "words")
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def _sql() -> str:
    lower = f"translate(w, '{UPPER}', '{LOWER}')"
    table = "list_transform(range(0, 256), lambda x: list_reduce(list_concat([x::ubigint], range(0, 8)::ubigint[]), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end))"
    return f"""
with tab as materialized (select {table} as t),
runs as (select doc_id, {lower} as w, count(*) as c from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as w from documents) group by all),
raw as materialized (select w, c, hex(encode(doc_id::varchar || ':' || w)) as x from runs where length(w) >= 6),
crc as (select w, c, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(x), 2), lambda i: ((instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)::ubigint)),
  lambda s, b: xor(s >> 8, t[(xor(s, b) & 255)::int + 1])), 4294967295::ubigint) as h from raw, tab),
slip as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, c from crc),
voc as materialized (select word, sum(c)::bigint as n from slip where length(word) >= 6 group by word having sum(c) >= 5),
cut as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as s from voc, lateral (select unnest(range(1, length(word) + 1)) as i)),
pairs as (select distinct a, b from (
  select x.word as a, y.word as b from cut x join cut y on x.i = y.i and x.s = y.s and length(x.word) = length(y.word) and x.word <> y.word
  union all select c.word, v.word from cut c join voc v on c.s = v.word
  union all select v.word, c.word from cut c join voc v on c.s = v.word)),
near as (select a as word, count(*) as n_near, max(n) as top, arg_min(b, (-n, encode(b))) as best from pairs join voc on voc.word = b group by a),
forms as materialized (select v.word, n, coalesce(n_near, 0) as n_near, case when top >= 5 * n then best end as form, case when top >= 5 * n then top end as form_n from voc v left join near using (word)),
walk as (with recursive r as (select word, form as cur, 1 as step from forms where form is not null union all select r.word, f.form, step + 1 from r join forms f on f.word = r.cur where f.form is not null) select word, arg_max(cur, step) as root from r group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from forms left join walk using (word)
"""


SQL = _sql()

"""Predicts languages word by word, with shorter and shorter character n-grams for words the model doesn't know.

Training counts words, and distinct words that hold an n-gram, by language over a bounded, documented sample of labelled rows; all of them are kept, so the sample bounds the model. A known word scores its log relative frequency in each
language. An unknown word falls back to its n-grams of the longest length of which any is known, from MAX_N down to 1; their mean log frequency, less a penalty for each length skipped, is its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, stage

#: Distinct texts of each language to learn from, about (a hash decides).
TRAIN_ROWS = 2_000
MAX_N = 4
#: What each length of n-grams that is skipped costs.
SKIP = math.log(4)
LETTERS = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers the scores of.
CACHE = 60_000


def grams(word: str, n: int) -> list[str]:
    w = f"␂{word}␃" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def key(words: list[str]) -> np.ndarray:
    """Spark's xxhash64 of the words."""
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words], np.uint64)


def _logs(c: np.ndarray) -> np.ndarray:
    """Log frequencies in each language (columns) of counts."""
    return np.log((c + 0.1) / (c.sum(0) + 0.1 * max(len(c), 1))).astype(np.float32)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Model from the labelled rows of docs, about ``rows`` distinct texts of each language: languages, known words by a 64-bit hash with their log frequencies, and those of n-grams."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"))
    labelled = labelled.withColumn("h", F.shiftrightunsigned(F.xxhash64("lang", "t"), 1))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # of distinct texts: copies don't thin out the sample
    if any(n > 1.1 * rows for n in sizes.values()):
        share = F.create_map(*[F.lit(x) for v, n in sizes.items() for x in (v, (1 << 63) - 1 if n <= 1.1 * rows else int((1 << 63) / n * rows))])
        labelled = labelled.where(F.col("h") <= share[F.col("lang")]).dropDuplicates(["lang", "h"])
    labelled = labelled.drop("h")

    def count(batches):
        for whole in batches:
            for b in pieces(whole):
                total: dict[str, Counter] = {}
                for lang, t in zip(b.column("lang").to_pylist(), b.column("t")):
                    total.setdefault(lang, Counter()).update(LETTERS.findall(t.as_py().lower()))
                for lang, c in total.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "c"])

    counts = stage(labelled.mapInArrow(count, "lang string, word string, c bigint").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())

    def by_language(rows: DataFrame, of: str, value) -> tuple[np.ndarray, np.ndarray]:
        """Values of a column, sorted, with a count for each language; the driver gets numbers, no more rows than the sample has words."""
        wide = rows.groupBy(of).pivot("lang", langs).agg(value).na.fill(0).toPandas().sort_values(of)
        return wide[of].to_numpy(), wide[langs].to_numpy(float).reshape(len(wide), len(langs))

    if not langs:
        return {"langs": [], "words": np.empty(0, np.uint64), "logs": np.empty((0, 0), np.float32), "grams": {}}
    k, c = by_language(counts.select("lang", "c", F.xxhash64("word").alias("k")), "k", F.sum("c"))
    k = k.astype(np.int64).view(np.uint64)
    by = np.argsort(k)
    model = {"langs": langs, "words": k[by], "logs": _logs(c)[by], "grams": {}}
    for n in range(1, MAX_N + 1):
        w = F.concat(F.lit("␂"), "word", F.lit("␃")) if n > 1 else F.col("word")
        cut = counts.select("lang", w.alias("w")).where(F.length("w") >= n).select("lang", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(w) - {n} + 1), i -> substring(w, i, {n}))"))).alias("word"))
        parts, c = by_language(cut, "word", F.count(F.lit(1)))
        model["grams"][n] = ({g: i for i, g in enumerate(parts.tolist())}, _logs(c))
    return model


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """Scores (words, languages)."""
    out = np.zeros((len(words), len(model["langs"])), np.float32)
    if not len(model["words"]):
        return out
    k = key(words)
    at = np.minimum(np.searchsorted(model["words"], k), len(model["words"]) - 1)
    known = model["words"][at] == k
    out[known] = model["logs"][at[known]]
    left = np.flatnonzero(~known).tolist()
    for n in range(MAX_N, 0, -1):
        (table, logs), found, size, own, rest = model["grams"][n], [], [], [], []
        for i in left:
            got = [table[g] for g in grams(words[i], n) if g in table]
            if got:
                found += got
                size.append(len(got))
                own.append(i)
            else:
                rest.append(i)
        if own:
            size = np.array(size)
            out[own] = np.add.reduceat(logs[found], np.cumsum(size) - size, axis=0) / size[:, None] - SKIP * (MAX_N - n + 1)
        left = rest
    return out


class Scores:
    """Scores of words, those of earlier words remembered in a matrix of a bounded number of rows."""

    def __init__(self, model: dict, most: int = CACHE):
        self.model, self.most, self.row, self.held = model, most, {}, np.empty((most, len(model["langs"])), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > self.most:
            self.row, new = {}, words
            if len(new) > self.most:
                return word_scores(self.model, words)
        if new:
            at = len(self.row)
            self.held[at : at + len(new)] = word_scores(self.model, new)
            self.row.update(zip(new, range(at, at + len(new))))
        return self.held[[*map(self.row.__getitem__, words)]]


def predict_text(scores: Scores, text: str | None) -> tuple[str, float]:
    """The likeliest language and its probability if each word's evidence is independent, tempered by the square root of the number of words."""
    words, langs = LETTERS.findall(text.lower()) if text else [], scores.model["langs"]
    if not words or not langs:
        return "und", 0.0
    c = Counter(words)
    total = np.array([*c.values()], dtype=float) @ scores.of([*c]).astype(float)
    p = total / math.sqrt(len(words))
    p = np.exp(p - p.max())
    i = int(total.argmax())
    return langs[i], float(p[i] / p.sum())


def predict(docs: DataFrame, model: dict, carry: list[str], text_col: str = "text") -> DataFrame:
    """Per row of docs: ``d`` (the carried columns), lang_pred, score (0 to 1).

    Null, empty and letterless texts: 'und' with score 0; so are all rows if there was nothing to learn from. Ties go to the language that sorts first. Whole texts are read, and nothing but the text. Repeated rows get a result each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        scores = Scores(shared.value)
        for whole in batches:
            for b in pieces(whole):
                got = [predict_text(scores, t.as_py()) for t in b.column("t")]
                yield pa.RecordBatch.from_arrays([b.column("d"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["d", "lang_pred", "score"])

    rows = docs.select(F.struct(*carry).alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(each, f"d {rows.schema['d'].dataType.simpleString()}, lang_pred string, score double")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5
    model = train(docs.where(fold != 0))
    out = predict(docs, model, ["doc_id"]).select("d.doc_id", "lang_pred", "score")
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

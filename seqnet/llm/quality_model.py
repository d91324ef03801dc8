"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown in numpy on a bounded sample of labelled rows; each path from a root is a rule, a conjunction of comparisons. A logistic regression with an L1 penalty (accelerated
proximal gradient) gives the rules weights, most of them 0. The rules that are left are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, some_rows

#: Labelled documents to learn from, about (a hash of doc_id decides).
TRAIN_ROWS = 20_000
TREES, DEPTH, LEAST_LEAF, PENALTY = 24, 3, 10, 2e-3
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "distinct_share", "top_word_share", "dup_line_share", "words_a_line", "end_share", "mark_share", "stop_share")
_KEEP = lambda chars: bytes(b for b in range(256) if b not in chars)
_SYMBOLS, _UPPER, _DIGITS, _MARKS = _KEEP(b"#*$%&|<>"), _KEEP(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _KEEP(b"0123456789"), _KEEP(b"!?")


def features(text: str | None) -> list[float]:
    """Statistics of a whole text; all 0 without words."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    short = sum(c for w, c in count.items() if len(w) <= 3)
    return [float(n), size / n, len(raw.translate(None, _SYMBOLS)) / size, len(raw.translate(None, _UPPER)) / size, len(raw.translate(None, _DIGITS)) / size, len(count) / n, max(count.values()) / n, 1 - len(set(lines)) / len(lines), n / len(lines), ends / len(lines), len(raw.translate(None, _MARKS)) / n, short / n]


def with_features(rows: DataFrame) -> DataFrame:
    """rows (d, t) as d and a double for each statistic."""

    def each(batches):
        for whole in batches:
            for b in pieces(whole):
                got = np.array([features(t.as_py()) for t in b.column("t")], dtype=float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column("d"), *[pa.array(got[:, i]) for i in range(len(FEATURES))]], ["d", *FEATURES])

    return rows.mapInArrow(each, f"d {rows.schema['d'].dataType.simpleString()}, " + ", ".join(f"{f} double" for f in FEATURES))


def _grow(x, y, depth, rng, path, rules):
    """Adds the rules of a tree on residuals y: each node's path."""
    if path:
        rules.add(tuple(sorted(path)))
    if depth == 0 or len(y) < 2 * LEAST_LEAF:
        return
    best = None
    for j in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
        by = np.argsort(x[:, j], kind="stable")
        v, s = x[by, j], np.cumsum(y[by])
        cut = np.nonzero(v[1:] > v[:-1])[0]
        cut = cut[(cut + 1 >= LEAST_LEAF) & (len(y) - cut - 1 >= LEAST_LEAF)]
        if not len(cut):
            continue
        left = cut + 1.0
        gain = s[cut] ** 2 / left + (s[-1] - s[cut]) ** 2 / (len(y) - left)
        i = int(gain.argmax())
        if best is None or gain[i] > best[0]:
            best = (gain[i], int(j), float(np.round((v[cut[i]] + v[cut[i] + 1]) / 2, 9)))
    if best is None or best[0] <= y.sum() ** 2 / len(y) + 1e-9:
        return
    _, j, at = best
    low = x[:, j] <= at
    _grow(x[low], y[low], depth - 1, rng, path + [(j, "<=", at)], rules)
    _grow(x[~low], y[~low], depth - 1, rng, path + [(j, ">", at)], rules)


def _holds(x, rule):
    return np.logical_and.reduce([x[:, j] <= at if op == "<=" else x[:, j] > at for j, op, at in rule])


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[list[tuple], np.ndarray, float]:
    """Rules with weights other than 0, the weights, the intercept. Both classes weigh the same."""
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return [], np.zeros(0), 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    w = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    rules: set = set()
    f = np.zeros(len(y))
    for _ in range(TREES):  # each tree on a half of the rows, against what the earlier ones leave
        half = rng.random(len(y)) < 0.5
        own: set = set()
        _grow(x[half], ((y - 1 / (1 + np.exp(-f))) * w)[half], DEPTH, rng, [], own)
        rules |= own
        z = np.array([_holds(x, r) for r in sorted(own)], dtype=float).T if own else np.zeros((len(y), 0))
        for k in range(z.shape[1]):
            m = z[:, k] > 0
            if m.any():
                f += 0.3 * z[:, k] * ((y - 1 / (1 + np.exp(-f))) * w)[m].mean()
    rules_list = sorted(rules)
    z = np.array([_holds(x, r) for r in rules_list], dtype=float).T
    beta, b = np.zeros(z.shape[1]), 0.0
    look, lb, t = beta.copy(), b, 1.0
    step = 4.0 / (w.max() * (np.square(z).sum(axis=1).max() + 1))
    for _ in range(800):
        r = w * (1 / (1 + np.exp(-np.clip(z @ look + lb, -30, 30))) - y) / len(y)
        nb = lb - step * len(y) * r.sum() / len(y)
        g = look - step * (z.T @ r)
        new = np.sign(g) * np.maximum(np.abs(g) - step * PENALTY, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, lb = new + (t - 1) / t2 * (new - beta), nb + (t - 1) / t2 * (nb - b)
        beta, b, t = new, nb, t2
    use = np.abs(beta) > 1e-4
    return [r for r, u in zip(rules_list, use) if u], beta[use], float(b)


def compile_rules(rules: list[tuple], weights: np.ndarray, intercept: float) -> Column:
    """The ensemble's probability as a column over the statistics."""
    total = F.lit(float(intercept))
    for rule, weight in zip(rules, weights):
        cond = reduce(lambda a, b: a & b, [F.col(FEATURES[j]) <= at if op == "<=" else F.col(FEATURES[j]) > at for j, op, at in rule])
        total = total + F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_col: str = "text") -> tuple[list[tuple], np.ndarray, float]:
    """Rules from the labelled documents, about ``rows`` of them (by a hash of doc_id) if there are more. Labels other than 0 and 1 are left out; of a doc_id with several labels the largest counts, of one with several texts the one with the least hash."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(F.col("doc_id").alias("k"), "quality")
    known = F.broadcast(some_rows(known, rows, "k"))  # about ``rows`` rows at most
    both = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("k"), F.col(text_col).alias("t")).join(known, "k")
    # statistics are taken where the texts are; only numbers move
    stats = with_features(both.select(F.struct("k", "quality", F.xxhash64("t").alias("h")).alias("d"), "t"))
    one = stats.groupBy("d.k", "d.quality").agg(F.min_by(F.struct(*FEATURES), "d.h").alias("x"))
    got = one.select("k", "quality", "x.*").toPandas().sort_values("k")
    return fit_rules(got[list(FEATURES)].to_numpy(float), got["quality"].to_numpy(float))


def score(docs: DataFrame, model, carry: list[str], text_col: str = "text") -> DataFrame:
    """Per row of docs: ``d`` (the carried columns), score, predicted.

    Null and empty texts have statistics of 0 and a score like any other. Very long texts count whole. With no labels the score is 0.5; with one class only it is that class's. Repeated rows get a result each; extra columns are ignored unless carried.
    """
    rows = docs.select(F.struct(*carry).alias("d"), F.col(text_col).alias("t"))
    out = with_features(rows).withColumn("score", compile_rules(*model))
    return out.select("d", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3
    model = train(docs.where(fold != 1), labels)
    out = score(docs, model, ["doc_id"]).select("d.doc_id", "score", "predicted")
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")

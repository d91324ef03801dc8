"""From fits to report sheets: models with their flags, precision records, and a folder of fits that is evaluated once.

A fit is named by method and name; its matrices are rows (method, name, family, cluster_idx, theta: packed). A model more, the mean of the others weighted by the sizes of their clusters, is made for each fit where its matrices are; a task holds the matrices of one fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqnet.operators.contacts import FIXED, NORMAL, Q, SHARES, TOP, ranked
from seqnet.functions.residues import native_contact
from seqnet.operators.matrix import unpack
from seqnet.operators.reports import report
from seqnet.operators.tables import written

FIT = ["method", "name", "family"]
MODELS = "method string, name string, family string, model_idx int, is_avg boolean, positions int, s1 double, i array<int>, j array<int>, score array<double>"
RECORDS = "ty string, min_sep int, max_sep int, cutoff string, k bigint, precision double"


def models(fits: DataFrame, sizes: DataFrame, cutoff: float = 1e-4) -> DataFrame:
    """A row for each model of a fit, the mean one last: method, name, family, model_idx, is_avg, positions, s1 (density of the blocks i < j from 1e-3 on, over all cells) and its contact scores (i, j from 1, score).

    sizes (family, cluster_idx, n) weigh the mean; a fit of a family without sizes has its first model's. Entries below the cutoff are 0, after the mean is made. A fit with a missing matrix, or with a model of zeros only, has no rows. An empty table gives none.
    """
    rows = fits.select(*FIT, "cluster_idx", "theta").join(sizes.select("family", "cluster_idx", F.col("n").cast("double").alias("n")), ["family", "cluster_idx"], "left")

    def each(t: pa.Table) -> pa.Table:
        own = sorted(t.select(["cluster_idx", "theta", "n"]).to_pylist(), key=lambda r: r["cluster_idx"])
        out = []
        if all(r["theta"] for r in own):
            mats = [unpack(np.array(r["theta"], float)) for r in own]
            w = np.array([r["n"] or 0.0 for r in own])
            w = w / w.sum() if w.sum() > 0 else np.eye(len(own))[0]
            mats.append(sum(x * m for x, m in zip(w, mats)))
            for k, m in enumerate(mats):
                m = np.where(np.abs(m) < cutoff, 0.0, m)
                if not m.any():
                    out = []
                    break
                n = len(m) // Q
                blocks = m.reshape(n, Q, n, Q)
                i, j = np.triu_indices(n, 1)
                dense = (np.abs(blocks.transpose(0, 2, 1, 3)[i, j]) >= 1e-3).sum()
                score = np.abs(blocks[:, : Q - 1, :, : Q - 1]).sum((1, 3))[i, j]
                out.append((k, k == len(mats) - 1, n, 2.0 * dense / len(m) ** 2, (i + 1).tolist(), (j + 1).tolist(), score.tolist()))
        key = [pa.array([t.column(c)[0].as_py()] * len(out), pa.string()) for c in FIT]
        kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        return pa.table(key + [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=[f.split()[0] for f in MODELS.split(", ")])

    return rows.groupBy(*FIT).applyInArrow(each, MODELS)


def scored(models_: DataFrame) -> DataFrame:
    """Models as rows for each pair of positions: method, name, family, model_idx, is_avg, s1, i, j, score."""
    keep = [*FIT, "model_idx", "is_avg", "s1"]
    return models_.select(*keep, F.explode(F.arrays_zip("i", "j", "score")).alias("x")).select(*keep, "x.i", "x.j", "x.score")


def with_flags(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (method, name, family, model_idx, is_avg) with is_target (a cluster after the first, not the mean model, that holds the target) and is_final (the name says so, or the family has no clusters); targets (family, cluster_idx, is_target) from cluster.with_target."""
    known = targets.select("family", F.col("cluster_idx").alias("model_idx"), F.col("is_target").alias("t"))
    families = targets.select("family", F.lit(True).alias("clustered")).distinct()
    out = rows.join(known, ["family", "model_idx"], "left").join(families, "family", "left")
    return out.withColumn("is_target", F.coalesce(F.col("t") & ~F.col("is_avg") & (F.col("model_idx") > 0), F.lit(False))).withColumn("is_final", F.contains("name", F.lit("final")) | F.col("clustered").isNull()).drop("t", "clustered")


BANDS = [(ty, lo, hi) for ty, of in (("NORMAL", NORMAL), ("TOP_L", TOP)) for lo, hi in of]


def best_of_models(pairs: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Of pairs (family, i, j, hit, scores: an array with a score for each of the family's models, the same number in all rows): family, at (the model's place), band (of BANDS), i, j, score, hit of those that are among the k first of their model and band in their task, by score (to ``digits`` digits), then place; and a row without a band for each model and task, whose hit is the number of scores from 0.1 on."""

    def each(batches):
        held: dict[tuple, list] = {}
        last: dict[tuple, tuple] = {}
        dense: dict[tuple, int] = {}

        def first(key):
            s, i, j, hit = (np.concatenate(x) for x in zip(*held[key]))
            at = np.lexsort((j, i, -s))[:k]
            held[key] = [(s[at], i[at], j[at], hit[at])]
            if len(at) == k:
                last[key] = (s[at[-1]], i[at[-1]], j[at[-1]])

        for batch in batches:
            if not batch.num_rows:
                continue
            families = batch.column("family").dictionary_encode()
            place = families.indices.to_numpy()
            i_, j_, hit_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "hit"))
            scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for f, family in enumerate(families.dictionary.to_pylist()):
                own = slice(None) if len(families.dictionary) == 1 else place == f
                i, j, hit, step, values = i_[own], j_[own], hit_[own], (j_ - i_)[own], np.ascontiguousarray(scores[own].T)
                inside = [np.flatnonzero((step >= lo) & (step <= hi) if hi is not None else step >= lo) for _, lo, hi in BANDS]
                wide = [b for b, at in enumerate(inside) if 4 * len(at) > len(step)]
                for m, raw in enumerate(values):
                    dense[family, m] = dense.get((family, m), 0) + int((raw >= 0.1).sum())
                    score = np.round(raw, digits)
                    # what may be among the best of a band that most pairs are in is found once for all of these
                    high = np.flatnonzero(score >= min(last[family, m, b][0] for b in wide)) if wide and all((family, m, b) in last for b in wide) else None
                    for b, ok in enumerate(inside):
                        key = (family, m, b)
                        if key in last:
                            s, x, y = last[key]
                            if b in wide and high is not None:
                                lo, hi = BANDS[b][1:]
                                at = high[(step[high] >= lo) & (step[high] <= hi)] if hi is not None else high[step[high] >= lo]
                            else:
                                at = ok
                            at = at[score[at] >= s]
                            at = at[(score[at] > s) | (i[at] < x) | ((i[at] == x) & (j[at] <= y))]
                        else:
                            at = ok
                        if len(at):
                            held.setdefault(key, []).append((score[at], i[at], j[at], hit[at]))
                            if key not in last and sum(len(x[0]) for x in held[key]) >= k or sum(len(x[0]) for x in held[key]) > 2 * k + 64:
                                first(key)
        columns = [[], [], [], [], [], [], []]
        for (family, m), n in dense.items():
            for c, v in zip(columns, (family, m, None, None, None, None, n)):
                c.append(v)
        for family, m, b in held:
            first((family, m, b))
            for s, i, j, hit in zip(*(x.tolist() for x in held[family, m, b][0])):
                for c, v in zip(columns, (family, m, b, i, j, s, hit)):
                    c.append(v)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["family", "at", "band", "i", "j", "score", "hit"])

    rows = pairs.select("family", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("hit").cast("bigint").alias("hit"), "scores")
    return rows.mapInArrow(each, "family string, at int, band int, i bigint, j bigint, score double, hit bigint")


def records_of_pairs(pairs: DataFrame, models_: DataFrame, targets: DataFrame, lengths: DataFrame, digits: int = 9) -> DataFrame:
    """records() of pairs (family, i, j, dist, valid, scores: an array with a score for each of the family's models) and models (method, name, family, at: the place in the array, model_idx, is_avg, s1). A pair is a row, however many models there are, and tasks pass on the best of each model and band alone."""
    longest = lengths.agg(F.max("seq_len")).first()[0] or 0
    hit = native_contact(F.col("dist"), F.col("valid")).cast("int")
    best = written(best_of_models(pairs.withColumn("hit", hit), max(*FIXED, int(longest)), digits), "best")
    about = best.where("band is null").groupBy("family", "at").agg(F.sum("hit").alias("n2"))
    about = about.join(models_, ["family", "at"]).join(lengths, "family").withColumn("s2", 2 * F.col("n2") / F.pow(F.col("seq_len"), F.lit(2)))
    bands = F.array(*[F.struct(F.lit(ty).alias("ty"), F.lit(lo).alias("min_sep"), F.lit(hi).cast("int").alias("max_sep")) for ty, lo, hi in BANDS])
    rows = best.where("band is not null").join(lengths, "family").withColumn("x", F.get(bands, F.col("band"))).select("family", "at", "i", "j", "score", "hit", "seq_len", "x.*")
    hits = _hits(rows, ["family", "at"])
    out = with_flags(hits.join(about, ["family", "at"]), targets).withColumnRenamed("family", "target")
    return out.select("method", "name", "target", "ty", "min_sep", "max_sep", "cutoff", "k", "precision", "seq_len", "model_idx", "s1", "s2", "is_target", "is_final", "is_avg")


def _hits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ty, min_sep, max_sep, cutoff, k, precision of ranked rows (keys, i, j, score, hit, seq_len, ty, min_sep, max_sep)."""
    fixed = F.array(*[F.struct(F.lit(str(k)).alias("cutoff"), F.lit(k).cast("long").alias("k")) for k in FIXED])
    share = F.array(*[F.struct(F.lit(n).alias("cutoff"), F.floor(F.col("seq_len") / d).alias("k")) for n, d in SHARES])
    best = ranked(rows, [*keys, "ty", "min_sep", "max_sep"]).withColumn("c", F.explode(F.when(F.col("ty") == "NORMAL", fixed).otherwise(share))).where("rank <= c.k")
    return best.groupBy(*keys, "ty", "min_sep", "max_sep", F.col("c.cutoff").alias("cutoff"), F.col("c.k").alias("k")).agg((F.sum("hit") / F.first("c.k")).alias("precision"))


def records(scores: DataFrame, native: DataFrame, targets: DataFrame, lengths: DataFrame, digits: int = 9) -> DataFrame:
    """Long records of scores (as scored() gives them): method, name, target (the family), ty, min_sep, max_sep, cutoff, k, precision, seq_len, model_idx, s1, s2, is_target, is_final, is_avg.

    native (family, i, j, dist, valid), lengths (family, seq_len). s2 is the density of the contact scores from 0.1 on. Hits are ranked in each band by score (to ``digits`` digits), then position; a k of 0 has no record, and k stays the denominator where there are fewer pairs.
    """
    keys = [*FIT, "model_idx"]
    scores = scores.join(lengths, "family")
    about = scores.groupBy(*keys, "is_avg", "s1", "seq_len").agg((2 * F.count_if(F.col("score") >= 0.1) / F.pow(F.col("seq_len"), F.lit(2))).alias("s2"))
    both = scores.withColumn("score", F.round("score", digits)).join(native, ["family", "i", "j"]).withColumn("hit", native_contact(F.col("dist"), F.col("valid")).cast("int"))
    bands = [F.struct(F.lit(ty).alias("ty"), F.lit(lo).alias("min_sep"), F.lit(hi).cast("int").alias("max_sep")) for ty, lo, hi in BANDS]
    rows = both.withColumn("x", F.explode(F.array(*bands))).where("j - i >= x.min_sep and (x.max_sep is null or j - i <= x.max_sep)").select(*keys, "i", "j", "score", "hit", "seq_len", "x.ty", "x.min_sep", "x.max_sep")
    hits = _hits(rows, keys)
    out = with_flags(hits.join(about, keys), targets).withColumnRenamed("family", "target")
    return out.select("method", "name", "target", "ty", "min_sep", "max_sep", "cutoff", "k", "precision", "seq_len", "model_idx", "s1", "s2", "is_target", "is_final", "is_avg")


#: The sheets of a report, with the type of their records and whether these are of final fits.
SHEETS = {"TOP_L_final": ("TOP_L", True), "NORMAL_final": ("NORMAL", True), "TOP_L": ("TOP_L", False), "NORMAL": ("NORMAL", False)}


def sheets(records_: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """The four sheets of records, with the targets' length, depth and meff (meta: target, seq_len, depth, meff)."""
    cuts = {"TOP_L": [n for n, _ in SHARES], "NORMAL": [str(k) for k in FIXED]}
    return {name: report(records_, meta, cuts[ty], ty, final) for name, (ty, final) in SHEETS.items()}


def stamped(fits: DataFrame) -> DataFrame:
    """method, name, family, stamp: a number that changes when a fit does. Sums don't depend on the order of rows."""
    return fits.groupBy(*FIT).agg(F.sum(F.shiftright(F.xxhash64("cluster_idx", "theta"), 20)).alias("stamp"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


STORED = f"target string, {RECORDS}, seq_len int, model_idx int, s1 double, s2 double, is_target boolean, is_final boolean, is_avg boolean, method string, name string"
MANIFEST = "method string, name string, family string, stamp bigint"


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all fits that were evaluated into the folder."""
    return _read(spark, f"{path}/records", STORED)


def evaluate_folder(fits: DataFrame, path: str, sizes: DataFrame, targets: DataFrame, native: DataFrame, lengths: DataFrame, cutoff: float = 1e-4) -> DataFrame:
    """Evaluates the fits that the folder's manifest doesn't name, or names with another stamp, and returns them (method, name, family, stamp).

    Records are kept by method and name and replaced as a whole; the manifest is written after them, so a run that breaks off is done again and one that is done isn't. A fit without models or without native distances counts as evaluated.
    """
    spark = fits.sparkSession
    now = stamped(fits)
    done = _read(spark, f"{path}/manifest", MANIFEST)
    new = written(now.join(done, [*FIT, "stamp"], "left_anti"), "new")
    if new.isEmpty():
        return new
    found = scored(models(fits.join(new.select(*FIT), FIT, "left_semi"), sizes, cutoff))
    rows = records(found, native, targets, lengths).withColumn("seq_len", F.col("seq_len").cast("int"))
    rows.select(*[c.strip().split()[0] for c in STORED.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "name").parquet(f"{path}/records")
    new.write.mode("append").parquet(f"{path}/manifest")
    return new

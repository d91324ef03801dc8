"""Reports over precision records: quantiles, bins, correlations, pivots."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqnet.operators.tables import written


def placed(rows: DataFrame, keys: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """rows with ``place``, the number of rows (or the weight) before each in its key's order. Rows are sorted by ranges and counted in each, so a large group is spread over tasks; a null in a key is a value like others."""
    weight = F.lit(1) if weight is None else weight
    parts = written(rows.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id()).withColumn("key_", F.struct(*keys)), "ranges")
    sizes = parts.groupBy("key_", "range_").agg(F.sum(weight).alias("size"))
    before = sizes.select("key_", "range_", (F.sum("size").over(Window.partitionBy("key_").orderBy("range_")) - F.col("size")).alias("before"))  # a row for each range that holds a key
    own = F.sum(weight).over(Window.partitionBy("key_", "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - weight
    return parts.withColumn("own", own).join(before, ["key_", "range_"]).withColumn("place", F.col("own") + F.col("before")).drop("key_", "range_", "own", "before")


def quantiles(records: DataFrame, keys: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """Exact quantiles (linear): a row for each key, q<percent> for each of qs; null where all values are. Values are counted first, placed in ranges, and those around each quantile's place are taken, so no task holds a group."""
    counts = records.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c_"))
    total = records.groupBy(*keys).agg(F.count(value).alias("n_")).withColumn("key_", F.struct(*keys))
    at = placed(counts, keys, [value], F.col("c_")).select(F.struct(*keys).alias("key_"), F.col(value).cast("double").alias("v_"), "place", "c_")
    spots = at.join(total.select("key_", "n_"), "key_")
    taken = []
    for q in qs:
        p = F.lit(float(q)) * (F.col("n_") - 1)
        for side, place in (("lo", F.floor(p)), ("hi", F.ceil(p))):
            taken.append(F.max(F.when((F.col("place") <= place) & (place < F.col("place") + F.col("c_")), F.col("v_"))).alias(f"{side}{round(100 * q)}"))
    near = spots.groupBy("key_").agg(*taken)
    out = total.join(near, "key_", "left")
    share = lambda q: F.lit(float(q)) * (F.col("n_") - 1) - F.floor(F.lit(float(q)) * (F.col("n_") - 1))
    return out.select(*keys, *[(F.col(f"lo{(n := round(100 * q))}") + (F.col(f"hi{n}") - F.col(f"lo{n}")) * share(q)).alias(f"q{n}") for q in qs])


def quantiles_avg(records: DataFrame, keys: list[str], value: str, qs: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Exact quantiles (linear) and the mean: one row for each key."""
    found = quantiles(records, keys, value, qs).select(F.struct(*keys).alias("key_"), *[f"q{round(100 * q)}" for q in qs])
    means = records.groupBy(*keys).agg(F.avg(value).alias("mean")).withColumn("key_", F.struct(*keys))
    return means.join(found, "key_").select(*keys, *[f"q{round(100 * q)}" for q in qs], "mean")


def upper_quartile_mean(records: DataFrame, keys: list[str], over: list[str], value: str) -> DataFrame:
    return quantiles(records, [*keys, *over], value, (0.75,)).groupBy(*keys).agg(F.avg("q75").alias("mean_q75"))


def equal_width_buckets(records: DataFrame, x: str, y: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """n buckets of width (max - min) / n + 1e-8; those of one point go; mean and population deviation of y."""
    keys = keys or []
    ends = records.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    both = records.join(ends, keys) if keys else records.crossJoin(F.broadcast(ends))
    b = F.floor((F.col(x) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n + 1e-8)).alias("bucket")
    return both.groupBy(*keys, b).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("std")).where("n > 1")


def equal_count_bins(records: DataFrame, x: str, y: str, tie: str, n: int, keys: list[str]) -> DataFrame:
    """n bins of (nearly) equal counts in the order of x and tie, the first ones taking one more."""
    totals = records.groupBy(*keys).agg(F.count("*").alias("total"))
    rows = placed(records, keys, [x, tie]).join(totals, keys)
    # the first total % n bins hold one more than the others
    small, more = F.expr(f"total div {n}"), F.expr(f"total % {n}")
    head = more * (small + 1)
    bin_ = F.when(F.col("place") < head, F.floor(F.col("place") / (small + 1))).otherwise(more + F.floor((F.col("place") - head) / F.greatest(small, F.lit(1)))) + 1
    return rows.withColumn("bin", bin_.cast("int")).groupBy(*keys, "bin").agg(F.avg(y).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("label", F.concat_ws("-", F.bround("lo", 1).cast("string"), F.bround("hi", 1).cast("string")))


def pearson(records: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.bround(F.corr(x, y), 3).alias("r"))


def brackets(records: DataFrame, value: str, edges: list[tuple[float, float]], keys: list[str], y: str) -> DataFrame:
    """Mean of y for rows with low < value < high, for each bracket."""
    rows = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in edges])
    return records.withColumn("b", F.explode(rows)).where(f"{value} > b.low and {value} < b.high").groupBy("b.low", "b.high", *keys).agg(F.avg(y).alias("mean"))


def unpivot(records: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return records.unpivot(keys, columns, "cutoff", "precision")


def pivot(records: DataFrame, keys: list[str], cutoffs: list) -> DataFrame:
    return records.groupBy(*keys).pivot("cutoff", cutoffs).agg(F.first("precision"))


def method_averages(records: DataFrame, keys: list[str], value: str = "precision") -> DataFrame:
    return records.groupBy(*keys).agg(F.avg(value).alias("mean"))


def best_method(means: DataFrame, keys: list[str], method: str = "method") -> DataFrame:
    return means.groupBy(*keys).agg(F.min_by(method, F.struct(-F.col("mean"), F.col(method))).alias("best"), F.max("mean").alias("mean"))


def last_by(records: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def where_equal(sheet: DataFrame, values: dict[str, object]) -> DataFrame:
    conds = [F.col(c).cast("string") == str(v) for c, v in values.items()]
    return sheet.where(reduce(lambda a, b: a & b, conds)) if conds else sheet


def members(sheet: DataFrame, names: DataFrame, on: str) -> DataFrame:
    return sheet.join(names.select(on), on, "left_semi")


def with_metadata(records: DataFrame, meta: DataFrame, on: str = "target") -> DataFrame:
    """meta is small or not: the planner broadcasts it if its size allows."""
    return records.join(meta, on, "left")


#: The kinds of models that a report tells apart.
KINDS = ("ALL", "FIRST", "TARGET", "NOT FIRST OR TARGET", "AVG")


def of_kind(kind: str, low: float = 0.0, high: float = 1.0) -> Column:
    """The condition of a report's kind on records with model_idx, is_avg, is_target, s2."""
    inside = F.col("s2").between(low, high)
    first, target = inside & (F.col("model_idx") == 0), inside & F.col("is_target")
    return {"ALL": F.lit(True), "FIRST": first, "TARGET": target, "NOT FIRST OR TARGET": ~first & ~target & ~F.col("is_avg"), "AVG": F.col("is_avg")}[kind]


def bracket_means(records: DataFrame, edges: list[tuple[float, float]], keys: list[str]) -> DataFrame:
    """method, keys, kind, low, high, mean: for each bracket of s2 and each kind, the mean over targets of a target's upper quartile of precision. Brackets bound the kinds that look at s2."""
    cases = [F.when(of_kind(k, low, high), F.struct(F.lit(k).alias("kind"), F.lit(low).alias("low"), F.lit(high).alias("high"))) for k in KINDS for low, high in edges]
    rows = records.withColumn("case", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull()))).select("method", *keys, "target", "case.kind", "case.low", "case.high", "precision")
    return upper_quartile_mean(rows, ["method", *keys, "kind", "low", "high"], ["target"], "precision").withColumnRenamed("mean_q75", "mean")


def gathered(records: DataFrame, keys: list[str], value: str = "precision") -> DataFrame:
    """All values of each key as a sorted list; a key's values are as many as it has models."""
    return records.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))


def values_by_separation(records: DataFrame, x: str, scaled: bool = True) -> DataFrame:
    """target, min_sep, cutoff, x, precision: what is plotted against a field of the records, times the sequence's length if ``scaled``."""
    return records.select("target", "min_sep", "cutoff", (F.col(x) * F.col("seq_len") if scaled else F.col(x)).alias("x"), "precision")


def report(records: DataFrame, meta: DataFrame, cutoffs: list[str], ty: str, final: bool) -> DataFrame:
    """One sheet: records (method, target, ty, is_final, model_idx, is_avg, is_target, s2, min_sep, max_sep, cutoff, precision) of a type, final or not (methods with 'psicov' count in any case), by kind; exact quantiles and the mean for each method, target and separation, with the target's length, depth and meff (meta), the cutoffs as columns."""
    own = records.where((F.col("ty") == ty) & ((F.col("is_final") == final) | F.col("method").contains("psicov")))
    psicov = F.col("method").contains("psicov")
    kinds = own.withColumn("kind", F.explode(F.filter(F.array(*[F.when(of_kind(k) | psicov, k) for k in KINDS]), lambda x: x.isNotNull())))
    keys = ["method", "target", "kind", "min_sep", "max_sep"]
    kinds = written(kinds.select(*keys, "cutoff", "precision"), "kinds")  # read several times
    q = written(quantiles_avg(kinds, [*keys, "cutoff"], "precision"), "quantiles")
    tall = q.unpivot([*keys, "cutoff"], ["q25", "q50", "q75", "q100", "mean"], "data_type", "precision")
    return with_metadata(pivot(tall, [*keys, "data_type"], cutoffs), meta)


def against(records: DataFrame, meta: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """keys, target, x, precision: one point for each method and target, such as precision against meff."""
    return records.join(meta.select("target", x), "target").select(*keys, "target", x, "precision")


def target_table(sheet: DataFrame, keys: list[str], cutoffs: list[str], data_type: str) -> DataFrame:
    """A sheet's rows of one data type, a row for each cutoff."""
    return sheet.where(F.col("data_type") == data_type).unpivot(keys, cutoffs, "cutoff", "precision")


def result_files(files: DataFrame) -> DataFrame:
    """Result and target folders worth reading (folder, file): names that begin with 'result' or 'target', hold 'remove_gaps' or 'psicov', and have more than one file."""
    name = F.element_at(F.split("folder", "/"), -1)
    fits = (name.startswith("result") | name.startswith("target")) & (name.contains("remove_gaps") | name.contains("psicov"))
    many = files.where(fits).groupBy("folder").agg(F.count("*").alias("n")).where("n > 1").select("folder")
    return files.join(many, "folder", "left_semi")

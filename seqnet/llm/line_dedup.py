"""Deletes later copies of repeated runs of lines. DataFrame operations only.

Documents are sequences of line ids, in the order of doc_id. Prefix doubling ranks the suffixes of the stretches of lines that occur again: a table of the first round holds the rank of each line's id, the next one that of each block of two lines, by the order of
the two ranks it is made of, then of four, and so on; one join for each doubling. The suffixes that share a prefix of n lines are an interval of the suffix array of at least that common prefix length, told by two overlapping ranks: those of the blocks of the
largest power of two of lines that begin and end the prefix. A suffix's interval is that of its shortest prefix of ``min_words`` words or more; the interval's first suffix in document order is kept and in each later one that prefix is a repeat. Repeats that
overlap or touch make up the maximal repeated runs, also where a run's last lines are short, because the same is done from the ends of runs backwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, stage

MIN_WORDS = 50


#: A line id is looked up by a broadcast table if it holds at least this share of all lines; there are 1000 such ids at most.
HOT_SHARE = 1e-3


def ranks(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct values of the columns with r, their place (from 1) in the order of the columns: sorted by ranges, counted in each range."""
    parts = stage(rows.select(*columns).distinct().repartitionByRange(*columns).withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*columns))
    return parts.withColumn("own", own).join(F.broadcast(before), "part").select(*columns, (F.col("own") + F.col("before")).alias("r"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row keys k, g and ``gone``, the numbers (from 0) of the lines to delete; only documents that lose lines."""
    lines = docs.select(*row_key(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("p", "line"))
    lines = stage(lines.select("k", "g", "p", F.unhex(F.md5("line")).alias("id"), F.regexp_count("line", F.lit(WORD)).alias("w")), "lines")
    # a line that occurs once ends every repeat, so only stretches of lines that occur again are looked at from here on
    again = stage(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "again")
    hot = again.where(F.col("n") >= HOT_SHARE * lines.count()).select("id", F.lit(True).alias("hot"))
    lines = lines.join(F.broadcast(hot), "id", "left")
    rare = lines.where("hot is null").join(again.select("id").hint("merge"), "id", "left_semi")
    kept = lines.where("hot").unionByName(rare).drop("hot").dropDuplicates(["k", "g", "p"])
    doc = Window.partitionBy("k", "g").orderBy("p")
    kept = kept.withColumn("seg", F.col("p") - F.row_number().over(doc))
    seg = Window.partitionBy("k", "g", "seg")
    kept = kept.withColumn("ce", F.sum("w").over(seg.orderBy("p"))).withColumn("cs", F.col("ce") - F.col("w"))
    ahead, back = seg.orderBy("cs").rangeBetween(0, min_words - 1), seg.orderBy("ce").rangeBetween(1 - min_words, 0)
    kept = (
        kept.withColumn("m", F.when(F.max("ce").over(ahead) - F.col("cs") >= min_words, F.max("p").over(ahead) - F.col("p") + 1))
        .withColumn("b", F.when(F.col("ce") - F.min("cs").over(back) >= min_words, F.col("p") - F.min("p").over(back) + 1))
        .withColumn("all", F.max("ce").over(seg))
        .where(F.col("all") >= min_words)
        .select("k", "g", "seg", "p", "id", "m", "b")
    )
    kept = stage(kept, "stretches")
    longest = kept.agg(F.max(F.greatest("m", "b")).alias("x")).first()["x"] or 1

    level = kept.join(ranks(kept, ["id"], "rank-0").hint("merge"), "id").select("k", "g", "seg", "p", "r")
    table = level = stage(level, "level-0")
    table = table.select("k", "g", "p", F.lit(0).alias("l"), "r")
    for j in range(1, int(longest).bit_length()):
        ahead = F.lead("r", 1 << (j - 1)).over(Window.partitionBy("k", "g", "seg").orderBy("p"))
        pairs = stage(level.withColumn("q", ahead).where("q is not null"), f"pairs-{j}")
        pairs = pairs.withColumnRenamed("r", "a")
        level = stage(pairs.join(ranks(pairs, ["a", "q"], f"rank-{j}").hint("merge"), ["a", "q"]).select("k", "g", "seg", "p", "r"), f"level-{j}")
        table = table.unionByName(level.select("k", "g", "p", F.lit(j).alias("l"), "r"))

    # prefixes: from the front (kind 0) and from the back (kind 1); of n lines from s on, which repeat the lines lo to hi
    first = kept.where("m is not null").select(F.lit(0).alias("kind"), "k", "g", F.col("p").alias("s"), F.col("m").alias("n"), F.col("p").alias("lo"), (F.col("p") + F.col("m") - 1).alias("hi"))
    last = kept.where("b is not null").select(F.lit(1).alias("kind"), "k", "g", (F.col("p") - F.col("b") + 1).alias("s"), F.col("b").alias("n"), F.col("p").alias("lo"), F.col("p").alias("hi"))
    suffixes = first.unionByName(last).withColumn("l", F.expr("length(bin(n)) - 1"))
    suffixes = suffixes.withColumn("s2", F.expr("s + n - cast(shiftleft(1, l) as int)"))
    suffixes = suffixes.join(table.select("k", "g", F.col("p").alias("s"), "l", F.col("r").alias("r1")).hint("merge"), ["k", "g", "s", "l"]).join(table.select("k", "g", F.col("p").alias("s2"), "l", F.col("r").alias("r2")).hint("merge"), ["k", "g", "s2", "l"])
    suffixes = stage(suffixes.select("kind", "n", "r1", "r2", "k", "g", "s", "lo", "hi"), "suffixes")
    own = ["kind", "n", "r1", "r2"]
    intervals = suffixes.groupBy(*own).agg(F.min(F.struct("k", "g", "s")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = suffixes.join(intervals.hint("merge"), own).where(F.struct("k", "g", "s") > F.col("first"))
    return later.select("k", "g", F.explode(F.sequence("lo", "hi")).alias("p")).groupBy("k", "g").agg(F.collect_set("p").alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: ``d`` (the row as a struct), n_lines, n_removed, clean (its text without repeats).

    A run is repeated if it has ``min_words`` words or more and the same lines stand earlier, in a document of a smaller doc_id or further up; a run may overlap its earlier copy.
    Every line's first occurrence stays. Null text: no lines, clean is null. Empty text: one empty line. Null doc_id: before all others. Rows with the same doc_id
    are ordered by a hash of their texts; rows that agree in both are one document and get one result. Other columns, whatever their names, stay in ``d``. Empty table: no rows.
    """
    gone = stage(repeated_lines(docs, min_words, id_col, text_col), "gone")
    rows = docs.select(F.struct("*").alias("d"), F.col(text_col).alias("t"), *row_key(id_col, text_col))
    lines = F.split("t", "\n")
    rows = rows.join(gone.hint("merge"), ["k", "g"], "left").select("d", "t", "gone", lines.alias("ls"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(ls) - 1), gone), i -> ls[i]), '\n')")
    return rows.select(
        "d",
        F.when(F.col("t").isNull(), 0).otherwise(F.size("ls")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(left).alias("clean"),
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    out = line_dedup(documents(spark, sf_dir))
    return out.select("d.doc_id", "n_lines", "n_removed", F.col("clean").alias("text"))


SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as p from documents where text is not null
), c as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from l
), s as (
  select *, sum(w) over (partition by doc_id order by p) as ce, sum(w) over (partition by doc_id order by p) - w as cs from c
), f as (
  select *, max(p) over (partition by doc_id order by cs range between current row and 49 following) as fe,
    max(ce) over (partition by doc_id order by cs range between current row and 49 following) as fce,
    min(p) over (partition by doc_id order by ce range between 49 preceding and current row) as bs,
    min(cs) over (partition by doc_id order by ce range between 49 preceding and current row) as bcs from s
), win as (
  select 0 as kind, doc_id, p as a, fe as z, p as lo, fe as hi from f where fce - cs >= 50
  union all select 1, doc_id, bs, p, p, p from f where ce - bcs >= 50
), body as (
  select kind, win.doc_id, a, z, lo, hi, string_agg(l.line, chr(10) order by l.p) as t from win join l on l.doc_id = win.doc_id and l.p between a and z group by all
), rep as (
  select *, min((doc_id, a)) over (partition by kind, t) as first from body
), gone as (
  select distinct rep.doc_id, unnest(range(lo, hi + 1)) as p from rep where (doc_id, a) > first
), left_over as (
  select l.doc_id, count(*) as n_lines, count(gone.p) as n_removed, coalesce(string_agg(l.line, chr(10) order by l.p) filter (gone.p is null), '') as text
  from l left join gone on l.doc_id = gone.doc_id and l.p = gone.p group by l.doc_id
)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, o.text from documents d left join left_over o using (doc_id)
"""

"""Quality rules: text statistics, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, digits to 0, white space collapsed) and hashed; for each host, the distinct documents (by text, so that copies count once) with a line are counted
over the whole table. Lines above the limit are removed wherever that host has them, and a document that loses most of its words is rejected.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, row_key, stage

#: A line is above the limit if more than LINE_DOCS distinct documents of the host, and more than LINE_SHARE of them, have it.
LINE_DOCS, LINE_SHARE = 50, 0.1
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_LOWER_DIGITS = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    joined = b"".join(words)
    chars = len(joined) if raw.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    if n < 4:
        return n, chars, symbols, dup, 0
    own: dict[bytes, int] = {}
    w = np.fromiter((own.setdefault(x, len(own)) for x in words), np.int64, n)
    v = len(own)
    if v < 2_000_000:
        g = (w[:-2] * v + w[1:-1]) * v + w[2:]
        by = np.argsort(g, kind="stable")
        s = g[by]
        same = s[1:] == s[:-1]
        twice = np.zeros(n - 2, bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
    else:
        g3 = [(a, b, c) for a, b, c in zip(words, words[1:], words[2:])]
        c = Counter(g3)
        twice = np.array([c[x] > 1 for x in g3])
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= twice
    return n, chars, symbols, dup, int(hit.sum())


def with_stats(docs: DataFrame, host_col: str, text_col: str, id_col: str) -> DataFrame:
    """Per row: k, g, host, doc_id, the statistics."""

    def each(batches):
        for whole in batches:
            for b in pieces(whole):
                got = [stats(t.as_py()) for t in b.column("t")]
                cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("k", "g", "host", "doc_id")], *cols], ["k", "g", "host", "doc_id", *NAMES])

    rows = docs.select(*row_key(id_col, text_col), F.col(host_col).cast("string").alias("host"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(each, "k bigint, g bigint, host string, doc_id bigint, " + ", ".join(f"{n} bigint" for n in NAMES))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_hash(line):
    """Hash of a normalised line (a Column); the normalisation is the operator's own."""
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"), r"[\x20\x09-\x0D]+", " ")))


def _lines(docs: DataFrame, host_col: str, text_col: str, id_col: str) -> DataFrame:
    rows = docs.select(*row_key(id_col, text_col), F.col(host_col).cast("string").alias("host"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.select("k", "g", "host", line_hash(F.col("line")).alias("h"), words.cast("long").alias("w")).where("w > 0")


def _limits(lines: DataFrame, docs: DataFrame, host_col: str, text_col: str, line_docs: int, share: float) -> DataFrame:
    hosts = docs.where(F.col(text_col).isNotNull()).select(F.col(host_col).cast("string").alias("host"), F.xxhash64(text_col).alias("g")).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    seen = lines.select("host", "h", "g").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
    return seen.join(hosts, seen["host"].eqNullSafe(hosts["host"])).where(F.col("n") > share * F.col("docs")).select(seen["host"], "h")


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", line_docs: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """Lines (host, h) above the limit. At most (lines of a host's mean document) / share of a host."""
    return _limits(_lines(docs, host_col, text_col, id_col), docs, host_col, text_col, line_docs, share)


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", line_docs: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """Per row: k, g, host, doc_id, the statistics, n_line_words (words in lines above the limit), gone (hashes of these lines; null without any), base_failed, kept.

    Null and empty texts have no words and fail. Null hosts are one host. Rows that agree in doc_id and text are one document to the line counts (as are all equal texts) and get the same verdict. A line that a document has
    twice counts once for the document, and all of it is removed. Other columns are ignored. Empty table: no rows.
    """
    lines = stage(_lines(docs, host_col, text_col, id_col), "lines")
    above = stage(_limits(lines, docs, host_col, text_col, line_docs, share), "above")
    lost = lines.join(above, lines["h"].eqNullSafe(above["h"]) & lines["host"].eqNullSafe(above["host"]), "left_semi")
    lost = lost.groupBy("k", "g", "host").agg(F.sum("w").alias("all_w"), F.collect_set("h").alias("gone"))
    rows = stage(with_stats(docs, host_col, text_col, id_col), "stats")
    copies = rows.groupBy("k", "g", "host").agg(F.count("*").alias("copies"))
    same = lambda a, b: (a["k"] == b["k"]) & (a["g"] == b["g"]) & a["host"].eqNullSafe(b["host"])
    lost = lost.join(copies, same(lost, copies)).select(lost["k"].alias("k2"), lost["g"].alias("g2"), lost["host"].alias("host2"), (F.col("all_w") / F.col("copies")).cast("long").alias("n_line_words"), "gone")
    out = rows.join(lost, (F.col("k") == F.col("k2")) & (F.col("g") == F.col("g2")) & F.col("host").eqNullSafe(F.col("host2")), "left").drop("k2", "g2", "host2")
    out = out.withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words") >= LEFT_SHARE * F.col("n_words")))


def apply_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id", line_docs: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """The rows of docs that are kept, all columns, their text without the lines above the limit. Rows meet their verdict, and their own lines to remove, by document, never by host; texts move once."""
    verdict = judge(docs, host_col, text_col, id_col, line_docs, share)
    kept = stage(verdict.where("kept").select("k", "g", F.col("host").alias("host1"), "gone").dropDuplicates(["k", "g", "host1"]), "kept")
    rows = docs.select(F.struct("*").alias("d"), *row_key(id_col, text_col))
    host = F.col("d").getField(host_col).cast("string")
    rows = rows.join(kept.withColumnsRenamed({"k": "k1", "g": "g1"}), (F.col("k") == F.col("k1")) & (F.col("g") == F.col("g1")) & host.eqNullSafe(F.col("host1")))
    text = F.col("d").getField(text_col)
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains("gone", line_hash(x)), F.lit(False))), "\n")
    cols = [F.when(F.col("gone").isNotNull(), left).otherwise(text).alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns]
    return rows.select(*cols)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", *NAMES, "base_failed", "kept", "n_line_words")


SQL = r"""
with l as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as p from documents where text is not null),
lw as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[1-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from l),
hosts as (select source, count(distinct text) as docs from documents where text is not null group by 1),
above as (select source, norm from (select source, norm, count(distinct text) as n from lw where w > 0 group by all) join hosts using (source) where n > 50 and n > 0.1 * docs),
lost as (select doc_id, sum(w)::bigint as n_line_words from lw join above using (source, norm) where w > 0 group by 1),
dup as (select doc_id, sum(c - 1)::bigint as n_dup_lines from (select doc_id, line, count(*) as c from lw where w > 0 group by all) group by 1),
t as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w, text from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as c from g) where c > 1),
rep as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by 1),
a as (select t.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_line_words, 0) as n_line_words
  from t left join dup using (doc_id) left join rep using (doc_id) left join lost using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - n_line_words >= 0.5 * n_words as kept from a
"""

"""Finds secrets, scanning each distinct content once for each version of the rules.

The ledger is a table of (blob, version) that were scanned, with their findings. A run content-addresses all rows (SHA-256), picks the blobs that the ledger doesn't have for the
rules' version, scans one copy of each, appends what it found, and joins findings back to every row (path) that holds the blob.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, stage

#: The base kinds and patterns, in order.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # as [0-9a-f]+ with shorter matches dropped
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the method adds: kinds with a string without which the pattern can't match, and the pattern.
EXTRA = {
    "private_key": ("-----BEGIN", re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")),
    "jwt": ("eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
}
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, *EXTRA))}
#: What any span holds, for Spark's regular expressions.
POSSIBLE = "(?i:passw(or)?d|secret|token|api_?key)|AKIA|[0-9a-f]{16}|-----BEGIN|gh[pousr]_|eyJ"
#: Raise this with any change of the patterns: blobs are then scanned anew.
VERSION = "1"

FOUND = "array<struct<kind:string,start:int,stop:int>>"


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of one text, by start, then by kind."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    for kind, (hint, pattern) in EXTRA.items():
        if hint in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _scan(blobs: DataFrame) -> DataFrame:
    def each(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for whole in batches:
            for b in pieces(whole):
                found = [[{"kind": k, "start": i, "stop": j} for k, i, j in scan_text(t.as_py())] for t in b.column("t")]
                yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(found, kind)], ["blob", "found"])

    return blobs.mapInArrow(each, f"blob binary, found {FOUND}")


def blob_id(text_col: str = "text"):
    return F.unhex(F.sha2(F.encode(F.col(text_col), "UTF-8"), 256))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, version: str = VERSION, text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, version, found) for the contents of docs that the ledger doesn't have under this version. Null texts have no content, equal ones one row, whatever their number; an empty table gives no rows."""
    # only texts that can hold a span are moved; the others' blobs are entered without
    t = F.col(text_col)
    rows = docs.where(t.isNotNull()).select(blob_id(text_col).alias("blob"), F.when(t.rlike(POSSIBLE), t).alias("t"))
    if ledger is not None:
        rows = rows.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    return _scan(rows.groupBy("blob").agg(F.first("t").alias("t"))).select("blob", F.lit(version).alias("version"), "found")


class Ledger:
    """A ledger in a folder that all executors share. update() scans what is new and appends it; findings() joins it to rows."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path)
        return self.spark.read.schema(f"blob binary, version string, found {FOUND}").parquet(self.path) if there else None

    def update(self, docs: DataFrame, version: str = VERSION, text_col: str = "text") -> None:
        scan_unseen(docs, self.read(), version, text_col).write.mode("append").parquet(self.path)

    def findings(self, docs: DataFrame, version: str = VERSION, text_col: str = "text") -> DataFrame:
        """As join_findings(); nothing is found before the first update."""
        ledger = self.read()
        return join_findings(docs, self.spark.createDataFrame([], f"blob binary, version string, found {FOUND}") if ledger is None else ledger, version, text_col)


def join_findings(docs: DataFrame, ledger: DataFrame, version: str = VERSION, text_col: str = "text", carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """Per row of docs: ``d`` (the carried columns as a struct), found (spans by start, then kind; code points, end exclusive).

    Null and empty texts hold nothing. Equal texts have one ledger row and all get its spans; repeated rows get a result each. Extra columns stay in ``d``. Very long texts are scanned whole.
    """
    hits = ledger.where((F.col("version") == version) & (F.size("found") > 0)).select("blob", "found").dropDuplicates(["blob"])
    rows = docs.select(F.struct(*carry).alias("d"), blob_id(text_col).alias("blob"))
    return rows.join(hits, "blob", "left").select("d", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def digest(rows: DataFrame, base: tuple[str, ...], order: dict[str, int]) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and spans, from d.doc_id and found."""
    is_base = " or ".join(f"x.kind = '{k}'" for k in base)
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"
    return rows.select(
        "d.doc_id",
        *[F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base],
        F.sha2(F.expr(text.format(f"filter(found, x -> {is_base})")), 256).alias("base_sha256"),
        F.expr(text.format("found")).alias("spans"),
    )


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ledger = stage(scan_unseen(docs), "ledger")
    return digest(join_findings(docs, ledger, carry=("doc_id",)), BASE, ORDER)

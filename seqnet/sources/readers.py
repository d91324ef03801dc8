"""Readers and writers of sequence, matrix and structure files. Sequence, cluster and matrix files are read in splits, however large a file is; structure files, which are small, are a row each. ``file`` is a file's name; partition columns of the folder stay."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqnet.functions.residues import ALPHABET, cluster_name, mask_unknown, three_to_one
from seqnet.sources import splits


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Files as (file, line_no, value), lines numbered in each file; a file is one row first. For structure files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def _without_place(rows: DataFrame) -> DataFrame:
    return rows.drop("path", "split", "at")


def _folders(rows: DataFrame) -> list[str]:
    """The folder's partition columns of a scan."""
    return [c for c in rows.columns if c not in ("value", "path", "file", "split", "at", "marked", "seq", "line_no", "name")]


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, seq_id (0, 1, ... in each file), name, seq; a sequence's lines are joined, blank lines and headers without a sequence are skipped. A file is cut at records."""
    found = _fasta(spark, path)
    return _without_place(splits.numbered(found, "seq_id").withColumn("seq_id", F.col("seq_id").cast("int")))


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    rows = splits.records(spark, path).where("marked")
    name, seq = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return rows.withColumn("name", name).withColumn("seq", seq).drop("value", "marked").where("seq <> ''")


def _sequence_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are sequences, with their places."""
    rows = splits.lines(spark, path)
    return rows.where(~F.startswith("value", F.lit(">")) & (F.length(F.trim("value")) > 0)).withColumn("seq", F.trim(F.translate("value", "\r", ""))).drop("value")


def alignment_lines(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a line, header lines and blank lines skipped: file, line_no (of all lines, from 0), seq."""
    rows = splits.numbered(splits.lines(spark, path), "line_no").withColumn("line_no", F.col("line_no").cast("int"))
    return _without_place(rows.where(~F.startswith("value", F.lit(">")) & (F.length(F.trim("value")) > 0)).withColumn("seq", F.trim(F.translate("value", "\r", ""))).drop("value"))


def named_sequences(spark: SparkSession, path: str) -> DataFrame:
    """file, name (seq-<digits> of the header), seq: of each name the last sequence line under it."""
    rows = splits.records(spark, path).where("marked")
    name, body = cluster_name(F.regexp_extract("value", r"^([^\r\n]*)", 1)), F.filter(F.split(F.regexp_replace(F.translate("value", "\r", ""), r"^[^\n]*", ""), r"\n"), lambda x: F.trim(x) != "")
    own = _folders(rows)
    last = rows.select("path", "file", *own, name.alias("name"), splits.place().alias("p"), F.trim(F.element_at(body, -1)).alias("seq")).where("name is not null and seq is not null")
    return last.groupBy("path", "file", *own, "name").agg(F.max_by("seq", "p").alias("seq")).drop("path")


def first_sequence(spark: SparkSession, path: str) -> DataFrame:
    """file, seq: each file's first sequence line."""
    rows = _sequence_lines(spark, path)
    return rows.groupBy("path", "file", *_folders(rows)).agg(F.min_by("seq", splits.place()).alias("seq")).drop("path")


def single_sequence(spark: SparkSession, path: str) -> DataFrame:
    """As fasta(), for files of exactly one record; fails otherwise."""
    found = _fasta(spark, path)
    own = _folders(found)
    one = found.groupBy("path", "file", *own).agg(F.count("*").alias("n"), F.first("name").alias("name"), F.first("seq").alias("seq"))
    return one.select("file", *own, F.lit(0).alias("seq_id"), "name", F.when(F.col("n") == 1, F.col("seq")).otherwise(F.raise_error(F.lit("more than one record"))).alias("seq"))


def a2m(spark: SparkSession, path: str) -> DataFrame:
    """One aligned sequence a line, all of a file equally long; fails otherwise. Files are compared by a row each."""
    rows = splits.numbered(splits.lines(spark, path), "line_no").withColumn("line_no", F.col("line_no").cast("int"))
    rows = rows.where(~F.startswith("value", F.lit(">")) & (F.length(F.trim("value")) > 0)).withColumn("seq", F.trim(F.translate("value", "\r", ""))).drop("value")
    size = _sequence_lines(spark, path).groupBy("path").agg(F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most"))
    checked = rows.join(size, "path").withColumn("seq", F.when(F.col("least") == F.col("most"), F.col("seq")).otherwise(F.raise_error(F.lit("sequences of unequal length"))))
    return _without_place(checked.drop("least", "most"))


def write_fasta(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def rewritten(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seq", mask_unknown(F.col("seq")))


def converted(rows: DataFrame, target: str) -> DataFrame:
    """Name shortened to the first two pieces of its first word, U as X, rows equal to the target replaced by one row named target; fails on letters outside the alphabet and BXZOU."""
    pieces = F.split(F.substring_index("name", " ", 1), "-")
    ok = ~F.col("seq").rlike(f"[^{ALPHABET[:-1]}BXZOU-]")
    out = rows.where(F.col("seq") != target).select(F.concat(F.get(pieces, F.lit(0)), F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))).alias("name"), F.when(ok, F.translate("seq", "U", "X")).otherwise(F.raise_error(F.lit("unknown letter"))).alias("seq"))
    return rows.sparkSession.createDataFrame([("target", target)], "name string, seq string").unionByName(out)


def cluster_file(spark: SparkSession, path: str, name_pattern: str = r"(seq-\d+)") -> DataFrame:
    """Cluster listings (a '>Cluster' line, then its members): file, cluster_idx, name; the last cluster included. Clusters are counted in each split, then over splits, so a cluster may go on over several."""
    rows = splits.counted(splits.lines(spark, path), F.startswith("value", F.lit(">Cluster")))
    rows = splits.with_offsets(rows, "n", "clusters").where("clusters > 0")
    return rows.select("file", *[c for c in _folders(rows) if c != "clusters"], (F.col("clusters") - 1).cast("int").alias("cluster_idx"), F.regexp_extract("value", name_pattern, 1).alias("name")).where("name <> ''")


def named_matrix(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """Numbers between the first line with the marker and the first blank line after a row of them, or the end: file, r, c, v."""
    rows = splits.lines(spark, path)
    own = _folders(rows)
    rows = rows.select("path", "file", *own, splits.place().alias("p"), F.trim(F.translate("value", "\t\r", " ")).alias("line"))
    start = rows.where(F.contains("line", F.lit(marker.strip()))).groupBy("path").agg(F.min("p").alias("start"))
    body = rows.join(start, "path").where("p > start")
    first = body.where("line <> ''").groupBy("path").agg(F.min("p").alias("first"))
    last = body.where("line = ''").join(first, "path").where("p > first").groupBy("path").agg(F.min("p").alias("end"))
    body = body.where("line <> ''").join(last, "path", "left").where("end is null or p < end")
    body = body.select("path", "file", *own, F.col("p.split").alias("split"), F.col("p.at").alias("at"), F.col("line"))
    ranked = body.withColumn("r", F.row_number().over(Window.partitionBy("path", "split").orderBy("at")))  # within a split
    ranked = splits.with_offsets(ranked, "r", "r").withColumn("r", (F.col("r") - 1).cast("int"))
    return ranked.select("file", *own, "r", F.posexplode(F.split("line", r"\s+")).alias("c", "v")).select("file", *own, "r", "c", F.col("v").cast("double").alias("v"))


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """ATOM records of the first model of PDB files: file, chain, res_no, icode (insertion code, mostly empty), residue (three letters), atom, x, y, z."""
    rows = splits.lines(spark, path).select("path", "file", splits.place().alias("p"), "value")
    end = rows.where(F.startswith("value", F.lit("ENDMDL"))).groupBy("path").agg(F.min("p").alias("end"))
    rows = rows.where(F.startswith("value", F.lit("ATOM  "))).join(end, "path", "left").where("end is null or p < end")
    at = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    return rows.select("file", at(22, 22).alias("chain"), at(23, 26).cast("int").alias("res_no"), at(27, 27).alias("icode"), at(18, 20).alias("residue"), at(13, 16).alias("atom"), *[at(31 + 8 * k, 38 + 8 * k).cast("double").alias(n) for k, n in enumerate("xyz")])


#: A token of a mmCIF file: a value of several lines, a quoted one (a quote ends it only before white space), a comment, or a word.
_CIF = re.compile(r"(?:^|(?<=\n));([^\n]*(?:\n(?!;)[^\n]*)*)\n;|'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|\"((?:[^\"\n]|\"(?=\S))*)\"(?=\s|$)|(#[^\n]*)|(\S+)")


def cif_tokens(text: str):
    """(token, whether it was quoted) of a mmCIF text, comments left out."""
    for m in _CIF.finditer(text):
        block, single, double, comment, word = m.groups()
        if comment is None:
            yield (word, False) if word is not None else (next(x for x in (block, single, double) if x is not None), True)


def cif_loop(text: str, category: str) -> tuple[list[str], list[list[str]]]:
    """Names and rows of a category's loop, or the one row of its single items; no names where it isn't there. Null marks are empty texts."""
    names, cells, single, key, loop = [], [], {}, None, False
    inside = False
    for token, quoted in cif_tokens(text):
        low = token.lower()
        special = not quoted and (low == "loop_" or low.startswith(("data_", "save_")) or token.startswith("_"))
        if special:
            if inside and cells:
                break
            key = None
            if token.startswith("_"):
                if low.startswith(f"{category}."):
                    if loop:
                        names.append(token.split(".", 1)[1])
                        inside = True
                    else:
                        key = token.split(".", 1)[1]
                elif inside:
                    break
                else:
                    loop = False
            else:
                loop = low == "loop_"
            continue
        value = "" if token in (".", "?") and not quoted else token
        if inside:
            cells.append(value)
        elif key is not None:
            single[key] = value
            key = None
    if names:
        return names, [cells[i : i + len(names)] for i in range(0, len(cells) - len(names) + 1, len(names))]
    return list(single), [list(single.values())] if single else []


def mmcif_atoms(spark: SparkSession, path: str) -> DataFrame:
    """As atoms(), of mmCIF files: the _atom_site category by the names of its columns, with quoted values and those of several lines; first model, author's chain, numbers and insertion codes. A structure's file is a row."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    kinds = {"file": pa.string(), "chain": pa.string(), "res_no": pa.int32(), "icode": pa.string(), "residue": pa.string(), "atom": pa.string(), "x": pa.float64(), "y": pa.float64(), "z": pa.float64()}

    def each(batches):
        for b in batches:
            for file, text in zip(b.column("file").to_pylist(), b.column("value")):
                names, rows = cif_loop(text.as_py().replace("\r\n", "\n"), "_atom_site")
                at = {n: i for i, n in enumerate(names)}
                get = lambda r, n: r[at[n]] if n in at else ""
                rows = [r for r in rows if get(r, "group_PDB") == "ATOM"]
                first = min((int(get(r, "pdbx_PDB_model_num") or 1) for r in rows), default=1)
                rows = [r for r in rows if int(get(r, "pdbx_PDB_model_num") or 1) == first]
                number = lambda v: float(v) if v else None
                out = [[file] * len(rows), [get(r, "auth_asym_id") for r in rows], [int(get(r, "auth_seq_id")) for r in rows], [get(r, "pdbx_PDB_ins_code") for r in rows], [get(r, "label_comp_id") for r in rows], [get(r, "label_atom_id") for r in rows], *[[number(get(r, f"Cartn_{c}")) for r in rows] for c in "xyz"]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds.values())], list(kinds))

    return whole.mapInArrow(each, "file string, chain string, res_no int, icode string, residue string, atom string, x double, y double, z double")


def chain_sequences(atoms_: DataFrame) -> DataFrame:
    """file, chain, seq: the 20 standard residues of each chain in order of their numbers, then of their insertion codes."""
    icode = F.col("icode") if "icode" in atoms_.columns else F.lit("")
    res = atoms_.select("file", "chain", "res_no", icode.alias("icode"), three_to_one(F.col("residue")).alias("letter")).where("letter is not null").distinct()
    return res.groupBy("file", "chain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("res_no", "icode", "letter"))), lambda x: x.getField("letter")), "").alias("seq"))


def one_chain(atoms_: DataFrame, chain: str) -> DataFrame:
    return atoms_.where(F.col("chain") == chain)


def seqres(spark: SparkSession, path: str) -> DataFrame:
    """file, chain, seq from the SEQRES records of PDB files, residues outside the 20 left out."""
    rows = _records(spark, path).where(F.startswith("value", F.lit("SEQRES")))
    codes = rows.select("file", "line_no", F.substring("value", 12, 1).alias("chain"), F.posexplode(F.split(F.trim(F.substring("value", 20, 60)), r"\s+")).alias("p", "code"))
    letters = codes.select("file", "chain", "line_no", "p", three_to_one(F.col("code")).alias("letter")).where("letter is not null")
    return letters.groupBy("file", "chain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "p", "letter"))), lambda x: x.getField("letter")), "").alias("seq"))


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """A precomputed residue annotation as CSV with a header: file, chain, res_no, ss8, acc (0 to 1), phi, psi."""
    return spark.read.schema("file string, chain string, res_no int, ss8 string, acc double, phi double, psi double").csv(path, header=True)


def write_sheet(sheet: DataFrame, path: str, digits: int = 5) -> None:
    """A report as CSV with a header, numbers to ``digits`` digits."""
    cols = [F.format_string(f"%.{digits}f", F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in sheet.schema]
    cols = [F.when(F.col(f.name).isNotNull(), c).alias(f.name) for f, c in zip(sheet.schema, cols)]
    sheet.select(*cols).write.mode("overwrite").csv(path, header=True)


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def depth(spark: SparkSession, path: str) -> DataFrame:
    rows = splits.lines(spark, path)
    return rows.groupBy("path", "file", *_folders(rows)).agg(F.count_if(F.startswith("value", F.lit(">"))).alias("depth")).drop("path")


def header_counts(lines: DataFrame) -> DataFrame:
    """file, depth: header lines of each file's lines (file, value)."""
    return lines.groupBy("file").agg(F.count_if(F.startswith("value", F.lit(">"))).alias("depth"))


def families(spark: SparkSession, path: str) -> DataFrame:
    """file, family (text before the first '_') and name without .npy of the files in a folder."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.select("file", F.substring_index("file", "_", 1).alias("family"), F.regexp_replace("file", r"\.npy$", "").alias("name"))


def jobs(families_: DataFrame, most: int = 12000, lam: float = 0.004, beta_ratio: float = 0.125, zero: float = 1e-3) -> DataFrame:
    """A row for each family (with n_seqs) to fit: its number of models, min(5, max(3, n // 1100)), and the settings of its fit; larger families are left out."""
    k = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(F.col("n_seqs") / 1100))).cast("int")
    return families_.where(F.col("n_seqs") <= most).withColumn("k", k).withColumn("lam", F.lit(lam)).withColumn("beta", F.lit(lam * beta_ratio)).withColumn("zero", F.lit(zero))

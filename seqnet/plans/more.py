"""Further queries: residue functions, matrix shapes, records and reports, geometry and whole fits, over stand-ins made of whole driver tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqnet.functions import residues as R
from seqnet.operators import cluster, contacts, geometry, glasso, matrix, msa, reports
from seqnet.operators.pairs import CELL, all_pairs, rounded
from seqnet.operators.tables import written
from seqnet.plans.registry import FREQ, FULL, PHONES, QUERIES, SUP, _full, _msa, _scored, _scored_pairs, _supplier_pairs, phones, query, r6, table

LETTERS = "ARNDCQEGHILKMFPSTWYVX"
THREE = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]
ONE = "ARNDCQEGHILKMFPSTWYV"


def r9(c):
    return F.round(c, 9)


def letters(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.substring(F.lit(LETTERS), (F.col("p_partkey") % 21 + 1).cast("int"), F.lit(1)).alias("a"), F.substring(F.lit(LETTERS), (F.col("p_partkey") * 8 % 21 + 1).cast("int"), F.lit(1)).alias("b"))


LT = f"lt as (select p_partkey, substr('{LETTERS}', (p_partkey % 21 + 1)::int, 1) as a, substr('{LETTERS}', (p_partkey * 8 % 21 + 1)::int, 1) as b from part)"
CODES = " ".join(f"when '{letter}' then '{three}'" for three, letter in R.CODES.items())


@query("residue_codes", f"with {LT} select p_partkey, case a {CODES} end as three, case when a <> 'X' then a end as one, (nullif(instr('ARNDCQEGHILKMFPSTWYV', a), 0) - 1)::int as place from lt")
def residue_codes(spark, d):
    three = R.one_to_three(F.col("a"))
    return letters(spark, d).select("p_partkey", three.alias("three"), R.three_to_one(F.lower(three)).alias("one"), R.three_letter_order(F.col("a")).alias("place"))


@query("one_hot_cells", f"with {PHONES} select family, seq_id, pos, array_to_string(list_transform(range(0, 21), lambda x: (x = aa)::int), '') as bits from cell where aa >= 0")
def one_hot_cells(spark, d):
    return msa.cells(_msa(spark, d)).select("family", "seq_id", F.col("pos").cast("long").alias("pos"), F.array_join(R.one_hot(F.col("aa")).cast("array<string>"), "").alias("bits"))


@query("his_tags", f"with {PHONES}, s as (select family, seq_id, translate(raw, 'AR', 'HH') as s from p0), h as (select *, length(regexp_extract(s, '^(.{{0,9}}?HHH+)', 1)) as h, length(regexp_extract(s, '(HHH+.{{0,9}}?)$', 1)) as t from s) select family, seq_id, array_to_string(list_transform(range(1, 16), lambda i: (i <= h or i > 15 - t)::int), '') as mask from h")
def his_tags(spark, d):
    return phones(spark, d).select("family", "seq_id", F.array_join(R.his_tag(F.translate("seq", "AR", "HH")).cast("array<string>"), "").alias("mask"))


@query("ss3_codes", "select p_partkey, case substr('HGIEBTSL', (p_partkey % 8 + 1)::int, 1) when 'H' then 'H' when 'G' then 'H' when 'I' then 'H' when 'E' then 'E' when 'B' then 'E' else 'C' end as ss3 from part")
def ss3_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", R.ss3(F.substring(F.lit("HGIEBTSL"), (F.col("p_partkey") % 8 + 1).cast("int"), F.lit(1))).alias("ss3"))


CG = "case {} when 'V' then 'CG1' when 'I' then 'CG1' when 'T' then 'CG2' when 'S' then 'OG' when 'C' then 'SG' when 'A' then 'CB' when 'G' then 'CA' else 'CG' end"
CB = "case when {} = 'G' then 'CA' else 'CB' end"


@query("pair_atoms", f"with {LT} select p_partkey, 'CbCb' as pair, {CB.format('a')} as x, {CB.format('b')} as y from lt union all select p_partkey, 'NO', 'N', 'O' from lt union all select p_partkey, 'CaCg', 'CA', {CG.format('b')} from lt union all select p_partkey, 'CgCg', {CG.format('a')}, {CG.format('b')} from lt")
def pair_atoms(spark, d):
    lt = letters(spark, d)
    pairs = [F.struct(F.lit(p).alias("pair"), *[c.alias(n) for c, n in zip(R.pair_atoms(p, F.col("a"), F.col("b")), "xy")]) for p in ("CbCb", "NO", "CaCg", "CgCg")]
    return lt.select("p_partkey", F.explode(F.array(*pairs)).alias("v")).select("p_partkey", "v.*")


@query("orientation_atoms", f"""with {LT}, l as (select *, p_partkey % 3 = 0 as li, p_partkey % 4 = 0 as lj from lt)
select p_partkey, case when a <> 'G' and b <> 'G' then 'CA,CB,CB,CA' end as omega, case when a <> 'G' then 'N,CA,CB,' || {CB.format('b')} end as theta, case when a <> 'G' then 'CA,CB,' || {CB.format('b')} end as phi,
case when not li and not lj then 'CA,CA,CA,CA' end as four, case when not li then 'CA,CA,CA' end as three from l""")
def orientation_atoms(spark, d):
    at = lambda label: F.array_join(R.orientation_atoms(label, F.col("a"), F.col("b"), F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 4 == 0), ",")
    return letters(spark, d).select("p_partkey", at("Ca1Cb1Cb2Ca2").alias("omega"), at("N1Ca1Cb1Cb2").alias("theta"), at("Ca1Cb1Cb2").alias("phi"), at("Ca1Ca2Ca4Ca3").alias("four"), at("Ca1Ca2Ca4").alias("three"))


AB = "ab as (select family, seq_id, translate(raw, 'A', 'X') as a, reverse(translate(raw, 'R', 'X')) as b from p0)"


def _ab(spark, d):
    return phones(spark, d).select("family", "seq_id", F.translate("seq", "A", "X").alias("a"), F.reverse(F.translate("seq", "R", "X")).alias("b"))


@query("match_counts", f"with {PHONES}, {AB}, c as (select *, list_transform(range(1, 16), lambda p: [substr(a, p, 1), substr(b, p, 1)]) as v from ab) select family, seq_id, len(list_filter(v, lambda x: x[1] = x[2] and x[1] not in ('-', 'X')))::int as same, len(list_filter(v, lambda x: x[1] <> x[2] and x[1] not in ('-', 'X') and x[2] not in ('-', 'X')))::int as other from c")
def match_counts(spark, d):
    return _ab(spark, d).select("family", "seq_id", R.matches(F.col("a"), F.col("b"), "-X").alias("same"), R.mismatches(F.col("a"), F.col("b")).alias("other"))


@query("alignment_maps", f"with {PHONES}, {AB} select family, seq_id, array_to_string(list_transform(list_filter(range(1, 16), lambda p: substr(a, p, 1) <> '-'), lambda p: case when substr(b, p, 1) = '-' then -1 else length(replace(substr(b, 1, p::int), '-', '')) - 1 end), ',') as map from ab")
def alignment_maps(spark, d):
    return _ab(spark, d).select("family", "seq_id", F.array_join(R.alignment_map(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("map"))


@query("thresholded", f"with {SUP} select family, i, j, case when abs(score - 0.5) < 0.1 then 0 else round(score - 0.5, 6) end as v from ss")
def thresholded(spark, d):
    s, _ = _supplier_pairs(spark, d)
    return matrix.threshold(s.select("family", "i", "j", (F.col("score") - 0.5).alias("v")), 0.1).withColumn("v", rounded(F.col("v"), 6))


@query("spectrum_factors", f"with {SUP}, t as (select family, i % 5 as m, sum(((i * 7919 + j * 104729) % 1009)::bigint) as trace from ss group by all) select family, m, round((max(trace) over (partition by family))::double / trace, 9) as factor from t")
def spectrum_factors(spark, d):
    s, _ = _supplier_pairs(spark, d)
    t = s.groupBy("family", (F.col("i") % 5).alias("m")).agg(F.sum((F.col("i") * 7919 + F.col("j") * 104729) % 1009).alias("trace"))
    return matrix.scaled_spectrum(t).select("family", "m", r9("factor").alias("factor"))


@query("unpacked", f"with {SUP} select family, i as r, j as c, dist as v from ss union all select family, j, i, dist from ss")
def unpacked(spark, d):
    _, n = _supplier_pairs(spark, d)
    return matrix.unpack_long(n.select("family", F.col("i").alias("r"), F.col("j").alias("c"), F.col("dist").alias("v")), ["family"])


@query("symmetric_matrices", f"with {SUP}, m as (select family, i as r, j as c, dist as v from ss union all select family, j, i, case when family = '1' and i = 1 then dist + 1 else dist end from ss), b as (select family from (select family, least(r, c) as a, greatest(r, c) as b, max(v) - min(v) as d from m group by all) group by 1 having max(d) <= 1e-9) select family, count(*) as n from m join b using (family) group by 1")
def symmetric_matrices(spark, d):
    n = _scored_pairs(spark, d, 1_000_000)  # an entry of a matrix is a group of its task
    m = matrix.unpack_long(n.select("family", *CELL, F.col("i").alias("r"), F.col("j").alias("c"), F.col("dist").alias("v")), ["family"], CELL)
    first = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).cast("string").alias("f"), F.col("s_suppkey").alias("s")).where("s = 1")
    m = m.join(F.broadcast(first), (F.col("family") == F.col("f")) & (F.col("c") == 1), "left").withColumn("v", F.when((F.col("family") == "1") & F.col("s").isNotNull() & (F.col("r") > F.col("c")), F.col("v") + 1).otherwise(F.col("v"))).select("family", *CELL, "r", "c", "v")
    return matrix.symmetric_only(m, ["family"], within=CELL).groupBy("family").agg(F.count("*").alias("n"))


@query("reembedded", """with f as (select distinct s_nationkey % 3 as f from supplier), s as (select f::varchar as family, list_filter(range(0, 8), lambda x: x <> f and x <> f + 3) as kept from f),
c as (select family, r, c, list_position(kept, r) - 1 as a, list_position(kept, c) - 1 as b from s, range(0, 8) x(r), range(0, 8) y(c)) select family, r, c, case when a >= 0 and b >= 0 then ((a * 7 + b * 3) % 5)::double else 0 end as v from c""")
def reembedded(spark, d):
    f = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).cast("long").alias("f")).distinct().withColumn("family", F.col("f").cast("string"))
    left = f.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("r")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("c")).withColumn("v", ((F.col("r") * 7 + F.col("c") * 3) % 5).cast("double"))
    gone = f.select("family", F.explode(F.array(F.col("f"), F.col("f") + 3)).alias("pos"))
    return matrix.reembed(left, gone, f.select("family", F.lit(8).cast("long").alias("n")), ["family"])


@query("target_names", "select s_suppkey, case when s_suppkey % 2 = 0 then 's' || s_suppkey else 's' || s_suppkey end as target, case s_suppkey % 3 when 0 then 'phylo' when 1 then 'random' else 'm2' end as method, coalesce(nullif(s_suppkey % 4, 0), 100)::bigint as max_sep from supplier")
def target_names(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("s"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "_3.npy").otherwise(".npy"))
    return s.select("s_suppkey", R.target_of(name).alias("target"), R.renamed(F.concat(F.lit("m"), F.col("s_suppkey") % 3), {"m0": "phylo", "m1": "random"}).alias("method"), R.max_sep(F.nullif(F.col("s_suppkey") % 4, F.lit(0).cast("long")), F.lit(100).cast("long")).alias("max_sep"))


# ---- precision records of lineitem rows

REC = """rec as (select case when l_returnflag = 'R' then 'psicov' else l_returnflag end as method, l_suppkey as target, case when l_orderkey % 2 = 0 then 'TOP_L' else 'NORMAL' end as ty, l_linestatus = 'F' as is_final, (l_linenumber - 1)::int as model_idx, l_linenumber = 7 as is_avg,
l_linenumber in (3, 4) as is_target, round(l_tax * 12.5, 6) as s2, case l_linenumber % 2 when 0 then 5 else 9 end::int as min_sep, (['L', 'L/2', 'L/5', 'L/10'])[(l_partkey % 4 + 1)::int] as cutoff, l_discount as precision, 100 + l_suppkey as seq_len, l_orderkey as o, l_linenumber as l from lineitem)"""


def precision_records(spark, d) -> DataFrame:
    li, c = table(spark, d, "lineitem"), F.col
    return li.select(
        F.when(c("l_returnflag") == "R", "psicov").otherwise(c("l_returnflag")).alias("method"), c("l_suppkey").alias("target"), F.when(c("l_orderkey") % 2 == 0, "TOP_L").otherwise("NORMAL").alias("ty"), (c("l_linestatus") == "F").alias("is_final"),
        (c("l_linenumber") - 1).cast("int").alias("model_idx"), (c("l_linenumber") == 7).alias("is_avg"), c("l_linenumber").isin(3, 4).alias("is_target"), F.round(c("l_tax") * 12.5, 6).alias("s2"), F.when(c("l_linenumber") % 2 == 0, 5).otherwise(9).alias("min_sep"),
        F.lit(None).cast("int").alias("max_sep"), F.element_at(F.array(*map(F.lit, ("L", "L/2", "L/5", "L/10"))), (c("l_partkey") % 4 + 1).cast("int")).alias("cutoff"), c("l_discount").alias("precision"), (c("l_suppkey") + 100).alias("seq_len"), c("l_orderkey").alias("o"), c("l_linenumber").alias("l"),
    )


META = "meta as (select s_suppkey as target, 100 + s_suppkey as seq_len, s_suppkey * 3 as depth, s_acctbal as meff from supplier where s_suppkey % 9 <> 0)"


def meta(spark, d) -> DataFrame:
    return table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("target"), (F.col("s_suppkey") + 100).alias("seq_len"), (F.col("s_suppkey") * 3).alias("depth"), F.col("s_acctbal").alias("meff"))


FIRST, TARGET = "(s2 between 0 and 1 and model_idx = 0)", "(s2 between 0 and 1 and is_target)"
KIND = f"case kind when 'ALL' then true when 'FIRST' then {FIRST} when 'TARGET' then {TARGET} when 'AVG' then is_avg else not {FIRST} and not {TARGET} and not is_avg end"
EVERY = "(values ('ALL'), ('FIRST'), ('TARGET'), ('NOT FIRST OR TARGET'), ('AVG')) k(kind)"


@query("record_kinds", f"with {REC} select method, kind, count(*) as n from rec, {EVERY} where {KIND} group by all")
def record_kinds(spark, d):
    r = precision_records(spark, d)
    return r.withColumn("kind", F.explode(F.filter(F.array(*[F.when(reports.of_kind(k), k) for k in reports.KINDS]), lambda x: x.isNotNull()))).groupBy("method", "kind").agg(F.count("*").alias("n"))


@query("sheet_filter", f"with {REC} select target, o, l from rec where ty = 'TOP_L' and model_idx = 2 and cutoff = 'L/2'")
def sheet_filter(spark, d):
    return reports.where_equal(precision_records(spark, d), {"ty": "TOP_L", "model_idx": 2, "cutoff": "L/2"}).select("target", "o", "l")


@query("members", f"with {REC}, {META} select method, count(*) as n from rec where target in (select target from meta) group by 1")
def members(spark, d):
    return reports.members(precision_records(spark, d), meta(spark, d), "target").groupBy("method").agg(F.count("*").alias("n"))


@query("records_with_metadata", f"with {REC}, {META} select r.target, o, l, m.depth, m.meff from rec r left join meta m using (target)")
def records_with_metadata(spark, d):
    return reports.with_metadata(precision_records(spark, d).select("target", "o", "l"), meta(spark, d).select("target", "depth", "meff"))


@query("last_precision", f"with {REC} select method, target, arg_max(precision, (o, l)) as precision from rec group by all")
def last_precision(spark, d):
    r = precision_records(spark, d).withColumn("at", F.struct("o", "l"))
    return reports.last_by(r, ["method", "target"], "precision", "at")


@query("gathered_records", f"with {REC} select target, min_sep, array_to_string(list_transform(list_sort(list(precision)), lambda x: round(x * 100)::int), ',') as v from rec where ty = 'TOP_L' group by all")
def gathered_records(spark, d):
    g = reports.gathered(precision_records(spark, d).where("ty = 'TOP_L'"), ["target", "min_sep"])
    return g.select("target", "min_sep", F.array_join(F.transform("values", lambda x: F.round(x * 100).cast("int").cast("string")), ",").alias("v"))


@query("values_by_separation", f"with {REC} select target, min_sep, cutoff, round(s2 * seq_len, 6) as x, precision from rec where is_avg")
def values_by_separation(spark, d):
    return reports.values_by_separation(precision_records(spark, d).where("is_avg"), "s2").withColumn("x", r6("x"))


@query("precision_against_meff", f"with {REC}, {META} select method, target, meff, precision from rec join meta using (target) where is_avg and cutoff = 'L'")
def precision_against_meff(spark, d):
    return reports.against(precision_records(spark, d).where("is_avg and cutoff = 'L'"), meta(spark, d), "meff", ["method"])


SHEET = f"""k as (select * from rec, {EVERY} where ty = 'TOP_L' and (method like '%psicov%' or (is_final and {KIND}))),
qs as (select method, target, kind, min_sep, cutoff, [quantile_cont(precision, 0.25), quantile_cont(precision, 0.5), quantile_cont(precision, 0.75), max(precision), avg(precision)] as v from k group by method, target, kind, min_sep, cutoff),
q as (select method, target, kind, min_sep, cutoff, unnest(['q25', 'q50', 'q75', 'q100', 'mean']) as data_type, round(unnest(v), 9) as v from qs),
sheet as (select target, method, kind, min_sep, data_type, {', '.join(f"max(case when cutoff = '{c}' then v end) as {n}" for c, n in (('L', 'l1'), ('L/2', 'l2'), ('L/5', 'l5'), ('L/10', 'l10')))} from q group by all)"""
CUTS = (("L", "l1"), ("L/2", "l2"), ("L/5", "l5"), ("L/10", "l10"))


def _sheet(spark, d):
    s = reports.report(precision_records(spark, d), meta(spark, d).select("target", "depth", "meff"), [c for c, _ in CUTS], "TOP_L", True)
    return s.withColumnsRenamed(dict(CUTS)).select("target", "method", "kind", "min_sep", "data_type", *[r9(n).alias(n) for _, n in CUTS], "depth", "meff")


@query("report_sheet", f"with {REC}, {META}, {SHEET} select sheet.*, depth, meff from sheet left join meta using (target)")
def report_sheet(spark, d):
    return _sheet(spark, d)


@query("target_table", f"with {REC}, {META}, {SHEET} select target, method, kind, min_sep, cutoff, precision from (unpivot (select * from sheet where data_type = 'q75') on l1, l2, l5, l10 into name cutoff value precision)")
def target_table(spark, d):
    return reports.target_table(_sheet(spark, d), ["target", "method", "kind", "min_sep"], [n for _, n in CUTS], "q75").where("precision is not null")


@query("result_folders", """with f as (select case s_suppkey % 5 when 0 then 'x/result_remove_gaps_a' when 1 then 'x/result_b' when 2 then 'y/target_psicov' when 3 then 'other_psicov' else 'z/result_psicov_' || s_suppkey end as folder, 'f' || s_suppkey as file from supplier),
m as (select folder from f where regexp_matches(folder, '/(result|target)[^/]*$') and regexp_matches(folder, '/[^/]*(remove_gaps|psicov)[^/]*$') group by 1 having count(*) > 1) select folder, file from f where folder in (select folder from m)""")
def result_folders(spark, d):
    k, c = F.col("s_suppkey"), F.col("s_suppkey") % 5
    folder = F.when(c == 0, "x/result_remove_gaps_a").when(c == 1, "x/result_b").when(c == 2, "y/target_psicov").when(c == 3, "other_psicov").otherwise(F.concat(F.lit("z/result_psicov_"), k))
    return reports.result_files(table(spark, d, "supplier").select(folder.alias("folder"), F.concat(F.lit("f"), k).alias("file")))


@query("admitted_structures", "select p_partkey from part where p_partkey % 9 <= 5 and p_size >= least(30, 0.5 * (p_partkey % 70)) and p_partkey % 13 <= 10 and p_partkey % 17 <= 10")
def admitted_structures(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 9).alias("n_mismatch"), F.col("p_size").alias("n_match"), (F.col("p_partkey") % 70).alias("seq_len"), (F.col("p_partkey") % 13).alias("bad_ca"), (F.col("p_partkey") % 17).alias("bad_cb"))
    return geometry.admitted(p).select("p_partkey")


@query("fit_jobs", f"with {PHONES}, n as (select family, count(*) as n_seqs from msa group by 1) select family, n_seqs, least(5, greatest(3, n_seqs // 1100))::int as k, 0.004::double as lam, 0.0005::double as beta, 0.001::double as zero from n where n_seqs <= 12000")
def fit_jobs(spark, d):
    from seqnet.sources.readers import jobs

    return jobs(phones(spark, d).groupBy("family").agg(F.count("*").alias("n_seqs"))).withColumn("beta", r9("beta"))


# ---- clusters

@query("supplied_clusters", f"with {PHONES}, l as (select family, seq_id % 3 as c, seq_id from msa) select family, c::int as cluster_idx, seq_id from l")
def supplied_clusters(spark, d):
    lists = phones(spark, d).groupBy("family").agg(F.array(*[F.collect_list(F.when(F.col("seq_id") % 3 == k, F.col("seq_id"))) for k in range(3)]).alias("clusters"))
    return cluster.supplied(lists)


@query("target_clusters", f"with {PHONES}, t as (select family, arg_max(seq, seq_id) as target from msa group by 1), c as (select family, seq_id, 0 as c from msa union all select family, seq_id, (seq_id % 3 + 1)::int from msa) select c.family, c.c::int as cluster_idx, max(seq = target) and c.c > 0 as is_target from c join msa using (family, seq_id) join t using (family) group by c.family, c.c")
def target_clusters(spark, d):
    m = _msa(spark, d)
    clusters = cluster.with_all_first(m, m.select("family", (F.col("seq_id") % 3).cast("int").alias("cluster_idx"), "seq_id"), 4)
    return cluster.with_target(clusters, m, m.groupBy("family").agg(F.max_by("seq", "seq_id").alias("target")))


BLOSUM = "bl as (select substr('ARNDCQEGHILKMFPSTWYV', r::int, 1) as x, substr('ARNDCQEGHILKMFPSTWYV', c::int, 1) as y, ([" + ", ".join(str(v) for v in cluster.MATRIX.ravel().tolist()) + "])[((r - 1) * 20 + c)::int] as s from range(1, 21) a(r), range(1, 21) b(c))"


@query("blosum_distances", f"""with {PHONES}, {BLOSUM}, m as (select * from msa), c as (select family, seq_id, p, substr(norm, p, 1) as x from m, range(1, 16) r(p)), o as (select c.*, s as own from c join bl using (x) where bl.x = bl.y),
s as (select a.family, a.seq_id as i, b.seq_id as j, sum(bl.s) as s, greatest(sum(a.own), sum(b.own)) as mx from o a join o b on a.family = b.family and a.p = b.p and a.seq_id < b.seq_id join bl on bl.x = a.x and bl.y = b.x group by all)
select a.family, a.seq_id as i, b.seq_id as j, round(case when mx > 0 then 1 - s.s::double / mx else 1 end, 9) as d from m a join m b on a.family = b.family and a.seq_id < b.seq_id left join s on s.family = a.family and s.i = a.seq_id and s.j = b.seq_id""")
def blosum_distances(spark, d):
    return cluster.blosum_pairs(_msa(spark, d)).withColumn("d", rounded(F.col("d"), 9))


@query("fit_graph", f"with {PHONES}, c as (select distinct family, seq_id % 4 as c from msa), n as (select family, c, case when c = 2 then 0.5::double else 0.004 end as lam from c), o as (select family, c, lag(c) over (partition by family order by c) as p from c) select family, p::int as src, c::int as dst, 'temporal' as kind, 0.0005::double as coef from o where p is not null union all select family, c::int, c::int, 'lasso', lam from n")
def fit_graph(spark, d):
    c = phones(spark, d).select("family", (F.col("seq_id") % 4).cast("int").alias("cluster_idx"), "seq_id")
    loads = c.where("cluster_idx = 2").select("family", F.col("cluster_idx").alias("node"), F.lit(0.5).alias("lam")).distinct()
    return glasso.chain_problem(c, 0.004, 0.0005, loads)[1]


@query("weighted_covariance", """with e as (select label, (vec_id % 5 + 1)::double as w, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), m as (select label, sum(w) as sw, sum(w * w) as s2, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my, sum(w * z) / sum(w) as mz from e group by 1),
c as (select label, sw - s2 / sw as n, sum(w * (x - mx) * (x - mx)) as xx, sum(w * (x - mx) * (y - my)) as xy, sum(w * (x - mx) * (z - mz)) as xz, sum(w * (y - my) * (y - my)) as yy, sum(w * (y - my) * (z - mz)) as yz, sum(w * (z - mz) * (z - mz)) as zz from e join m using (label) group by all)
select label, substr(k, 1, 1) as x, substr(k, 2, 1) as y, round(v / n, 6) as cov from (unpivot c on xx, xy, xz, yy, yz, zz into name k value v)""")
def weighted_covariance(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 5 + 1).cast("double").alias("w"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return msa.weighted_covariance(e, ["label"], ["x", "y", "z"], "w").withColumn("cov", r6("cov"))


# ---- fits and their evaluation

EVAL = f"""sc as (select family, 0 as m, i, j, round(sum(case when abs(cov) >= 0.0005 then abs(cov) else 0 end), 9) as score from fc where i < j and a < 20 and b < 20 group by family, i, j),
n1 as (select family, sum(case when abs(cov) >= 1e-3 then 1 else 0 end) as n1 from fc where i < j group by 1), n2 as (select family, sum(case when score >= 0.1 then 1 else 0 end) as n2 from sc group by 1),
bands as (select * from (values ('NORMAL', 5, 9), ('NORMAL', 10, 23), ('NORMAL', 23, null), ('TOP_L', 5, null), ('TOP_L', 9, null), ('TOP_L', 12, null), ('TOP_L', 24, null)) b(ty, lo, hi)),
r as (select *, case when (i * 31 + j * 17) % 23 <= 8 and (i + j) % 19 <> 0 then 1 else 0 end as hit, row_number() over (partition by family, ty, lo, hi order by score desc, i, j) as rk from sc, bands where j - i >= lo and (hi is null or j - i <= hi)),
cuts as (select * from (values ('NORMAL', '1', 1), ('NORMAL', '2', 2), ('NORMAL', '5', 5), ('NORMAL', '10', 10), ('NORMAL', '25', 25), ('NORMAL', '50', 50), ('NORMAL', '100', 100), ('TOP_L', 'L', 15), ('TOP_L', 'L/2', 7), ('TOP_L', 'L/5', 3), ('TOP_L', 'L/10', 1)) c(ty, cutoff, k))"""


@query("evaluate_records", f"with {PHONES}, {FREQ}, {FULL}, {EVAL} select r.family, r.ty, lo::int as min_sep, hi::int as max_sep, cutoff, k::bigint as k, round(sum(hit)::double / k, 9) as precision, round(2 * any_value(n1)::double / (315 * 315), 9) as s1, round(2 * any_value(n2)::double / 225, 9) as s2 from r join cuts on cuts.ty = r.ty and rk <= k join n1 on n1.family = r.family join n2 on n2.family = r.family group by r.family, r.ty, lo, hi, cutoff, k")
def evaluate_records(spark, d):
    theta = written(_full(spark, d).select("family", F.lit(0).alias("model_idx"), "i", "a", "j", "b", F.col("cov").alias("v")), "theta")
    lengths = theta.select("family", F.lit(15).alias("seq_len")).distinct()
    ij = theta.select("family", "i", "j").where("i < j").distinct()
    native = ij.select("family", "i", "j", ((F.col("i") * 31 + F.col("j") * 17) % 23).cast("double").alias("dist"), ((F.col("i") + F.col("j")) % 19 != 0).alias("valid"))
    out = contacts.evaluate(theta, native, lengths, 0.0005)
    return out.select("family", "ty", "min_sep", "max_sep", "cutoff", "k", r9("precision").alias("precision"), r9("s1").alias("s1"), r9("s2").alias("s2"))


@query("mean_model", f"with {SUP}, f as (select family, (i % 3)::int as m, i // 3 as p, j as q, score as v from ss), n as (select family, m, count(*) as n from f group by all), w as (select family, m, n::double / sum(n) over (partition by family) as w, max(m) over (partition by family) as last from n) select family, m as model_idx, p as i, q as j, round(v, 9) as v, false as is_avg from f union all select f.family, (any_value(last) + 1)::int, p, q, round(sum(v * w), 9), true from f join w using (family, m) group by f.family, p, q")
def mean_model(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).cast("string").alias("family"), F.col("s_suppkey").alias("i"))
    # entries of the models at one position are in one cell
    p = _scored(all_pairs(s, s.withColumnRenamed("i", "j"), "family", F.expr("i div 3"), F.col("j"), 2_000_000).where("i < j"))
    f = p.select("family", *CELL, (F.col("i") % 3).cast("int").alias("model_idx"), F.expr("i div 3").alias("i"), F.lit(0).alias("a"), "j", F.lit(0).alias("b"), F.col("score").alias("v"))
    out = contacts.with_mean_model(f, f.groupBy("family", "model_idx").agg(F.count("*").alias("n")), CELL)
    return out.select("family", "model_idx", "i", "j", rounded(F.col("v"), 9).alias("v"), "is_avg")


#: Settings of the whole fit below: matrices of 147 x 147, three models at most.
CFG = glasso.GlassoConfig(lam=0.01, beta=0.005, max_iters=10, final_iters=15, trials=3, target_density=0.05, density_tol=0.02, offset=21)


def _fits(spark, d):
    """Alignments of seven columns of balances and keys, their clusters by the key, the whole family first."""
    m = phones(spark, d).withColumn("seq", F.substring("seq", 3, 7))
    clusters = cluster.with_all_first(m, cluster.random_clusters(m, 2, 3), 3)
    return glasso.fit_families(m, clusters, CFG)


@query("fit_families")
def fit_families(spark, d):
    return _fits(spark, d)


@query("fit_precision")
def fit_precision(spark, d):
    """From alignments to precision records: fits, contact scores, bands."""
    scores = contacts.contact_scores(_fits(spark, d), 1e-4)
    families = phones(spark, d).select("family").distinct()
    seven = F.sequence(F.lit(1), F.lit(7))
    native = families.select("family", F.explode(seven).alias("i")).select("*", F.explode(seven).alias("j")).where("i < j")
    native = native.withColumn("dist", ((F.col("i") * 31 + F.col("j") * 17) % 23).cast("double")).withColumn("valid", F.lit(True))
    return contacts.records(scores, native, families.withColumn("seq_len", F.lit(7)))


# ---- geometry: atoms from components of embeddings

ATOMS = ("n", "ca", "cb", "cg", "o", "vcb")
MISSING = {"cb": "vec_id % 11 = 0", "cg": "vec_id % 7 = 0", "vcb": "vec_id % 5 <> 0", "o": "vec_id % 17 = 0"}


def _component(atom: str, k: int, x: int) -> str:
    """SQL of a coordinate; where vec_id % 13 is 0, CB is a copy of CA."""
    v = f"embedding[{3 * k + 1 + x}]::double"
    v = f"case when {MISSING[atom]} then null else {v} end" if atom in MISSING else v
    return f"case when vec_id % 13 = 0 then embedding[{4 + x}]::double else {v} end" if atom == "cb" else v


COORDS = "co as (select label::varchar as family, row_number() over (partition by label order by vec_id)::bigint as res, vec_id, " + ", ".join(f"{_component(a, k, x)} as {a}{x}" for k, a in enumerate(ATOMS) for x in range(3)) + " from embeddings)"


def coords(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("res", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long"))
    xyz = lambda k: F.transform(F.slice("embedding", 3 * k + 1, 3), lambda x: x.cast("double"))
    cols = []
    for k, a in enumerate(ATOMS):
        c = F.when(F.expr(MISSING[a]), None).otherwise(xyz(k)) if a in MISSING else xyz(k)
        cols.append((F.when(F.col("vec_id") % 13 == 0, xyz(1)).otherwise(c) if a == "cb" else c).alias(a))
    return e.select(F.col("label").cast("string").alias("family"), "res", "vec_id", *cols)


def vec(row: str, atom: str) -> list[str]:
    return [f"{row}.{atom}{x}" for x in range(3)]


def sub(a, b):
    return [f"({x} - {y})" for x, y in zip(a, b)]


def dot(a, b):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def cross(a, b):
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def sql_angle(a, b, c):
    u, v = sub(a, b), sub(c, b)
    cos = f"{dot(u, v)} / (sqrt({dot(u, u)}) * sqrt({dot(v, v)}))"
    return f"degrees(acos(case when {cos} > 1 then 1.0 when {cos} < -1 then -1.0 else {cos} end))"


def sql_dihedral(a, b, c, d):
    u, v, w = sub(b, a), sub(c, b), sub(d, c)
    p, q = cross(u, v), cross(v, w)
    return f"degrees(atan2({dot(cross(p, q), v)} / sqrt({dot(v, v)}), {dot(p, q)}))"


def own(x):
    return f"round(case when a.res = b.res then 0 else {x} end, 4)"


def sql_dist(a, b):
    v = sub(a, b)
    return f"sqrt({dot(v, v)})"


def r4(df, *names):
    return df.select("family", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *[rounded(F.col(n), 4).alias(n) for n in names])


PAIR_SQL = " union all ".join(f"select a.family, a.res as i, b.res as j, '{n}' as atom_pair, case when {'a.res = b.res' if x == y else 'false'} then 0.0 else {sql_dist(vec('a', x), vec('b', y))} end as dist from co a join co b on a.family = b.family" for n, (x, y) in geometry.PAIRS.items())


@query("atom_distances", f"with {COORDS}, p as ({PAIR_SQL}) select family, i, j, atom_pair, round(dist, 6) as dist, dist is not null as valid from p")
def atom_distances(spark, d):
    return geometry.distances(coords(spark, d)).withColumn("dist", rounded(F.col("dist"), 6))


AT = f"substr('{ONE}', (vec_id % 20 + 1)::int, 1)"
NO_SQL, CG_SQL = (" ".join(f"when '{k}' then {v}" for k, v in t.items()) for t in (R.NO_DIST, R.CACG_DIST))


@query("repaired_distances", f"""with {COORDS}, p as ({PAIR_SQL}), l as (select family, res as i, {AT} as letter from co) select p.family, i, j, atom_pair, round(case when i = j and atom_pair in ('CaCa', 'CbCb', 'CgCg') then 1e-4 when atom_pair = 'CaCa' and abs(i - j) = 1 then coalesce(dist, 3.8)
when i = j and atom_pair = 'NO' then coalesce(dist, case letter {NO_SQL} end) when i = j and atom_pair = 'CaCg' then coalesce(dist, case letter {CG_SQL} end) else dist end, 6) as dist from p join l using (family, i)""")
def repaired_distances(spark, d):
    c = coords(spark, d)
    letter = F.substring(F.lit(ONE), (F.col("vec_id") % 20 + 1).cast("int"), F.lit(1))
    out = geometry.repaired_distances(c, c.select("family", "res", letter.alias("letter")))
    return out.select("family", "i", "j", "atom_pair", rounded(F.col("dist"), 6).alias("dist"))


def _co(a, *atoms):
    return [f"coalesce({', '.join(f'{a}.{x}{k}' for x in atoms)})" for k in range(3)]


USABLE = f"us as (select * exclude (cb0, cb1, cb2), " + ", ".join(f"case when {sql_dist(vec('co', 'cb'), vec('co', 'ca'))} >= 0.1 then cb{k} end as cb{k}" for k in range(3)) + " from co)"


@query("cb_orientations", f"with {COORDS}, {USABLE} select a.family, a.res as i, b.res as j, {own(sql_dihedral(vec('a', 'ca'), _co('a', 'cb', 'vcb'), _co('b', 'cb', 'vcb'), vec('b', 'ca')))} as omega, {own(sql_dihedral(vec('a', 'n'), vec('a', 'ca'), _co('a', 'cb', 'vcb'), _co('b', 'cb', 'ca', 'vcb')))} as theta, {own(sql_angle(vec('a', 'ca'), _co('a', 'cb', 'vcb'), _co('b', 'cb', 'ca', 'vcb')))} as phi from us a join us b on a.family = b.family")
def cb_orientations(spark, d):
    return r4(geometry.cb_orientations(coords(spark, d)), "omega", "theta", "phi")


NEXT = "nx as (select *, " + ", ".join(f"lead(ca{k}) over (partition by family order by res) as cx{k}" for k in range(3)) + " from co)"


@query("ca_orientations", f"with {COORDS}, {NEXT} select a.family, a.res as i, b.res as j, {own(sql_dihedral(vec('a', 'ca'), vec('a', 'cx'), vec('b', 'ca'), vec('b', 'cx')))} as d1234, {own(sql_angle(vec('a', 'ca'), vec('a', 'cx'), vec('b', 'ca')))} as a123, {own(sql_dihedral(vec('a', 'ca'), vec('a', 'cx'), vec('b', 'cx'), vec('b', 'ca')))} as d1243, {own(sql_angle(vec('a', 'ca'), vec('a', 'cx'), vec('b', 'cx')))} as a124 from nx a join nx b on a.family = b.family where a.res <> b.res - 1 and a.res <> b.res + 1")
def ca_orientations(spark, d):
    # neighbours share a CA, where angles are 0 or have no plane: the two engines needn't agree on the last digit there
    out = geometry.ca_orientations(coords(spark, d).select("family", "res", "ca")).where("abs(i - j) <> 1")
    return r4(out, "d1234", "a123", "d1243", "a124")


@query("mapped_coordinates", """with a as (select label::varchar as family, vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, (['N', 'CA', 'C', 'O', 'CB', 'CG', 'OG', 'SG'])[(vec_id % 8 + 1)::int] as atom, vec_id // 8 as no from embeddings),
r as (select family, no, substr('ARNDCQEGHILKMFPSTWYV', (no % 20 + 1)::int, 1) as letter, atom, min([x, y, z]) as v from a group by all),
p as (select family, no, any_value(letter) as letter, any_value(case when atom = 'N' then v end) as n, any_value(case when atom = 'CA' then v end) as ca, any_value(case when atom = (case when letter = 'G' then 'CA' else 'CB' end) then v end) as cb,
any_value(case when atom = (case letter when 'V' then 'CG1' when 'I' then 'CG1' when 'T' then 'CG2' when 'S' then 'OG' when 'C' then 'SG' when 'A' then 'CB' when 'G' then 'CA' else 'CG' end) then v end) as cg from r group by all)
select family, no as res, letter, round(n[1], 6) as n1, round(ca[2], 6) as ca2, round(cb[3], 6) as cb3, round(cg[1], 6) as cg1 from p""")
def mapped_coordinates(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("file"), F.lit("A").alias("chain"), F.expr("vec_id div 8").alias("res_no"), F.element_at(F.array(*map(F.lit, ("N", "CA", "C", "O", "CB", "CG", "OG", "SG"))), (F.col("vec_id") % 8 + 1).cast("int")).alias("atom"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    atoms = e.withColumn("residue", R.one_to_three(F.substring(F.lit(ONE), (F.col("res_no") % 20 + 1).cast("int"), F.lit(1))))
    mapping = atoms.select(F.col("file").alias("family"), F.col("res_no").alias("res"), "file", "chain", "res_no").distinct()
    out = geometry.coordinates(mapping, atoms)
    return out.select("family", "res", "letter", *[F.round(F.col(a)[k], 6).alias(f"{a}{k + 1}") for a, k in (("n", 0), ("ca", 1), ("cb", 2), ("cg", 0))])


ANN = "an as (select p_partkey as no, substr('HGIEBTSLC-', (p_partkey % 10 + 1)::int, 1) as ss8, case when p_partkey % 6 <> 0 then p_size / 50.0::double end as acc, p_retailprice as phi from part where p_partkey % 4 <> 0)"


@query("annotated_residues", f"with {ANN}, j as (select p_partkey as res, ss8, acc, phi, case when ss8 is null or ss8 in ('-', 'C') then 'L' else ss8 end as s, coalesce(acc * 100, 45) as pa from part left join an on no = p_partkey) select res, (ss8 is null)::int as missing, s as ss8, case when s in ('H', 'G', 'I') then 'H' when s in ('E', 'B') then 'E' else 'C' end as ss3, case when pa <= 10 then 0 when pa <= 43 then 1 else 2 end::int as acc, phi from j")
def annotated_residues(spark, d):
    p = table(spark, d, "part")
    mapping = p.select(F.lit("f").alias("family"), F.col("p_partkey").alias("res"), F.lit("f").alias("file"), F.lit("A").alias("chain"), F.col("p_partkey").alias("res_no"))
    ann = p.where("p_partkey % 4 <> 0").select(F.lit("f").alias("file"), F.lit("A").alias("chain"), F.col("p_partkey").alias("res_no"), F.substring(F.lit("HGIEBTSLC-"), (F.col("p_partkey") % 10 + 1).cast("int"), F.lit(1)).alias("ss8"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") / 50.0).alias("acc"), F.col("p_retailprice").alias("phi"), F.lit(0.0).alias("psi"))
    return geometry.annotated(mapping, ann).select("res", "missing", "ss8", "ss3", "acc", "phi")


@query("numbering_differences", "with m as (select (s_nationkey % 3)::varchar as family, s_suppkey as res, case when s_suppkey % 5 = 0 then -1 else s_suppkey * 2 % 31 end as k, s_suppkey % 29 as num from supplier), w as (select *, lag(k) over (partition by family order by res) as pa, lag(num) over (partition by family order by res) as pn from m) select family, sum(case when k < 0 then 10 when pa < 0 then 0 else abs(greatest(1, num - pn) - (k - pa)) end)::bigint as diff from w where pa is not null group by 1")
def numbering_differences(spark, d):
    k = F.col("s_suppkey")
    m = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).cast("string").alias("family"), k.alias("res"), F.when(k % 5 == 0, -1).otherwise(k * 2 % 31).alias("at"), (k % 29).alias("res_no"))
    return geometry.numbering_difference(m)


__all__ = ["QUERIES"]

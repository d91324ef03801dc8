"""Weights, frequencies, covariances and filters of alignments: rows (family, seq_id, seq)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqnet.functions.residues import ALPHABET, gap_fraction, letter_index, matches, normalize, ungapped_length
from seqnet.operators.pairs import block_pairs

Q = len(ALPHABET)


def cells(msa: DataFrame, alphabet: str = ALPHABET, other: int | None = None) -> DataFrame:
    """family, seq_id, pos (from 1), aa (0 to 20); letters outside the alphabet go, or become ``other``."""
    long = msa.select("family", "seq_id", F.posexplode(F.split("seq", "")).alias("p", "ch"))
    aa = letter_index(F.col("ch"), alphabet)
    long = long.select("family", "seq_id", (F.col("p") + 1).alias("pos"), (F.coalesce(aa, F.lit(other)) if other is not None else aa).cast("int").alias("aa"))
    return long.where("aa is not null")


#: Sequences that are compared with one another in one go, about.
BLOCK = 2048


def _letters(seqs: list[str]) -> np.ndarray:
    """Code points, a row for each of equally long sequences."""
    return np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32).reshape(len(seqs), -1) if seqs else np.zeros((0, 0), np.uint32)


def _block_pairs(msa: DataFrame, block: int) -> DataFrame:
    """family, ba, bb, sa, sb: pairs of blocks (ba <= bb) of some ``block`` sequences of a family, or more where that would be too many blocks."""
    pairs = block_pairs(msa.select("family", "seq_id", "seq"), "family", "seq_id", ["seq_id", "seq"], True, block, 100_000_000)
    return pairs.withColumnsRenamed({"ba_": "ba", "bb_": "bb", "a": "sa", "b": "sb"})


def _neighbours(msa: DataFrame, near) -> DataFrame:
    """family, seq_id, n: the number of other sequences of the family that are near by near(a, b) -> (whether the other is near each of a, whether near each of b; rows of a by b). Pairs of a family's blocks are rows, compared as matrices of some BLOCK rows."""

    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (ia, sa), (ib, sb) = ((v.field("seq_id").to_numpy(zero_copy_only=False), v.field("seq").to_pylist()) for v in (batch.column(c)[r].values for c in ("sa", "sb")))
                one = batch.column("ba")[r] == batch.column("bb")[r]
                x, y = _letters(sa), _letters(sb)
                na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                for k in range(0, len(ia), BLOCK):
                    for m in range(0, len(ib), BLOCK):
                        ab, ba = near(x[k : k + BLOCK], y[m : m + BLOCK])
                        if one:
                            own = ia[k : k + BLOCK, None] == ib[None, m : m + BLOCK]
                            ab = ab & ~own if own.any() else ab
                        else:
                            nb[m : m + BLOCK] += np.count_nonzero(ba, 0)
                        na[k : k + BLOCK] += np.count_nonzero(ab, 1)
                ids, n = (ia, na) if one else (np.concatenate([ia, ib]), np.concatenate([na, nb]))
                family = pa.DictionaryArray.from_arrays(np.zeros(len(ids), np.int32), pa.array([batch.column("family")[r].as_py()])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([family, pa.array(ids), pa.array(n)], ["family", "seq_id", "n"])

    part = _block_pairs(msa, BLOCK).mapInArrow(each, "family string, seq_id bigint, n bigint")
    return part.groupBy("family", "seq_id").agg(F.sum("n").alias("n"))


def _equal(x: np.ndarray, y: np.ndarray, skip: str = "") -> np.ndarray:
    """Numbers of equal letters at equal positions (rows of x by rows of y), as one product of matrices of 0 and 1, which has a column for each letter of a position that both have."""
    a, b = [], []
    for k in range(x.shape[1]):
        both = np.intersect1d(x[:, k], y[:, k])
        both = both[~np.isin(both, [ord(c) for c in skip])] if skip else both
        a.append(x[:, k, None] == both)
        b.append(y[:, k, None] == both)
    return np.concatenate(a, 1).astype(np.float32) @ np.concatenate(b, 1).astype(np.float32).T if a else np.zeros((len(x), len(y)), np.float32)


def _joined(msa: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """A join by sequence. Both sides grow with the table, so neither is broadcast, whatever Spark takes their sizes for."""
    return msa.join(other.hint("merge"), ["family", "seq_id"], how)


def weights(msa: DataFrame, share: float = 0.62) -> DataFrame:
    """Weight 1 / (1 + number of other sequences of the family that agree in more than ``share`` of this one's letters)."""

    def near(x, y):
        m = _equal(x, y, "-")
        # whole numbers are above a bound if they are above its floor
        return m > np.floor(share * (x != ord("-")).sum(1)).astype(np.float32)[:, None], m > np.floor(share * (y != ord("-")).sum(1)).astype(np.float32)[None, :]

    return _joined(msa.select("family", "seq_id"), _neighbours(msa, near), "left").select("family", "seq_id", (1 / (1 + F.coalesce("n", F.lit(0)))).alias("wt"))


def weights_by_mismatch(msa: DataFrame, share: float = 0.38) -> DataFrame:
    """The symmetric variant: neighbours differ in fewer than int(share * length) columns, gaps included."""

    def near(x, y):
        hit = int(x.shape[1] * share) > x.shape[1] - _equal(x, y)
        return hit, hit

    return _joined(msa.select("family", "seq_id"), _neighbours(msa, near), "left").select("family", "seq_id", (1 / (1 + F.coalesce("n", F.lit(0)))).alias("wt"))


def total_weight(wts: DataFrame) -> DataFrame:
    return wts.groupBy("family").agg(F.sum("wt").alias("meff"))


def column_freq(cells_: DataFrame, wts: DataFrame | None = None, pseudo: float = 1.0) -> DataFrame:
    """(pseudo + weight of the letter) / (21 pseudo + total weight) for each column and all 21 letters."""
    seen = cells_.groupBy("family", "pos", "aa").agg(F.count("*").cast("double").alias("w")) if wts is None else cells_.join(wts, ["family", "seq_id"]).groupBy("family", "pos", "aa").agg(F.sum("wt").alias("w"))
    return _freq(seen, pseudo)


def weighted_freq(msa: DataFrame, wts: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """column_freq(cells(msa), wts), without a row for each letter: each Arrow batch is summed as arrays before anything moves."""

    def each(batches):
        at = np.full(0x110000, -1, np.int64)
        at[[ord(c) for c in ALPHABET]] = np.arange(Q)
        for batch in batches:
            df = batch.to_pandas()
            for (family, length), part in df.groupby(["family", df["seq"].str.len()]):
                x, w = at[_letters(list(part["seq"]))], part["wt"].to_numpy(float)
                cell, known = np.where(x >= 0, x, 0) + np.arange(int(length)) * Q, (x >= 0) & ~np.isnan(w)[:, None]
                total, n = (np.bincount(cell.ravel(), weights=v.ravel(), minlength=int(length) * Q) for v in (np.where(known, w[:, None], 0), known))
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([family] * len(hit), pa.string()), pa.array((hit // Q + 1).astype(np.int32)), pa.array((hit % Q).astype(np.int32)), pa.array(total[hit])], ["family", "pos", "aa", "w"])

    rows = _joined(msa, wts).where("seq <> ''").select("family", "seq", "wt")
    return _freq(rows.mapInArrow(each, "family string, pos int, aa int, w double").groupBy("family", "pos", "aa").agg(F.sum("w").alias("w")), pseudo)


def _freq(seen: DataFrame, pseudo: float) -> DataFrame:
    """Frequencies from summed weights (family, pos, aa, w)."""
    per = seen.groupBy("family", "pos").agg(F.sum("w").alias("total"), F.map_from_entries(F.collect_list(F.struct("aa", "w"))).alias("m"))  # 21 entries at most
    out = per.select("family", "pos", "total", "m", F.explode(F.sequence(F.lit(0), F.lit(Q - 1))).alias("aa"))
    return out.select("family", "pos", "aa", ((pseudo + F.coalesce(F.try_element_at("m", F.col("aa")), F.lit(0.0))) / (Q * pseudo + F.col("total"))).alias("freq"))


def letter_counts(rows: DataFrame, length: int, alphabet: str) -> DataFrame:
    """family, pos, aa, w: counts of letters at each position of the pieces of ``length`` letters that texts (family, t) are cut into; the last piece is padded with the alphabet's last letter, which others count as, too. Each Arrow batch is counted as arrays before anything moves."""

    def each(batches):
        n = len(alphabet)
        at = np.full(0x110000, n - 1, np.int64)
        at[[ord(c) for c in alphabet]] = np.arange(n)
        place = np.arange(length) * n
        for batch in batches:
            family = batch.column("family").dictionary_encode(null_encoding="encode")
            texts = batch.column("t").to_pylist()
            pieces = [-(-len(t) // length) for t in texts]
            x = np.frombuffer("".join([t.ljust(k * length, alphabet[-1]) for t, k in zip(texts, pieces)]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
            cell = at[x] + place + np.repeat(family.indices.to_numpy(), pieces)[:, None] * (length * n)
            count = np.bincount(cell.ravel(), minlength=len(family.dictionary) * length * n)
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([family.dictionary.take(pa.array(hit // (length * n))), pa.array((hit // n % length + 1).astype(np.int32)), pa.array((hit % n).astype(np.int32)), pa.array(count[hit].astype(float))], ["family", "pos", "aa", "w"])

    part = rows.where("t is not null").select("family", "t").mapInArrow(each, "family string, pos int, aa int, w double")
    return part.groupBy("family", "pos", "aa").agg(F.sum("w").alias("w"))


def letter_freq(rows: DataFrame, length: int, alphabet: str = ALPHABET, pseudo: float = 1.0) -> DataFrame:
    """column_freq of the unweighted pieces of texts."""
    return _freq(letter_counts(rows, length, alphabet), pseudo)


def gap_freq(freq: DataFrame) -> DataFrame:
    return freq.where(F.col("aa") == Q - 1).select("family", "pos", F.col("freq").alias("gap"))


def letters_per_column(cells_: DataFrame) -> DataFrame:
    return cells_.groupBy("family", "pos").agg(F.sort_array(F.collect_set("aa")).alias("letters"))


def _pair_sums(seqs: DataFrame) -> DataFrame:
    """family, i, j, a, b, w: summed weights of letter pairs at positions i < j of rows (family, seq, wt). Each Arrow batch is counted as arrays before anything moves."""

    def each(batches):
        at = np.full(0x110000, -1, np.int64)
        at[[ord(c) for c in ALPHABET]] = np.arange(Q)
        for batch in batches:
            df = batch.to_pandas()
            for family, part in df.groupby("family"):
                x, w = at[_letters(list(part["seq"]))], part["wt"].to_numpy(float)
                cols = {k: [] for k in ("i", "j", "a", "b", "w")}
                for i in range(x.shape[1]):
                    for j in range(i + 1, x.shape[1]):
                        ok = (x[:, i] >= 0) & (x[:, j] >= 0)
                        cell = x[ok, i] * Q + x[ok, j]
                        n, total = np.bincount(cell, minlength=Q * Q), np.bincount(cell, weights=w[ok], minlength=Q * Q)
                        hit = np.flatnonzero(n)
                        for k, v in (("i", np.full(len(hit), i + 1)), ("j", np.full(len(hit), j + 1)), ("a", hit // Q), ("b", hit % Q), ("w", total[hit])):
                            cols[k].append(v)
                cols = {k: np.concatenate(v) if v else np.zeros(0) for k, v in cols.items()}
                yield pa.RecordBatch.from_arrays([pa.array([family] * len(cols["i"]), pa.string()), *[pa.array(cols[k].astype(np.int32)) for k in "ijab"], pa.array(cols["w"].astype(float))], ["family", *"ijab", "w"])

    return seqs.select("family", "seq", "wt").mapInArrow(each, "family string, i int, j int, a int, b int, w double").groupBy("family", "i", "j", "a", "b").agg(F.sum("w").alias("w"))


def pair_freq(msa: DataFrame, wts: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """Weighted frequencies of letter pairs at positions i < j; pairs that are seen."""
    seen = _pair_sums(_joined(msa, wts))
    return seen.join(total_weight(wts), "family").select("family", "i", "j", "a", "b", ((pseudo / Q + F.col("w")) / (Q * pseudo + F.col("meff"))).alias("freq"))


#: Numbers that a task sums up before it passes them on; a longer family's sums are passed on for each Arrow batch.
HELD = 24_000_000
#: What is summed for a pair of positions: 21 x 21 letter pairs, the letters of either, and all sequences.
WIDTH = Q * Q + 2 * Q + 1


def _position_sums(seqs: DataFrame) -> DataFrame:
    """family, i, j, v: for positions i <= j the WIDTH summed weights of rows (family, seq, wt), a row for each task's share."""

    def out(family, i, sums, letters, total):
        """Rows of position i with all from i on."""
        n = len(sums)
        v = np.concatenate([sums.reshape(n, Q * Q), np.broadcast_to(letters[i], (n, Q)), letters[i:], np.full((n, 1), total)], 1)
        at = pa.array(np.arange(0, (n + 1) * WIDTH, WIDTH, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array([family] * n, pa.string()), pa.array(np.full(n, i + 1, np.int32)), pa.array(np.arange(i + 1, i + 1 + n, dtype=np.int32)), pa.ListArray.from_arrays(at, pa.array(v.ravel()))], ["family", "i", "j", "v"])

    def flush(held):
        for family, (parts, letters, total) in held.items():
            for i, sums in enumerate(parts):
                yield out(family, i, sums, letters, total)
        held.clear()

    def each(batches):
        code = np.full(0x110000, -1, np.int64)
        code[[ord(c) for c in ALPHABET]] = np.arange(Q)
        held, size = {}, 0
        for batch in batches:
            for family, part in batch.to_pandas().groupby("family"):
                x, w = code[_letters(list(part["seq"]))], part["wt"].to_numpy(float)
                length, known = x.shape[1], x >= 0
                x = np.where(known, x, 0)
                letters = np.bincount((x + np.arange(length) * Q).ravel(), weights=(w[:, None] * known).ravel(), minlength=length * Q).reshape(length, Q)
                few = length * (length + 1) // 2 * Q * Q <= HELD
                if few and family not in held:
                    size += length * (length + 1) // 2 * Q * Q
                    if size > HELD:
                        yield from flush(held)
                        size = length * (length + 1) // 2 * Q * Q
                    held[family] = [[np.zeros((length - i, Q * Q)) for i in range(length)], np.zeros((length, Q)), 0.0]
                for i in range(length):
                    rest = length - i
                    sums = np.bincount((x[:, i, None] * Q + x[:, i:] + np.arange(rest) * (Q * Q)).ravel(), weights=(w[:, None] * (known[:, i, None] & known[:, i:])).ravel(), minlength=rest * Q * Q).reshape(rest, Q * Q)
                    if few:
                        held[family][0][i] += sums
                    else:
                        yield out(family, i, sums, letters, w.sum())
                if few:
                    held[family][1] += letters
                    held[family][2] += w.sum()
        yield from flush(held)

    return seqs.select("family", "seq", "wt").mapInArrow(each, "family string, i int, j int, v array<double>")


def covariance_blocks(msa: DataFrame, wts: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """family, i, j, cov: for positions i <= j their 21 x 21 covariances pab - pa pb, row by row, as one array; pairs that are never seen have the pseudo count alone; blocks i = j hold pa - pa pa on their diagonal and 0 beside it.

    Sequences of a family are equally long. Each task sums what it reads; the shares of a pair of positions meet sorted and are added as they stream by, so no task holds more than a batch of them. A position without a letter of the alphabet has no rows."""
    share = _position_sums(_joined(msa, wts))
    tasks = int(msa.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cov(keys, v):
        n = len(v)
        pair, fa, fb, total = v[:, : Q * Q].reshape(n, Q, Q), v[:, Q * Q : Q * Q + Q], v[:, Q * Q + Q : -1], v[:, -1]
        seen = (fa.sum(1) > 0) & (fb.sum(1) > 0)
        fa, fb = ((pseudo + f) / (Q * pseudo + f.sum(1, keepdims=True)) for f in (fa, fb))
        c = (pseudo / Q + pair) / (Q * pseudo + total)[:, None, None] - fa[:, :, None] * fb[:, None, :]
        same = np.array([i == j for _, i, j in keys], bool)
        c[same] = (fa[same] - fa[same] ** 2)[:, :, None] * np.eye(Q)
        keys, c = [k for k, s in zip(keys, seen) if s], c[seen].reshape(-1)
        at = pa.array(np.arange(0, len(c) + 1, Q * Q, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.ListArray.from_arrays(at, pa.array(c))], ["family", "i", "j", "cov"])

    def added(batches):
        key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("family").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist()))
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            first = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            sums, keys = np.add.reduceat(v, first, 0), [keys[k] for k in first]
            if key == keys[0]:
                sums[0] += last
            elif key is not None:
                yield cov([key], last[None])
            if len(keys) > 1:
                yield cov(keys[:-1], sums[:-1])
            key, last = keys[-1], sums[-1].copy()
        if key is not None:
            yield cov([key], last[None])

    return share.repartition(tasks, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(added, "family string, i int, j int, cov array<double>")


def full_covariance(msa: DataFrame, wts: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """The cells of covariance_blocks: family, i, j, a, b, cov and times (how often the entry stands in the symmetric matrix)."""
    tall = covariance_blocks(msa, wts, pseudo).select("family", "i", "j", F.posexplode("cov").alias("k", "cov"))
    return tall.select("family", "i", "j", F.expr(f"k div {Q}").cast("int").alias("a"), (F.col("k") % Q).alias("b"), "cov", F.when(F.col("i") == F.col("j"), 1).otherwise(2).alias("times"))


def pair_matrix(msa: DataFrame, wts: DataFrame, odds: bool = True, pseudo: float = 1.0) -> DataFrame:
    """family, i, j, a, b, v for all positions i <= j and all 21 x 21 letters, seen or not: log odds ln pab - ln pa - ln pb, or covariances pab - pa pb. Blocks i = j are counted like others: a letter stands beside itself only."""
    freq, total = weighted_freq(msa, wts, pseudo), total_weight(wts)
    a = freq.select("family", F.col("pos").alias("i"), F.col("aa").alias("a"), F.col("freq").alias("fa"))
    b = freq.select("family", F.col("pos").alias("j"), F.col("aa").alias("b"), F.col("freq").alias("fb"))
    every = a.join(b, "family").where("i <= j").join(total, "family").join(_pair_sums(_joined(msa, wts)), ["family", "i", "j", "a", "b"], "left")
    whole = Q * pseudo + F.col("meff")
    own = F.when(F.col("a") == F.col("b"), F.col("fa") * whole - pseudo).otherwise(0.0)
    pair = (pseudo / Q + F.when(F.col("i") == F.col("j"), own).otherwise(F.coalesce("w", F.lit(0.0)))) / whole
    v = F.ln(pair) - F.ln("fa") - F.ln("fb") if odds else pair - F.col("fa") * F.col("fb")
    return every.select("family", "i", "j", "a", "b", v.alias("v"))


def weighted_covariance(rows: DataFrame, keys: list[str], columns: list[str], weight: str) -> DataFrame:
    """keys, x, y, cov: covariances of columns with reliability weights, sum w (x - mx)(y - my) / (W - sum w^2 / W)."""
    means = rows.groupBy(*keys).agg(F.sum(weight).alias("sum_w"), F.sum(F.col(weight) * F.col(weight)).alias("sum_ww"), *[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(f"m_{c}") for c in columns])
    pairs = [(x, y) for k, x in enumerate(columns) for y in columns[k:]]
    both = rows.join(means, keys).groupBy(*keys).agg(*[(F.sum(F.col(weight) * (F.col(x) - F.col(f"m_{x}")) * (F.col(y) - F.col(f"m_{y}"))) / (F.first("sum_w") - F.first("sum_ww") / F.first("sum_w"))).alias(f"{x}|{y}") for x, y in pairs])
    return both.unpivot(keys, [f"{x}|{y}" for x, y in pairs], "xy", "cov").select(*keys, F.split("xy", r"\|")[0].alias("x"), F.split("xy", r"\|")[1].alias("y"), "cov")


def covariance(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    a = freq.select("family", F.col("pos").alias("i"), F.col("aa").alias("a"), F.col("freq").alias("fa"))
    b = freq.select("family", F.col("pos").alias("j"), F.col("aa").alias("b"), F.col("freq").alias("fb"))
    return pairs.join(a, ["family", "i", "a"]).join(b, ["family", "j", "b"]).select("family", "i", "j", "a", "b", (F.col("freq") - F.col("fa") * F.col("fb")).alias("cov"))


def log_odds(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    a = freq.select("family", F.col("pos").alias("i"), F.col("aa").alias("a"), F.col("freq").alias("fa"))
    b = freq.select("family", F.col("pos").alias("j"), F.col("aa").alias("b"), F.col("freq").alias("fb"))
    return pairs.join(a, ["family", "i", "a"]).join(b, ["family", "j", "b"]).select("family", "i", "j", "a", "b", (F.ln("freq") - F.ln("fa") - F.ln("fb")).alias("mi"))


def filter_gaps(msa: DataFrame, most: float = 0.45, best: float = 0.95) -> DataFrame:
    """Sequences with a gap fraction (rounded to 3) below ``most``, and in any case the best ``best`` of the family; with gap."""
    gap = F.bround(gap_fraction(normalize(F.col("seq"))), 3)
    w = Window.partitionBy("family")
    ranked = msa.withColumn("gap", gap).withColumn("rank", F.row_number().over(w.orderBy("gap", "seq_id")) - 1).withColumn("n", F.count("*").over(w))
    return ranked.where((F.col("gap") < most) | (F.col("rank") / F.col("n") < best)).drop("rank", "n")


def similar_to(msa: DataFrame, target: DataFrame, share: float = 0.7) -> DataFrame:
    """Sequences that agree with the family's target (family, target) in more than ``share`` of all columns."""
    return msa.join(target, "family").where(matches(F.col("seq"), F.col("target")) / F.length("seq") > share).drop("target")

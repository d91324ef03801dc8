"""Scalar functions over aligned sequences, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet (gap last), structure classes, side-chain atoms.
ALPHABET = "ARNDCQEGHILKMFPSTWYV-"
SS8_TO_SS3 = {"H": "H", "G": "H", "I": "H", "E": "E", "B": "E", "T": "C", "S": "C", "L": "C"}
#: Three-letter codes; distances of N and O, and of CA and CG, in one residue ('X': any other).
CODES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
NO_DIST = {"A": 3.302093, "C": 3.1867874, "D": 3.2847655, "E": 3.3253117, "F": 3.2107856, "G": 3.2121522, "H": 3.2300916, "I": 3.174216, "K": 3.2851896, "L": 3.2752273, "M": 3.2734911, "N": 3.2947414, "P": 3.1523004, "Q": 3.3115633, "R": 3.267973, "S": 3.2022767, "T": 3.1898365, "V": 3.1252666, "W": 3.1940844, "X": 3.06, "Y": 3.1847978}
CACG_DIST = {"A": 1.5232254, "C": 2.8013322, "D": 2.5434172, "E": 2.562029, "F": 2.5461287, "G": 0.0, "H": 2.5359476, "I": 2.529928, "K": 2.564922, "L": 2.6051538, "M": 2.559007, "N": 2.539332, "P": 2.3897746, "Q": 2.5625532, "R": 2.5622983, "S": 2.4277365, "T": 2.5252295, "V": 2.527417, "W": 2.543401, "X": 2.2, "Y": 2.552031}
CG_ATOM = {"V": "CG1", "I": "CG1", "T": "CG2", "S": "OG", "C": "SG", "A": "CB", "G": "CA"}


def normalize(seq: Column) -> Column:
    return F.translate(seq, "BZXU", "NE-C")


def mask_unknown(seq: Column) -> Column:
    return F.regexp_replace(seq, f"[^{ALPHABET}]", "-")


def letter_index(letter: Column, alphabet: str = ALPHABET) -> Column:
    """0-based index, null for a letter outside the alphabet."""
    at = F.instr(F.lit(alphabet), letter)
    return F.when(at > 0, at - 1)


def one_hot(index: Column, size: int = len(ALPHABET)) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda x: (x == index).cast("int"))


def ungapped_length(seq: Column) -> Column:
    return F.length(F.replace(seq, F.lit("-"), F.lit("")))


def gap_fraction(seq: Column) -> Column:
    return (F.length(seq) - ungapped_length(seq)) / F.length(seq)


def his_tag(seq: Column) -> Column:
    """Per position 1 if it belongs to a run HHH... that starts within the first 10 or ends within the last 10 letters."""
    head = F.regexp_extract(seq, "^(.{0,9}?HHH+)", 1)
    tail = F.regexp_extract(seq, "(HHH+.{0,9}?)$", 1)
    n, h, t = F.length(seq), F.length(head), F.length(tail)
    return F.transform(F.sequence(F.lit(1), n), lambda i: ((i <= h) | (i > n - t)).cast("int"))


def ss3(ss8: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SS8_TO_SS3.items() for x in kv])[ss8], F.lit("C"))


def lookup(values: dict, key: Column) -> Column:
    """The value of a key; that of 'X', where there is one, for any other key but null."""
    found = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]
    return F.when(key.isNotNull(), F.coalesce(found, F.lit(values["X"]))) if "X" in values else found


def three_to_one(code: Column) -> Column:
    """Null for a residue outside the 20."""
    return lookup(CODES, F.upper(code))


def one_to_three(letter: Column) -> Column:
    return lookup({v: k for k, v in CODES.items()}, letter)


def three_letter_order(letter: Column) -> Column:
    """0-based place of a letter when residues are in the order of their three-letter codes; null outside the 20."""
    return letter_index(letter, "".join(CODES[k] for k in sorted(CODES)))


def percent_acc(acc: Column) -> Column:
    """Relative accessibility 0 to 1 in percent, 45 where it is missing."""
    return F.coalesce(acc * 100, F.lit(45.0))


def acc_class(pacc: Column) -> Column:
    """0 buried, 1 between, 2 exposed, from the accessibility in percent."""
    return F.when(pacc <= 10, 0).when(pacc <= 43, 1).otherwise(2)


def cluster_name(header: Column) -> Column:
    """seq-<digits> of a header line; null without."""
    return F.nullif(F.regexp_extract(header, r"(seq-\d+)", 1), F.lit(""))


def cb_atom(residue: Column) -> Column:
    return F.when(residue == "G", "CA").otherwise("CB")


def cg_atom(residue: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CG_ATOM.items() for x in kv])[residue], F.lit("CG"))


def pair_atoms(pair: str, ri: Column, rj: Column) -> tuple[Column, Column]:
    """Names of the two atoms of a pair such as CbCb, NO or CaCg in residues ri and rj."""
    of = {"Cb": cb_atom, "Cg": cg_atom, "Ca": lambda r: F.lit("CA"), "N": lambda r: F.lit("N"), "O": lambda r: F.lit("O")}
    cut = 2 if len(pair) == 4 else 1
    return of[pair[:cut]](ri), of[pair[cut:]](rj)


def orientation_atoms(label: str, ri: Column, rj: Column, last_i: Column, last_j: Column) -> Column:
    """Names of the atoms of an orientation, null where residues or sequence ends don't allow it."""
    gly_i, gly_j = ri == "G", rj == "G"
    names = lambda *a: F.array(*[F.lit(x) if isinstance(x, str) else x for x in a])
    return {
        "Ca1Cb1Cb2Ca2": F.when(~gly_i & ~gly_j, names("CA", "CB", "CB", "CA")),
        "N1Ca1Cb1Cb2": F.when(~gly_i, names("N", "CA", "CB", cb_atom(rj))),
        "Ca1Cb1Cb2": F.when(~gly_i, names("CA", "CB", cb_atom(rj))),
        "Ca1Ca2Ca3Ca4": F.when(~last_i & ~last_j, names("CA", "CA", "CA", "CA")),
        "Ca1Ca2Ca4Ca3": F.when(~last_i & ~last_j, names("CA", "CA", "CA", "CA")),
        "Ca1Ca2Ca3": F.when(~last_i, names("CA", "CA", "CA")),
        "Ca1Ca2Ca4": F.when(~last_i, names("CA", "CA", "CA")),
    }[label]


def mismatches(a: Column, b: Column) -> Column:
    """Number of positions where both have a letter other than '-' and 'X', and these differ."""
    bad = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ((x != y) & ~x.isin("-", "X") & ~y.isin("-", "X")).cast("int"))
    return F.aggregate(bad, F.lit(0), lambda s, x: s + x)


def alignment_map(a: Column, b: Column) -> Column:
    """For each letter of aligned a: the 0-based index of b's letter at its column, -1 where b has a gap."""
    steps = F.transform(F.split(b, ""), lambda x: (x != "-").cast("int"))
    at = F.transform(steps, lambda x, i: F.when(x == 1, F.aggregate(F.slice(steps, 1, i + 1), F.lit(0), lambda s, y: s + y) - 1).otherwise(-1))
    both = F.arrays_zip(F.split(a, "").alias("x"), at.alias("m"))
    return F.transform(F.filter(both, lambda v: v.getField("x") != "-"), lambda v: v.getField("m"))


def max_sep(value: Column, length: Column) -> Column:
    """A band's largest separation: the sequence's length where there is none."""
    return F.coalesce(value, length)


def matches(a: Column, b: Column, skip: str = "") -> Column:
    """Number of equal letters at equal positions, those in ``skip`` not counted."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ((x == y) & ~x.isin(*skip) if skip else x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def band(i: Column, j: Column, low: int, high: int | None) -> Column:
    """Separation low to high, both included."""
    inside = j - i >= low
    return inside if high is None else inside & (j - i <= high)


def native_contact(dist: Column, valid: Column, most: float = 8.0) -> Column:
    return (dist <= most) & valid


def target_of(name: Column) -> Column:
    return F.replace(F.substring_index(name, "_", 1), F.lit(".npy"), F.lit(""))


def renamed(name: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[name], name) if names else name

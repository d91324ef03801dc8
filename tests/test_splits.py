"""Files that are cut into many splits give what a plain read of the whole file gives."""

import random
import re

import pytest

from seqnet.sources import readers, splits


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in names}
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "16")
    spark.conf.set(names[2], "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def sequence(rng, most):
    return "".join(rng.choice("ARNDCQEGHILKMFPSTWYV-") for _ in range(rng.randint(1, most)))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Wrapped FASTA files of several kinds of line ends, some with text before the first header, blank lines, > in headers, no end of line at the end."""
    rng, root = random.Random(8), tmp_path_factory.mktemp("fasta")
    for i, end in enumerate(["\n", "\r\n", "\n", "\n"]):
        out = ["stray text"] if i == 2 else []
        for k in range(60 if i < 3 else 1):
            out.append(f">seq-{k % 25} of > {i}")
            seq = sequence(rng, 90)
            out += [seq[j : j + 30] for j in range(0, len(seq), 30)] + [""] * rng.randint(0, 2)
        out += [">empty"] if i == 1 else []
        (root / f"f{i}.fasta").write_bytes((end.join(out) + (end if i % 2 else "")).encode())
    return root


def plain_records(path):
    text = path.read_bytes().decode().replace("\r\n", "\n")
    out = []
    for part in re.split(r"(?m)^>", text)[1:]:
        head, *body = part.split("\n")
        out.append((head.strip(), body))
    return out


def test_fasta_in_splits(tiny_splits, files):
    got = readers.fasta(tiny_splits, str(files))
    assert got.rdd.getNumPartitions() > 1
    assert tiny_splits.read.text(str(files)).rdd.getNumPartitions() > 60
    want = []
    for p in sorted(files.iterdir()):
        found = [(h, "".join("".join(b).split())) for h, b in plain_records(p)]
        want += [(p.name, i, h, s) for i, (h, s) in enumerate([x for x in found if x[1]])]
    assert sorted(map(tuple, got.select("file", "seq_id", "name", "seq").collect())) == sorted(want)


def test_lines_in_splits(tiny_splits, files):
    want, first, named, depth = [], {}, {}, {}
    for p in sorted(files.iterdir()):
        lines = p.read_bytes().decode().replace("\r\n", "\n").split("\n")
        own = [(p.name, i, v.strip()) for i, v in enumerate(lines) if v.strip() and not v.startswith(">")]
        want += own
        first[p.name] = own[0][2]
        depth[p.name] = sum(v.startswith(">") for v in lines)
        for head, body in plain_records(p):
            body = [b.strip() for b in body if b.strip()]
            if body and head.startswith("seq-"):
                named[p.name, head.split()[0]] = body[-1]
    assert sorted(map(tuple, readers.alignment_lines(tiny_splits, str(files)).select("file", "line_no", "seq").collect())) == sorted(want)
    assert {r.file: r.seq for r in readers.first_sequence(tiny_splits, str(files)).collect()} == first
    assert {(r.file, r.name): r.seq for r in readers.named_sequences(tiny_splits, str(files)).collect()} == named
    assert {r.file: r.depth for r in readers.depth(tiny_splits, str(files)).collect()} == depth


def test_one_record_and_even_files(tiny_splits, files, tmp_path):
    assert readers.single_sequence(tiny_splits, str(files / "f3.fasta")).first().seq == "".join("".join(plain_records(files / "f3.fasta")[0][1]).split())
    with pytest.raises(Exception, match="more than one record"):
        readers.single_sequence(tiny_splits, str(files / "f0.fasta")).collect()
    rng = random.Random(1)
    even = [("".join(rng.choice("ARND-") for _ in range(40))) for _ in range(50)]
    (tmp_path / "x.a2m").write_text("\n".join(even) + "\n")
    assert [r.seq for r in readers.a2m(tiny_splits, str(tmp_path / "x.a2m")).orderBy("line_no").collect()] == even
    (tmp_path / "y.a2m").write_text("\n".join([*even, "A"]) + "\n")
    with pytest.raises(Exception, match="unequal length"):
        readers.a2m(tiny_splits, str(tmp_path / "y.a2m")).collect()


def test_cluster_listings_in_splits(tiny_splits, tmp_path):
    rng, want = random.Random(3), []
    for f in ("a.clstr", "b.clstr"):
        out, name = ["0\tstray >seq-1"], 0
        for c in range(30):
            out.append(f">Cluster {c}")
            for k in range(rng.randint(0, 12)):
                name += 1
                out.append(f"{k}\t100aa, >seq-{name}... at 90%")
                want.append((f, c, f"seq-{name}"))
        (tmp_path / f).write_text("\n".join(out))
    assert sorted(map(tuple, readers.cluster_file(tiny_splits, str(tmp_path)).collect())) == sorted(want)


def test_matrices_in_splits(tiny_splits, tmp_path):
    rng, want = random.Random(5), []
    for f, after in (("a.txt", "\n\n7 7\n"), ("b.txt", "\n"), ("c.txt", "")):
        m = [[round(rng.gauss(0, 1), 4) for _ in range(9)] for _ in range(25)]
        want += [(f, r, c, v) for r, row in enumerate(m) for c, v in enumerate(row)]
        (tmp_path / f).write_text("head 1 2\n\n the covariance matrix:\n" + ("\n" if f == "b.txt" else "") + "\n".join(" ".join(map(str, row)) for row in m) + after)
    (tmp_path / "none.txt").write_text("no such thing\n1 2\n")
    assert sorted(map(tuple, readers.named_matrix(tiny_splits, str(tmp_path), "covariance matrix").collect())) == sorted(want)


def test_numbers_over_splits(tiny_splits, tmp_path):
    (tmp_path / "n.txt").write_text("\n".join(str(i) for i in range(700)))
    (tmp_path / "empty.txt").write_text("")
    got = splits.numbered(splits.lines(tiny_splits, str(tmp_path)), "no").select("no", "value").collect()
    assert sorted(r.no for r in got) == list(range(700)) and all(r.no == int(r.value) for r in got)

import random

from strandmill import archive
from strandmill.__main__ import main
from strandmill.operators import index
from strandmill.sources import fasta, fastq


def make(tmp_path, n=120):
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(1500))
    lines = [">one ACGT"] + [text[i : i + 70].lower() if i % 140 else text[i : i + 70] for i in range(0, 700, 70)] + [">two"] + [text[i : i + 60] for i in range(700, 1500, 60)]
    (tmp_path / "ref.fa").write_text("\n".join(lines) + "\n")
    out = []
    for i in range(n):
        a, k = rng.randrange(1300), rng.randint(1, 100)
        s = list(text[a : a + k])
        if i % 3 == 0:
            s[rng.randrange(k)] = "N"
        if i % 4 == 0:
            s = list("".join(s)[::-1].translate(str.maketrans("ACGT", "TGCA")))
        out.append(f"@r.{i} {'AB'[i % 2]}:{rng.randrange(999)}\n{''.join(s)}\n{'+-'[i % 2]}{f'r.{i}' if i % 5 == 0 else ''}\n{''.join(rng.choice('HHHG@') for _ in range(k))}\n")
    return text, out


def test_command_line(spark, tmp_path):
    text, records = make(tmp_path)
    records = [r.replace("+r.", "+X").replace("-r.", "-X") for r in records]
    # The header stands behind the strand of every fifth read.
    records = [r if "X" not in r else r.replace("+X" + str(i), "+" + r.split("\n")[0][1:]).replace("-X" + str(i), "-" + r.split("\n")[0][1:]) for i, r in enumerate(records)]
    (tmp_path / "reads.fastq").write_text("".join(records))
    p = lambda name: str(tmp_path / name)
    assert main(["index", p("ref.fa"), p("idx")], spark) == 0
    tables = fasta.load_index(spark, p("idx"))
    assert tables["ref"].first().ref == text
    assert [r.pos for r in tables["sa"].orderBy("row").collect()] == index.FmIndex(text).sa.tolist()
    assert main(["compress", p("reads.fastq"), p("idx"), p("arc")], spark) == 0
    assert main(["decompress", p("arc"), p("idx"), p("out")], spark) == 0
    assert "".join(x.read_text() for x in sorted((tmp_path / "out").glob("part-*"))) == "".join(records)
    assert main([], spark) == 2 and main(["compress", "x"], spark) == 2


def test_headers_of_different_shapes(spark, tmp_path):
    ref = spark.createDataFrame([("ACGTTGCAACCATGGTCAGT" * 5 + "AATTCCGGAGATCTCTGACA",)], "ref string")
    rows = [(i, f"@a{'.' * (i % 2)}{i}", "ACGTTGCA", "+", False, "H" * 8) for i in range(20)] + [(20, "@", "", "+", False, ""), (22, "@a.22", "ACG", "+", False, None), (30, "@a.30", "ACG", "+", False, "HHH"), (21, "@x", "NNN", "-", True, "!!!")]
    reads = spark.createDataFrame(rows, "read_id long, meta string, seq string, strand string, repeated boolean, qual string")
    archive.compress(reads, ref, str(tmp_path / "arc"))
    got = archive.decompress(spark, str(tmp_path / "arc"), ref).orderBy("read_id").collect()
    assert [tuple(r) for r in got] == sorted(rows)


def test_lines_by_splits(tmp_path):
    import io

    data = b">a\nACGT\n\nTT\r\nG"
    for size in (1, 2, 3, 5, 100):
        found = [x for a in range(0, len(data), size) for x in fasta.split_lines(io.BytesIO(data), a, min(a + size, len(data)))]
        assert found == [(0, ">a"), (3, "ACGT"), (8, ""), (9, "TT"), (13, "G")]
    assert fastq.SCHEMA

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandmill.llm import tokens
from strandmill.llm.orc_tokens import digests, scan, write
from strandmill.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string, lang string, part string, ids int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_librarys_ids(library):
    enc = Encoder(default_path(), entries=50)
    rng = random.Random(5)
    texts = ["", " ", "\n", "a  b", "a \n b", " lead", "trail ", "x\n\ny", "a\t b c", "foo \n \n bar", "a<|endoftext|> b <|endoftext|>", "don't we'll 's  it's", "  \n a", "é  b, ç. Ünï!", "a\x1c b", "a\r\nb c", " \na b\n c", "1st 2,5 a1b", "日本 語。 ok", "ǅ ⁇ ", "a b   c", "x?! y.. z,", "½ 2² a²", "a—b c", "×÷ a", "I'll we're 's", "a\x85b\xa0c d"]
    letters = ["a", "B", "é", " ", " ", " ", "\n", "\t", ".", ",", "'s", "1", " ", "<|endoftext|>", "中", " ", "'"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for t in texts:
        assert enc.ids(t).tolist() == plain(library, t), repr(t)
    flat, counts = enc.batch([None, *texts])
    assert counts.tolist() == [0] + [len(plain(library, t)) for t in texts]
    assert flat.tolist() == [i for t in texts for i in plain(library, t)]


def test_table_forgets_and_blocks_change_nothing(library, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefé'") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 900))) + rng.choice(["", " 中 x", "\n\n  "]) for _ in range(40)] + ["y" * 3000, "日本 " * 900]
    monkeypatch.setattr(tokens, "BLOCK", 1000)
    enc = Encoder(default_path(), entries=300)
    for _ in range(2):
        for t in texts:
            assert enc.ids(t).tolist() == plain(library, t)
    assert enc.table.count < 2000


def test_cuts_that_share_a_hash_keep_their_own_ids(library, monkeypatch):
    monkeypatch.setattr(tokens, "_BASE", 1)  # words of the same letters now share one
    texts = ["listen silent enlist tinsel inlets", "god dog", "silent listen", "odg gdo dgo god"]
    enc = Encoder(default_path())
    for _ in range(2):
        for t in texts:
            assert enc.ids(t).tolist() == plain(library, t)


def test_without_a_byte_between_cuts(library):
    enc = Encoder(default_path())
    assert enc.edge is not None
    enc.edge = None
    assert enc.ids("one two, thrée 4's").tolist() == plain(library, "one two, thrée 4's")


def test_round_trip_and_order(spark, tmp_path, library):
    rng = random.Random(2)
    rows = [(i * 3 - 50, " ".join(rng.choice(["alpha", "beta,", "gamma.\n", "x"]) for _ in range(rng.randint(0, 80))), "en", "p", 1) for i in range(300)]
    rows += [(None, "no id", "en", None, None), (7777, None, None, None, None), (7778, "", "en", "p", 2), (100, "tie one", "en", "p", 1), (100, "tie one", "en", "p", 1), (9000, "long " * 40000, "en", "p", 1)]
    rng.shuffle(rows)
    out = str(tmp_path / "orc")
    write(spark.createDataFrame(rows, SCHEMA).repartition(7), out, default_path(), end_id=0, stride=1000)
    stored = scan(spark, out)
    got = stored.orderBy("part", "part_start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    text = {}
    for r in rows:
        text.setdefault(r[0], []).append(plain(library, r[1]) + [0])
    for r in got:
        assert list(r.ids) in text[r.doc_id]
    found = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in digests(stored).collect()}
    at = 0
    for r in got:
        assert found[r.doc_id, at] == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)
    assert len(found) == len(rows)


def test_lookup_reads_few_rows(spark, tmp_path):
    out = str(tmp_path / "orc")
    docs = spark.range(0, 40000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).coalesce(1)
    write(docs, out, default_path(), end_id=0, stride=1000)
    stored = scan(spark, out)
    assert stored.where("doc_id = 20002").count() == 1
    plan = stored.where("doc_id = 20002")._jdf.queryExecution().executedPlan()
    assert "EqualTo(doc_id,20002)" in plan.toString()
    missing = stored.where("doc_id = 20001").select("doc_id", "n_tokens")  # odd: inside the range, absent from the Bloom filters
    assert missing.count() == 0
    import glob

    from pyarrow import orc

    files = [orc.ORCFile(f) for f in glob.glob(f"{out}/*.orc")]
    assert sum(f.nrows for f in files) == 20000 and all(f.nstripes >= 1 for f in files if f.nrows)
    assert {f.row_index_stride for f in files} == {1000} and {f.compression for f in files} == {"ZSTD"}


def test_empty_table(spark, tmp_path):
    out = str(tmp_path / "orc")
    write(spark.createDataFrame([], SCHEMA), out, default_path())
    assert digests(scan(spark, out)).count() == 0


def test_query_on_the_small_tables(spark, library):
    from strandmill.llm.common import table
    from strandmill.llm.orc_tokens import op2_orc_tokens

    rows = sorted((r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect())
    found = {r.doc_id: tuple(r)[1:] for r in op2_orc_tokens(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(rows) == len({d for d, _ in rows})
    at = 0
    for doc_id, text in rows:
        ids = plain(library, text) + [0]
        assert found[doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_types_of_id_and_rows_of_one_id(spark, tmp_path, kind):
    docs = spark.createDataFrame([(7, "a b")] * 900 + [(7, "c")] * 2 + [(8, None)], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    out = str(tmp_path / "orc")
    write(docs.repartition(4), out, default_path(), end_id=0)
    rows = digests(scan(spark, out, "int" if kind == "int" else "string")).orderBy("start").collect()
    assert len(rows) == 903 and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:])) and {str(r.doc_id) for r in rows[:902]} == {"7"}

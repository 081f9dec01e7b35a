import hashlib
import random
from array import array

import pytest
import tiktoken

from strandmill.llm import prefix_bpe as P
from strandmill.llm.common import table

SCHEMA = "doc_id long, text string, ids int, bytes string, lang string"
LETTERS = [*"abcde' \n\t.,123", " ", " ", " ", "é", "中", "ß", "։", "࢏", "₏", "\U00011de1", "\U0001f600", "'s", "'re", "'l", "the", "ing", "\x1c", "\xa0", "　", "日本", "\x00", "ab" * 9]


@pytest.fixture(scope="module")
def bpe():
    return P.prefix_bpe(P.default_path(), P._pattern(None))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P._pattern(None), mergeable_ranks=P.read_ranks(P.default_path()), special_tokens={})


def some_text(rng, n=80):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, n)))


def test_ids_are_the_librarys(bpe, library, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 40)
    rng = random.Random(1)
    texts = ["", " ", "a", "'", "don't", "  x", "a \n\n b", "a　　b", "'" * 50, "x" * 500, " " * 500 + "y"] + [some_text(rng) for _ in range(4000)]
    flat, counts = bpe.batch([None, *texts])
    wanted = [library.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [0, *map(len, wanted)] and flat.tolist() == [i for w in wanted for i in w]
    for t, w in zip(texts, wanted):
        assert list(array("i", bpe._whole(t))) == w and bpe.decode(w) == t.encode()


def test_every_character_is_cut_as_the_library_does(bpe, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 60_000):
        text = "a 1".join(chr(c) for c in points[at : at + 60_000 : 3])
        assert list(array("i", bpe._whole(text))) == library.encode_ordinary(text)


def test_prefixes_have_their_own_encodings(bpe):
    ranks = P.read_ranks(P.default_path())
    rng = random.Random(2)
    for _ in range(60):
        data = some_text(rng, 30).encode()
        p = P.Prefixes(bpe.vocabulary, data)
        for n in range(len(data) + 1):
            assert p.ids(n) == [ranks[t] for t in P.merged(ranks, data[:n])[0]]


def test_appends_and_edits_of_bytes(bpe):
    rng = random.Random(3)
    p, data = P.Prefixes(bpe.vocabulary), b""
    for _ in range(100):
        more = some_text(rng, 9).encode()
        p.append(more)
        data += more
        assert p.last == P.Prefixes(bpe.vocabulary, data).last
    for _ in range(200):
        a = rng.randint(0, len(data))
        b, new = min(len(data), a + rng.randint(0, 5)), some_text(rng, 4).encode()
        p.replace(a, b, new)
        data = data[:a] + new + data[b:]
        assert p.last == P.Prefixes(bpe.vocabulary, data).last
    long = P.Prefixes(bpe.vocabulary, b"some words, and more " * 3000)
    assert long.replace(30_000, 30_003, b"xyzw") < 300
    with pytest.raises(ValueError):
        long.replace(3, 2, b"")


def test_edits_of_texts(bpe, library):
    rng = random.Random(4)
    for _ in range(150):
        text = some_text(rng, 120)
        d = P.Document(bpe.vocabulary, bpe.cutter, text)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.randint(0, 9)), some_text(rng, 6)
            d.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert d.text == text and d.ids() == library.encode_ordinary(text)
        d.append("ing 's")
        assert d.ids() == library.encode_ordinary(text + "ing 's")
    words = P.Document(bpe.vocabulary, bpe.cutter, "one two three " * 4000)
    assert words.replace(20_000, 20_002, "zz z") < 10 and words.append(" end") < 6


def test_vocabularies_that_do_not_hold(bpe):
    bytes_only = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        P.Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        P.Vocabulary(bytes_only | {b"abc": 256})
    small = P.Vocabulary(bytes_only | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259})
    ranks = {small.bytes[i]: i for i in range(small.size)}
    rng = random.Random(5)
    for _ in range(500):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20)))
        assert P.Prefixes(small, data).ids() == [ranks[t] for t in P.merged(ranks, data)[0]]


def test_long_matches_take_time_in_proportion(bpe):
    text = "中文字" * 40_000
    ids = array("i", bpe._whole(text)).tolist()
    assert bpe.decode(ids) == text.encode()
    piece = ids[: len(array("i", bpe._whole("中文字" * 400))) - 8]
    assert ids[: len(piece)] == piece


def test_rows(spark, bpe, library):
    rows = [(1, "Hello  wörld's\n end", 1, "b", "en"), (1, "other", 1, "b", "en"), (None, "no id", None, None, None), (2, None, 2, "b", None), (3, "", 3, "b", None), (4, "word " * 300_000, 4, "b", "en"), (5, "中" * 50_000, 5, "b", "zh")] + [(6, "same text", 1, "", "")] * 3
    found = P.digests(P.decoded(P.encoded(spark.createDataFrame(rows, SCHEMA).repartition(3), P.default_path()), P.default_path())).collect()
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    ids = {r[1]: library.encode_ordinary(r[1] or "") for r in rows}
    wanted = [(r[0], len(ids[r[1]]), hexed(",".join(map(str, ids[r[1]])).encode()), hexed((r[1] or "").encode())) for r in rows]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert P.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), P.default_path()).select("bytes").collect() == [(None,), (bytearray(),)]
    assert P.digests(P.decoded(P.encoded(spark.createDataFrame([], SCHEMA), P.default_path()), P.default_path())).count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_types_of_id(spark, kind):
    docs = spark.createDataFrame([(7, "a b")], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    assert str(P.encoded(docs, P.default_path()).first().doc_id) == "7"


def test_query_on_the_small_tables(spark, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    found = P.op11_prefix_bpe(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids, text = library.encode_ordinary(texts[r.doc_id]), texts[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()

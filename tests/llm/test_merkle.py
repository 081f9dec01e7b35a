import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from strandmill.llm import merkle as M
from strandmill.llm.oracles import OP13_MERKLE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, position int, block string, all int"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """(root, path of each leaf), level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = at[i] // 16 * 16
            path.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + 16])))
            at[i] //= 16
        nodes = [digest(nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_leaf(doc_id, text, lang, source, n_chars):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest(values)


def plain(rows):
    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if text is not None and hit else text
        sources[source].append((doc_id is not None, doc_id, plain_leaf(doc_id, text, lang, source, n_chars), plain_leaf(doc_id, low, lang, source, n_chars)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    within = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        within[s] = plain_tree([r[2] for r in sources[s]])
    root, over = plain_tree([within[s][0] for s in names])
    out = []
    for s, up in zip(names, over):
        for (_, doc_id, leaf, tampered), path in zip(sources[s], within[s][1]):
            node = tampered
            for left, right in path + up:
                node = digest([left, node, right])
            out.append((doc_id, leaf, within[s][0], root, digest(a + b for a, b in path + up), node, node == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 289, 512, 513, 1000, 4095, 4096])
def test_traversal_gives_every_path_in_little_memory(n):
    nodes = [digest([str(i)]) for i in range(n)]
    root, paths = plain_tree(nodes)
    levels = M.height(n)
    for more in {levels, 3}:
        t, most, seen = M.Traversal(nodes, more), 0, []
        for path in t.paths():
            seen.append(path)
            most = max(most, t.held())
        assert most <= 16 * 2 * more + 16 * more * more
        if more == levels:
            assert t.root == root and seen == paths
        assert all(M.folded(x, p) == t.root for x, p in zip(nodes, seen))


def test_treehash_of_any_number_of_leaves():
    for n in (1, 5, 16, 17, 300):
        nodes = [digest([str(i)]) for i in range(n)]
        h = M.Treehash(3)
        for x in nodes:
            h.push(x)
            assert all(len(level) < 16 for level in h.open)
        for _ in range(3):
            nodes = [digest(nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        assert h.finish() == nodes[0]


def some_rows(seed=1, n=900):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÄÖ", "ß", "x:y", "-", "\n", "中", "1:"]
    rows = [(rng.randint(-50, 5000), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), rng.choice(["en", None]), rng.choice(["hot"] * 8 + ["a", "B", None, "", "é"]), rng.choice([None, 3, 10**12])) for _ in range(n)]
    rows += [(None, None, None, None, None), (None, None, None, "only", None), (7, None, "en", "a", 1), (10, "A" * 300_000, "en", "a", 1)]
    return rows + [(4, "Same row", "en", "hot", 8)] * 40 + [(4, "Other row", "en", "hot", 8)] * 2


def spread(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "e", 1, "e", 2) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_against_plain_python(spark, seed):
    rows = some_rows(seed)
    found = M.manifest(spread(spark, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, found)) == Counter(plain(rows))
    assert any(not r.verified for r in found) and sum(r.verified for r in found) > 0.7 * len(found)


def test_several_blocks_and_rounds(spark):
    """Blocks of 16 leaves make several rounds of blocks; results stay those of the definition."""
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i % 400}", i) for i in range(1200)]
    found = M.manifest(spread(spark, rows), levels=1).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, found)) == Counter(plain(rows))


def test_one_row_and_no_rows(spark):
    assert M.manifest(spread(spark, [])).count() == 0
    r = M.manifest(spread(spark, [(3, "x", "en", "s", 1)], 1)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == plain_leaf(3, "x", "en", "s", 1) and r.proof_sha256 == digest([]) and r.verified


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_types_of_id(spark, kind):
    docs = spread(spark, some_rows(3, 40)).selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "lang", "source", "n_chars")
    assert M.manifest(docs).count() == docs.count()


def test_query_and_sql_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    asked = c.sql(OP13_MERKLE)
    found = M.op13_merkle(spark, sf)
    assert sorted(found.columns) == sorted(asked.columns)
    assert Counter(map(tuple, found.select(*asked.columns).collect())) == Counter(asked.fetchall())

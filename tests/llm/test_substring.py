import random
import re
from collections import defaultdict

import numpy as np
import pytest

from strandmill.llm import substring
from strandmill.llm.substring import BASE, LONGEST, REACH, clean_documents, cleaned, dedup, op6_substring, pieces, words

SCHEMA = "doc_id long, text string, lang string, first string, h1 int, n_chars long"
LETTERS = "".join(f"{chr(a)}-{chr(b)}" for a, b in substring.UNSPACED)
TOKEN = re.compile(f"[{LETTERS}]?[^ \t-\r{LETTERS}]+|[{LETTERS}]")
END = re.compile("([.!?。！？｡]|[。！？｡][」』”’）])$")


def rank(word):
    h = 0
    for c in word:
        h = (h * BASE + ord(c)) % 2**64
    return h


def plain(text):
    """(words, text) of each piece, by loops."""
    found = list(TOKEN.finditer(text))
    sentences, now = [], []
    for i, m in enumerate(found):
        now.append(i)
        behind = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
        if END.search(m[0]) or "\n" in behind:
            sentences.append(now)
            now = []
    sentences += [now] if now else []
    cut = []
    for s in sentences:
        r = [rank(found[i][0]) for i in s]
        piece = []
        for j, i in enumerate(s):
            piece.append(i)
            around = r[max(0, j - REACH) : j] + r[j + 1 : j + 1 + REACH]
            if j == len(s) - 1 or (j >= REACH and len(around) == 2 * REACH and r[j] < min(around)):
                cut += [piece[k : k + LONGEST] for k in range(0, len(piece), LONGEST)]
                piece = []
    starts = [0, *(found[p[0]].start() for p in cut[1:]), len(text)]
    return [(tuple(found[i][0] for i in p), text[a:b]) for p, a, b in zip(cut, starts, starts[1:])]


def plain_runs(cut, run, least):
    """(first piece, last, words) of every run."""
    for i in range(len(cut)):
        for j in range(i + run, len(cut) + 1):
            said = tuple(w for p, _ in cut[i:j] for w in p)
            if len(said) >= least:
                yield i, j, said
                break


def brute(rows, run=3, least=25):
    cut = [plain(t) if t else None for _, t in rows]
    order = lambda d: (d is None, d or 0)
    holders = {}
    for (d, _), p in zip(rows, cut):
        for *_, said in plain_runs(p or [], run, least):
            holders[said] = min(holders.get(said, order(d)), order(d))
    out = []
    for (d, text), p in zip(rows, cut):
        gone, seen = set(), set()
        for i, j, said in plain_runs(p or [], run, least):
            if holders[said] < order(d) or said in seen:
                gone.update(range(i, j))
            seen.add(said)
        out.append((d, "".join(t for i, (_, t) in enumerate(p) if i not in gone) if gone else text))
    return sorted(out, key=str)


def some(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def prose(rng, n):
    return "".join(some(rng, rng.choice([1, 2, 5, 9, 14, 30, 60])) + rng.choice([". ", "! ", ".\n", "\n\n", ", ok\n", "?! "]) for _ in range(n))


def han(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))


def odd(rng, n):
    return "".join(rng.choice(["a", "bb", "é", " ", " ", "²", "😀", "。", "」", "字", "ไ", "가", ".", "!", " ", "  ", "\t", "\n", "\r", "\x1c", "\x85", "𠀀"]) for _ in range(n))


def tables(rng):
    passages = [prose(rng, 8) for _ in range(5)] + [han(rng, 70), odd(rng, 200)]
    rows = []
    for i in range(120):
        text = prose(rng, rng.randint(0, 8)) if i % 4 else odd(rng, rng.randint(0, 120)) + han(rng, 9)
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(["\n", " "]) + rng.choice(passages) + "\n" + prose(rng, 2)
        rows.append((i, text))
    rows += [(500 + i, passages[0]) for i in range(60)] + [(3, rows[3][1]), (3, "other"), (None, passages[1]), (None, passages[1]), (900, None), (901, ""), (902, "a b c. " * 1500), (903, " \n "), (904, "la " * 900)]
    rng.shuffle(rows)
    return rows


def test_pieces_are_those_of_loops_and_tile_the_text():
    rng = random.Random(0)
    texts = ["", " ", "\n\n a", "One. Two!  Three?\nFour", "3.5 is a number. yes", "x " * 100, "a\n\n\n b.\n \n", None, *(prose(rng, 12) for _ in range(40)), *(odd(rng, 150) for _ in range(60)), han(rng, 90)]
    found = words(texts)
    starts = pieces(found)
    assert np.diff(starts).max() <= LONGEST
    for i, text in enumerate(texts):
        mine = [np.arange(a, b) for a, b in zip(starts, starts[1:]) if found.text[a] == i]
        want = plain(text or "")
        assert [[int(h) for h in found.hashes[m]] for m in mine] == [[rank(w) for w in p] for p, _ in want]
        assert "".join(t for _, t in want) == (text if want else "")


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, 300), "short. one", odd(rng, 9000), han(rng, 5000), "x" * 9000, prose(rng, 200).replace(" ", "\n"), ("a" * 50 + "\n") * 300]
    whole = words(texts)
    monkeypatch.setattr(substring, "BLOCK", 4500)
    for a, b in zip(whole, words(texts)):
        assert (a == b).all()


def test_matches_brute_force(spark):
    rows = tables(random.Random(5))
    docs = spark.createDataFrame([(d, t, "en", "x", 1, 0) for d, t in rows], SCHEMA).repartition(5)
    found = dedup(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == brute(rows)
    old = defaultdict(set)
    for d, t in rows:
        old[d].add(t)
    for r in found:
        assert (r._n_removed > 0) == bool(r._removed)
        if r._removed:
            assert any(t and "".join(t[a:b] for a, b in zip([0, *(x.end for x in r._removed)], [*(x.start for x in r._removed), len(t)])) == r.text for t in old[r.doc_id])


def test_sql_matches_brute_force():
    import duckdb
    import pyarrow as pa

    from strandmill.llm.oracles import OP6_SUBSTRING

    rows = tables(random.Random(6))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
    assert sorted(((r[0], r[1]) for r in con.sql(OP6_SUBSTRING).fetchall()), key=str) == brute(rows)


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,0)"])
def test_other_types_of_id(spark, kind):
    rng = random.Random(9)
    text = prose(rng, 12) + some(rng, 60)
    docs = spark.createDataFrame([(i, text) for i in range(11, 15)], "doc_id long, text string")
    found = dedup(docs.selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")).collect()
    assert [str(r.doc_id) for r in found if r.text == text] == ["11"]


def test_long_passages_go_wherever_they_stand(spark):
    rng = random.Random(8)
    for size in (1, 2, 3, 6, 18):  # sentences that make up a passage of 54 words
        for inside in (False, True):
            passage = "".join(some(rng, 54 // size) + ". " for _ in range(size)).strip()
            clean = [(i, prose(rng, 20)) for i in range(40)]
            put = lambda d, t: f"{t} {some(rng, d + 1)} {passage} {some(rng, 50 - d)}" if inside else f"{t}\n{passage}\n{prose(rng, 3)}"
            rows = [(d, put(d, t) if d % 5 == 0 else t) for d, t in clean]
            found = {r.doc_id: r for r in dedup(spark.createDataFrame([(d, t, "en", "x", 1, 0) for d, t in rows], SCHEMA)).collect()}
            for d, t in rows:
                if d % 5 or d == 0:
                    assert found[d].text == t
                elif not inside:
                    assert found[d].text == t.replace(passage + "\n", "")
                else:
                    (gone,) = found[d]._removed
                    at = t.index(passage)
                    assert at <= gone.start and gone.end <= at + len(passage) + 1  # nothing else goes


def test_equal_words_get_equal_cuts():
    rng = random.Random(12)
    passage = some(rng, 120).split()
    inside = []
    for before in range(30):
        found = words([" ".join(some(rng, before).split() + passage + some(rng, 30 - before).split())])
        first, last = before + LONGEST + REACH, before + len(passage) - LONGEST - REACH
        inside.append([int(i) - before for i in pieces(found) if first <= i <= last])
    assert inside[0] and all(x[2:-2] == inside[0][2:-2] for x in inside)


def test_passages_of_short_lines_and_without_spaces_go(spark):
    rng = random.Random(13)
    lines = "".join(some(rng, 3) + "\n" for _ in range(20))
    single = "".join(some(rng, 1) + "\n" for _ in range(30))
    marked = "".join(han(rng, 12) + "。" for _ in range(5))
    unmarked = han(rng, 60)
    for passage, whole in ((lines, True), (single, True), (marked, True), (unmarked, False)):
        rows = [(d, prose(rng, 4) + "\n" + (han(rng, d + 1) + ("。" if whole else "") if passage in (marked, unmarked) else "") + passage + han(rng, 9) + "。\n" + prose(rng, 3)) for d in range(6)]
        found = {r.doc_id: r.text for r in dedup(spark.createDataFrame([(d, t, "en", "x", 1, 0) for d, t in rows], SCHEMA)).collect()}
        assert found[0] == rows[0][1]
        for d, t in rows[1:]:
            if whole:
                assert found[d] == t.replace(passage, "")
            else:
                assert 25 <= len(t) - len(found[d]) <= len(passage) and passage not in found[d]


def test_stage_and_empty_table(spark):
    text = " ".join(f"w{i}{'.' if i % 9 == 8 else ''}" for i in range(36))
    docs = spark.createDataFrame([(1, text, "en", "x", 1, 7), (2, text, "en", "x", 1, 7), (3, "", "en", "x", 1, 0), (4, None, None, None, None, None), (5, text + " New words are here.", "en", "x", 1, 9)], SCHEMA)
    out = clean_documents(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.text is not None) == [(1, text, 7), (3, "", 0), (5, "New words are here.", 19)]
    assert dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cleaned([], [], 3, 25)[0] == [] and cleaned([None, ""], [None, None], 3, 25)[0] == [None, ""]


def test_query_on_the_small_tables(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    found = op6_substring(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == brute(rows)

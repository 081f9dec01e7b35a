import random
import re

import pytest

from strandmill.llm.line_rules import base_rules, clean, cleaned, failing_rule, op7_line_rules

SCHEMA = "doc_id long, text string, lang string, kept string, n_words int"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", s)) and s in lines[:i] for i, s in enumerate(lines))
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside.update((i, i + 1, i + 2))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_counts_match_the_definition():
    rng = random.Random(2)
    texts = [None, "", " \n\n", "a", "a b", "a b c a b c", "a a a a a", "é\xa0x y\x1cz q", "x\n\nx\n x\nx\n\x0b\nx\x85"]
    alphabet = ["a", "b", "é#", "|", "\n", "<x>", " ", "\t", "日本", "\x1d"]
    texts += ["".join(rng.choice(alphabet) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for t in texts:
        assert tuple(base_rules(t)) == plain(t), repr(t)


@pytest.mark.parametrize(
    "line, rule",
    [
        ("Home | News | About | Contact", "navigation"),
        ("Home About Contact Login", "navigation"),
        ("Copyright 2020. All rights reserved.", "boilerplate"),
        ("Please accept cookies to go on.", "boilerplate"),
        ("this### is*** the%%% sort&&& of$$$ text.", "symbols"),
        ("BUY!! NOW!! VERY!! CHEAP!! TODAY!!", "shouting"),
        ("word " * 20 + "end.", "repetition"),
        ("function call(a, b) {", "punctuation"),
        ("one two three four five six seven eight nine ten eleven twelve", "punctuation"),
        ("A plain sentence, with a pipe | in it.", None),
        ("A heading", None),
        ("He said: home is where the search ends.", None),
        ("", None),
        ("  \t", None),
    ],
)
def test_rules_of_a_line(line, rule):
    assert failing_rule(line) == rule


def test_failed_lines_go():
    text = "Home | News | About | Contact\nA sentence stays here.\n\nAll rights reserved"
    assert cleaned(text) == ("A sentence stays here.\n", 14, 4, {"navigation": 1, "boilerplate": 1})


def test_odd_tables(spark):
    assert clean(spark.createDataFrame([], SCHEMA)).count() == 0
    good = "This is a sentence about many things. " * 1 + " ".join(f"Item {i} differs from item {i + 1}." for i in range(30))
    rows = [(None, None, None, None, None), (1, "", "x", "y", 1), (2, good, "x", "y", 1), (2, good, "x", "y", 1), (3, "w " * 100000, "x", "y", 1), (4, good + "\n" + "Home | News | About | Go\n" * 60, "x", "y", 1)]
    found = clean(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in found) == [("1", True, False), ("2", False, True), ("2", False, True), ("3", True, False), ("4", True, False), ("None", True, False)]


def test_query_on_the_small_tables(spark):
    import duckdb

    rows = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' where length(text) < 6000").fetchall())
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.001/labels.parquet'").fetchall())
    for r in op7_line_rules(spark, "/root/testdata/sf0.001").collect():
        if r.doc_id in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(rows[r.doc_id])
            if labels.get(r.doc_id) == 1 and not r.base_failed:
                assert r.kept

"""Stages on documents whose extra columns have the names that operators use inside, and on empty and null rows."""

import pytest

import corpus_pipeline

EXTRA = ["_id", "_key", "_n", "_rows", "_each", "_copy", "_source", "_size", "_score", "_later", "_removed", "_sentences", "_n_removed", "_extra", "_part", "_k0", "fp", "label", "size", "rank", "key", "text_key", "first", "u", "v", "h1", "class", "part", "a.b", "copies", "target", "ids"]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("names")
    rows = [(i, int(i % 4 > 0), 0, "x") for i in range(80)] + [(None, 1, None, None), (3, None, None, "y"), (3, 0, 1, "z"), (3, 1, 1, "z")]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string").write.parquet(f"{top}/labels.parquet")
    return str(top)


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, *("e" for _ in EXTRA)) for r in rows], schema)


@pytest.mark.parametrize("number", range(5))
def test_clashing_names_and_nulls(spark, labelled, number):
    name, stage = corpus_pipeline.STAGES[number]
    good = "A sentence about item {0}. Another one about {0} follows here. The third says {0} again and ends."
    rows = [(i, good.format(i * 7) if i % 4 else f"| x{i} | y | z | " * 6, "en", "s", 90) for i in range(80)]
    rows += [(None, None, None, None, None), (None, "no id here at all", None, None, None), (200, "", "en", "s", 0), (201, None, "en", None, 0), (5, rows[5][1], "en", "s", 90), (300, "word " * 60000, "en", "t", 9)]
    docs = documents(spark, rows)
    out = stage(spark, docs, labelled)
    found = out.collect()
    assert found
    if number < 4:
        assert out.columns == docs.columns
        assert all(r["_id"] == "e" and r["a.b"] == "e" for r in found)
        assert {(r.doc_id, r.source) for r in found} <= {(r[0], r[3]) for r in rows}
    empty = stage(spark, docs.limit(0), labelled)
    assert empty.count() == 0

"""Each stage of the pipeline on what the stage before it kept, against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandmill.llm import quality
from strandmill.llm.mixing import mix
from strandmill.llm.tokens import default_path
from tests.llm.test_packing import check
from tests.llm.test_simhash import classes, plain
from tests.llm.test_substring import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of documents and of what each stage returns."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{top}/{i}")
        out.append(spark.read.parquet(f"{top}/{i}"))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing sources to target weights", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage(spark, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    wanted = {r.doc_id for r in stages[0].collect() if quality.probability(r.text, *model) >= 0.3}
    assert {r.doc_id for r in stages[1].collect()} == wanted
    assert 0 < len(wanted) < stages[0].count()


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, plain(r.text)) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d, _, c in classes(rows) if d == c)


def test_substring_stage(stages):
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    old = dict(before)
    wanted = {d: t for d, t in brute(before) if t.strip() or t == old[d]}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    assert {d: t for d, (t, _) in got.items()} == wanted
    assert all(n == len(t) for d, (t, n) in got.items() if t != old[d])


def test_mixing_stage(stages):
    copies = Counter()
    for r in mix(stages[3]).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in stages[4].collect()) == +copies


def test_packing_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    pieces = stages[5]
    ids = Tokenizer.from_file(default_path())
    got = pieces.withColumn("key", F.concat_ws(":", "doc_id", "copy")).collect()
    assert Counter(d for d, _ in rows) == Counter(d for d, _ in {(p.doc_id, p.copy) for p in got})
    check(rows, got, 1, 2048, ids, gaps=True)
    full = Counter()
    for p in got:
        full[p.sequence_id] += p.length
    assert max(full.values()) <= 2048
    spaces = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == spaces.get(p.sequence_id, 0)
        spaces[p.sequence_id] = p.offset + p.length


def test_run_agrees_with_the_stages(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first() == stages[5].agg(F.sum("length")).first()
    assert set(columns) <= set(stages[5].columns)

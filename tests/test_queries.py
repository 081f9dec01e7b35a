"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from strandmill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 50


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    found = QUERIES[name](spark, SF)
    asked = duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(asked.columns)
    at = [asked.columns.index(c) for c in columns]
    wanted = sorted((tuple(r[i] for i in at) for r in asked.fetchall()), key=str)
    assert sorted(map(tuple, found.select(*(f"`{c}`" for c in columns)).collect()), key=str) == wanted
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    assert [kinds[dict(found.dtypes)[c]] for c in columns] == [str(asked.types[i]) for i in at]


def test_every_row_of_the_index_is_asked(spark):
    from strandmill.operators import index
    from strandmill.sources import derived as D

    ref = D.reference(spark, SF)
    codes = [r.code for r in index.bwt(ref, index.suffix_array(ref)).orderBy("row").collect()]
    got = {r.row: (r.code, r.occ) for r in QUERIES["occ_lookup"](spark, SF).collect()}
    assert got == {i: (7 * i % 64, codes[:i].count(7 * i % 64)) for i in range(len(codes))}


def test_reads_that_a_schema_comes_from_keep_it(spark):
    from strandmill.operators import metadata
    from strandmill.sources import derived as D

    known = D.order_reads(spark, SF).select("read_id", "meta").where("read_id < 500")
    kinds = metadata.frozen(metadata.schema(known))
    assert known.count() and metadata.violations(known, kinds, metadata.dictionary(known, kinds)).count() == 0


def test_every_triple_of_a_read_is_coded(spark):
    from strandmill.sources import derived as D

    seqs = {r.read_id: r.seq for r in D.customer_reads(spark, SF).collect()}
    got = sorted(map(tuple, QUERIES["kmer_codes"](spark, SF).select("read_id", "position", "triple", "code").collect()))
    code = lambda t: None if "N" in t else sum("ACGT".index(b) << 4 - 2 * k for k, b in enumerate(t))
    assert got == sorted((d, i + 1, s[i : i + 3], code(s[i : i + 3])) for d, s in seqs.items() for i in range(len(s) - 2))

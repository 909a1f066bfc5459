import os

import __spark_entry__ as entry
import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    c = duckdb.connect(config={"temp_directory": str(tmp_path_factory.mktemp("duck")), "max_temp_directory_size": "2GB"})
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


def plain(rows):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).first()[0] == 830


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name in entry.oracle_sql():
        sql = entry.oracle_sql()[name]
        assert sorted(duck.sql(sql).columns) == columns
        assert got == plain(duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall())
    else:
        table, key = INVARIANTS[name]
        rows = {r[columns.index(key)] for r in got}
        assert rows and rows <= {r[0] for r in duck.sql(f"select {key} from {table}").fetchall()}


#: Of the queries that SQL can't give (estimates, tokens, languages): the rows that theirs come from.
INVARIANTS = {
    "p4_overlap": ("(select v as v_a from csr_offsets)", "v_a"),
    "p4_overlap_tenth": ("(select v as v_a from csr_offsets)", "v_a"),
    "p6_ids": ("documents", "doc_id"),
    "p7_packed": ("documents", "doc_id"),
    "p8_found": ("documents", "doc_id"),
    "p8_languages": ("documents", "doc_id"),
}


def test_what_has_no_sql_is_named():
    assert {n for n in entry.queries() if n not in entry.oracle_sql()} <= set(INVARIANTS)

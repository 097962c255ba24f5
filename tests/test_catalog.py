"""Every registered query of the catalogue against its SQL."""

import math
import os

import duckdb
import pytest

from argentum import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(str([tidy(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = rows(df.collect(), df.columns)
    assert got == rows(rel.fetchall(), rel.columns)
    assert got


def test_group_ids_hash_the_first_numbers(spark):
    """Number by number, each hash seeding the next."""
    import struct

    import xxhash

    def plain(vector):
        h = 42
        for x in vector[:64]:
            h = xxhash.xxh64_intdigest(struct.pack("<f", x), h)
        return f"face-{h:016x}"

    found = {r["vec_id"]: r["group_id"] for r in catalog.queries()["face_group_id"](spark, DATA).collect()}
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    assert found == {r["vec_id"]: plain(r["embedding"]) for r in given}

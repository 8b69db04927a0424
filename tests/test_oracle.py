"""Registered queries against their SQL on the smallest driver tables.

A cross-section by default; all of them with ORACLE_ALL=1 (tools/check_oracle.py runs all, too).
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lithoframe import queries as registered
from tools.check_oracle import TABLES, rows

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
registered.load()
QUERIES, ORACLES = registered.QUERIES, registered.ORACLES
SECTION = ("g2_", "g4_", "g9_", "p3_", "p9_", "a1_", "a3_", "a12_", "k1_", "k3_", "r2_", "r5_", "t4_", "t5_", "t12_",
           "i2_", "i3_", "v1_", "v3_", "v7_", "v9_", "c1_", "c7_corr", "c9_", "c11_", "c14_", "c22_", "c23_", "s1_",
           "s3_", "s7_rows", "s12_", "st2_")
CHOSEN = [n for n in QUERIES if os.environ.get("ORACLE_ALL") or n.startswith(SECTION)]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        assert rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())


def test_every_query_is_named_and_checked():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["n_traces"] == row["n_inlines"] * row["n_crosslines"]


GAPPY = [
    "i1_batch_scoring",
    "i3_overlap_blend",
    "i4_threshold_mask",
    "r7_dense_mask",
    "t14_transform_hooks",
    "t5_patch_extraction",
    "t6_patch_zscore",
    "t7_patch_zscore_guarded",
    "v8_held_out_evaluation",
]


@pytest.mark.parametrize("name", GAPPY)
def test_missing_traces_count_as_zeros(spark, tmp_path, name):
    """A survey with two cells missing inside and a last inline that ends early."""
    with duckdb.connect() as c:
        c.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 481 AND vec_id NOT IN (137, 138)) "
                  f"TO '{tmp_path}/embeddings.parquet'")
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        cur = c.execute(ORACLES[name])
        assert rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())


WITHOUT_LINES = [
    "r7_dense_mask",
    "t5_patch_extraction",
    "t14_transform_hooks",
    "t6_patch_zscore",
    "t7_patch_zscore_guarded",
]


@pytest.mark.parametrize("name", WITHOUT_LINES)
def test_lines_without_traces_are_on_the_grid(spark, tmp_path, name):
    """A survey in which one inline was never recorded reaches to its last one all the same."""
    with duckdb.connect() as c:
        c.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 490 AND vec_id // 25 <> 6) "
                  f"TO '{tmp_path}/embeddings.parquet'")
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        cur = c.execute(ORACLES[name])
        assert rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())


def test_halves_along_a_stick_dont_depend_on_the_order_of_sums(spark, tmp_path):
    """Sticks with positions halfway between voxels, in blocks of any size and in SQL."""
    with duckdb.connect() as c:
        c.execute(f"COPY (SELECT * REPLACE (event_id + k.k * 100000 AS event_id, user_id + k.k * 1500 AS user_id) "
                  f"FROM '/root/testdata/sf0.1/events.parquet', range(6) k(k) WHERE user_id + k.k * 1500 IN "
                  f"(1486, 1709, 5625, 5744, 7737, 4511, 5547, 6255, 5715, 3900, 6905, 1892)) TO '{tmp_path}/events.parquet'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        cur = c.execute(ORACLES["r5_index_sticks_to_mask"])
        want = rows([d[0] for d in cur.description], cur.fetchall())
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for blocks in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", blocks)
            df = QUERIES["r5_index_sticks_to_mask"](spark, str(tmp_path))
            assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


SURVEYS = [
    "t14_transform_hooks",
    "t6_patch_zscore",
    "t7_patch_zscore_guarded",
]


@pytest.mark.parametrize("name", SURVEYS)
def test_every_survey_has_its_own_grid(spark, tmp_path, name):
    """Two surveys of different extents, one of which begins at a later inline."""
    with duckdb.connect() as c:
        c.execute(f"COPY (SELECT * REPLACE (vec_id + 300 AS vec_id) FROM '{SF}/embeddings.parquet' WHERE vec_id < 470 UNION ALL "
                  f"SELECT * REPLACE (vec_id + 1000000 AS vec_id) FROM '{SF}/embeddings.parquet' WHERE vec_id < 310) "
                  f"TO '{tmp_path}/embeddings.parquet'")
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        cur = c.execute(ORACLES[name])
        assert got and rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())

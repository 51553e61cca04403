"""One Spark session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "6g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-")).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    def check(query, sql, sf=SF):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        con.execute(f"CREATE TABLE wanted AS {sql}")
        cur = con.execute("SELECT * FROM wanted")
        wanted = canonical([d[0] for d in cur.description], cur.fetchall())
        df = query(spark, sf)
        got = canonical(df.columns, [tuple(r) for r in df.toLocalIterator()])
        assert got[0] == wanted[0]
        assert len(got[1]) == len(wanted[1])
        bad = [(a, b) for a, b in zip(got[1], wanted[1], strict=True) if a != b]
        assert not bad, (len(bad), bad[:3])

    return check

"""Every registered query of the engine against its SQL; those without SQL by their invariants."""

from __future__ import annotations

import math

import pytest
from conftest import SF
from pyspark.sql import functions as F

from infotraj import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_its_sql_gives(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def test_tree_spans_all_coordinates_and_sums_to_the_report(spark):
    tree = queries.q_tree(spark, SF).groupBy("step").agg(F.count("*").alias("edges"), F.sum("mi").alias("total")).collect()
    report = {r["step"]: r for r in queries.q_mist(spark, SF).collect()}
    for r in tree:
        m = report[r["step"]]
        assert r["edges"] == 63
        assert math.isclose(m["S1"] - m["S2"], r["total"], abs_tol=1e-4)
    assert len(tree) == queries.NSTEPS


def test_kde_states_follow_minima(spark):
    found = {r["dof"]: r for r in queries.q_kde_minima(spark, SF).collect()}
    assert len(found) == 24 and all(len(r["minima"]) == r["k"] <= 3 for r in found.values())
    rows = queries.q_kde_states(spark, SF).groupBy("dof").agg(F.max("bin").alias("top"), F.count("*").alias("n")).collect()
    assert all(r["top"] < max(1, found[r["dof"]]["k"]) for r in rows)
    s = queries.q_kde_entropy(spark, SF).agg(F.min("s"), F.max("s")).first()
    assert 0 <= s[0] <= s[1] <= math.log(3) + 1e-9

"""Queries that must do the whole job: every row, vintage, value and point takes part."""

import datetime
import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare

from seriesloom.functions import forecasting as fo
from seriesloom.operators import clouds as cl
from seriesloom.plans.registry import oracle_sql, queries


@pytest.mark.parametrize("name", ["h08_mediated_coupling", "g14_medoid", "t08_within_between", "v07_support"])
def test_all_rows_take_part(spark, sf_dir, name):
    ok, said = compare(spark, queries()[name], oracle_sql()[name], sf_dir)
    assert ok, said
    assert "% 20" not in oracle_sql()[name]


def test_all_plans_are_coupled(spark, sf_dir):
    n = duckdb.sql(f"select count(*) from '{sf_dir}/embeddings.parquet' where embedding is not null").fetchall()[0][0]
    assert queries()["h08_mediated_coupling"](spark, sf_dir).select("id").distinct().count() == n


@pytest.mark.parametrize("few", [10, 100_000])
def test_median_distances(spark, few):
    rng = np.random.default_rng(0)
    v, label = np.r_[rng.normal(size=(60, 3)), np.zeros((12, 3))], np.r_[rng.integers(0, 3, 60), np.zeros(12, int)]
    p = spark.createDataFrame([(i, [float(a) for a in v[i]], int(label[i])) for i in range(72)], "id long, v array<double>, label long")
    d, (i, j) = cl.distances(v), np.triu_indices(72, 1)
    same = label[i] == label[j]
    got = {r.same: r.d for r in cl.median_distances(p, bins=16, few=few).collect()}
    assert np.isclose(got[True], np.median(d[i, j][same])) and np.isclose(got[False], np.median(d[i, j][~same]))


@pytest.mark.parametrize("name", ["j01_align_monthly", "j02_align_quarterly", "j03_aggregate_then_join", "j04_full_outer_months", "emb12_joint_embedding"])
def test_all_vintages_are_paired(spark, sf_dir, name):
    ok, said = compare(spark, queries()[name], oracle_sql()[name], sf_dir)
    assert ok, said
    assert "vintage = 1" not in oracle_sql()[name]


@pytest.mark.parametrize("name", ["emb13_joint_map", "s05_coupling"])
def test_all_vintages_are_coupled(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    rows = [(f"{k}{v}{i}", k, v, datetime.date(2000, 1, 1) + datetime.timedelta(i), float(x)) for k, vs in (("a", (1, 2, 4, 7)), ("b", (1,))) for v in vs for i, x in enumerate(rng.normal(size=80))]
    spark.createDataFrame(rows, "obs_id string, key string, vintage int, date date, value double").write.parquet(str(tmp_path / "readings.parquet"))
    got = queries()[name](spark, str(tmp_path)).toPandas()
    assert set(zip(got.key, got["first"])) == {("a", 1), ("a", 2), ("a", 4), ("b", 1)}
    value = got["eigenvalue" if name == "emb13_joint_map" else "mi"]
    assert value[got.key == "a"].notna().all() and value[got.key == "b"].isna().all()


def test_a_degenerate_cloud_keeps_its_row(spark, tmp_path):
    day = datetime.date(2000, 1, 1)
    # only the last value differs, which no delay vector reaches
    value = {1: lambda i: float(i == 89), 2: lambda i: float(np.sin(i * i))}
    rows = [(f"{v}{i:03}", "a", v, day + datetime.timedelta(i), f(i)) for v, f in value.items() for i in range(90)]
    spark.createDataFrame(rows, "obs_id string, key string, vintage int, date date, value double").write.parquet(str(tmp_path / "readings.parquet"))
    row = queries()["s05_coupling"](spark, str(tmp_path)).toPandas().iloc[0]
    assert row["first"] == 1 and np.isnan(row.mi) and row.error


def test_the_ladder_takes_the_whole_series(spark, tmp_path):
    rng = np.random.default_rng(2)
    day = datetime.date(2000, 1, 1)
    rows = [(f"{k}{i:04}", k, 1, day + datetime.timedelta(i), float(x)) for k, n in (("long", 500), ("short", 70), ("none", 40)) for i, x in enumerate(rng.normal(size=n).cumsum())]
    spark.createDataFrame(rows, "obs_id string, key string, vintage int, date date, value double").write.parquet(str(tmp_path / "readings.parquet"))
    got = queries()["f11_ladder"](spark, str(tmp_path)).toPandas()
    n = {k: set(g.n) for k, g in got.groupby("key")}
    want = {k: sum(b - a for _, a, b in fo.walk(m)) for k, m in (("long", 500), ("short", 70))}
    assert n == {"long": {want["long"]}, "short": {want["short"]}, "none": {0}} and want["short"] > 0
    assert len(got[got.key == "long"]) == 7 and got[got.key == "none"].error.tolist() == ["too short"]

"""Queries that once did less than their names say."""

import os

import pytest

from erspark.plans.fixtures import pair
from erspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_sort_pairs_ranks_every_pair(spark):
    groups = {}
    for r in pair(spark, SF).collect():
        groups.setdefault(r["s1"], []).append((-r["p"], r["pool"]))
    want = [(s1, pool, k) for s1, g in sorted(groups.items()) for k, (_, pool) in enumerate(sorted(g))]
    assert [(r["s1"], r["pool"], r["rank"]) for r in QUERIES["sort_pairs"](spark, SF).collect()] == want


def test_predictions_are_of_held_out_entities(spark):
    from pyspark.sql import functions as F

    from erspark.operators import truth

    held = pair(spark, SF).where(truth.folds(F.col("s1"), 1.0, 0.1, 3) < 0).select("s1", "pool").collect()
    got = QUERIES["ml_gbdt_predict"](spark, SF).collect()
    assert {(r["s1"], r["pool"]) for r in got} == {tuple(r) for r in held} and held


def test_no_name_stands_for_another_operator():
    assert len(set(map(id, QUERIES.values()))) == len(QUERIES)


def test_simplest_rule_comes_from_the_full_grid(spark):
    from erspark.operators import metrics, rules
    from erspark.plans.fixtures import entity

    rows = QUERIES["rule_grid_full"](spark, SF).collect()
    assert len(rows) == len({(r["kind"], r["threshold"], r["multiplier"], r["exclusive"]) for r in rows}) == 2 * (60 + 48)
    p, e = pair(spark, SF), entity(spark, SF)
    for r in [x for x in rows if x["kind"] == "relative"][::31] + [x for x in rows if x["kind"] == "global"][::50]:
        rule = rules.Rule(r["kind"], r["threshold"], bool(r["exclusive"]), multiplier=r["multiplier"] or 2.0)
        assert abs(metrics.macro_f05(rules.keep(p, rule), e).first()["macro_f05"] - r["f05"]) < 1e-6, r
    got = QUERIES["rule_select_simplest"](spark, SF).first()
    assert got["f05"] >= max(r["f05"] for r in rows) - 0.001


def test_cluster_features_are_all_seven(spark, monkeypatch):
    from erspark.operators import lists, model
    from erspark.plans.queries_io import CLUSTER

    pairs = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, 0.8, 0)], "s1 long, pool long, p double, is_new int")
    vectors = spark.createDataFrame([(1, [0.5, 0.5, 0.1, 0.2]), (2, [0.5, 0.1, 1.0, 0.0])], "id long, vec array<double>")
    got = {r["pool"]: r for r in lists.cluster_features(pairs, vectors).collect()}
    assert (got[2]["cl_name_top1"], got[2]["cl_addr_top1"], got[2]["cl_cos_top1"]) == (0.3, 0.1, 0.4)
    assert got[1]["cl_name_top1"] is None and got[1]["cl_addr_top1"] is None
    seen, second = [], model.second_stage
    monkeypatch.setattr(model, "second_stage", lambda *a, **k: seen.extend(k["extra"]) or second(*a, **k))
    out = QUERIES["ml_second_stage_v3"](spark, SF)
    assert set(CLUSTER) <= set(seen) and out.count() == pair(spark, SF).count()

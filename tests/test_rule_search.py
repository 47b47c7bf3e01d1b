"""The search over all rules, against each rule by itself, with a row a pair."""

import os
import random

import pytest

from erspark.operators import metrics, rules

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("own", [True, False])
def test_every_rule_scores_as_by_itself(spark, monkeypatch, own):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(9), rng.randrange(12)) for _ in range(70)})
    rows = [(s, q, rng.choice([0.05, 0.2, 0.3, 0.3, 0.45, 0.6, 0.9, 0.995]), int(s % 4 and rng.random() < 0.4)) for s, q in rows]
    df = spark.createDataFrame(rows, "s1 long, pool long, p double, y int")
    truth = df.groupBy("s1").sum("y").toDF("s1", "n_true")
    if not own:  # matches that are no pairs, an entity without pairs, and one that is not scored
        truth = truth.where("s1 <> 3").selectExpr("s1", "if(n_true > 0, n_true + s1 % 2, n_true) as n_true").unionAll(spark.createDataFrame([(50, 0), (51, 2)], "s1 long, n_true long"))
    paths = []
    monkeypatch.setattr(rules, "fresh", lambda *a, f=rules.fresh: paths.append(f(*a)) or paths[-1])
    monkeypatch.setattr(rules, "THRESHOLDS", [0.1, 0.3, 0.46, 0.995])
    monkeypatch.setattr(rules, "FLOORS", [0.2, 0.45])
    got = rules.search(df, None if own else truth).collect()
    assert len(got) == 2 * (4 + 2 * 3)
    for r in got:
        kept = rules.keep(df.selectExpr("*", "0 as is_s3"), rules.Rule(r["kind"], r["threshold"], bool(r["exclusive"]), multiplier=r["multiplier"] or 2.0))
        assert abs(metrics.macro_f05(kept, truth).first()["macro_f05"] - r["f05"]) < 1e-8, r
    assert [spark.read.parquet(p).count() <= len(rows) for p in paths] == [True]  # one row a pair, not one a rule


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_simplest_rule_takes_one_search(spark, monkeypatch):
    from erspark.plans.fixtures import pair
    from erspark.plans.registry import QUERIES

    paths = []
    monkeypatch.setattr(rules, "fresh", lambda *a, f=rules.fresh: paths.append(f(*a)) or paths[-1])
    got = QUERIES["rule_select_simplest"](spark, SF).first()
    assert len(paths) == 1 and spark.read.parquet(paths[0]).count() <= pair(spark, SF).count()
    rows = QUERIES["rule_grid_full"](spark, SF).collect()
    near = [r for r in rows if r["f05"] >= max(x["f05"] for x in rows) - 0.001 - 1e-12]
    assert any((got["kind"], got["threshold"], got["exclusive"], got["f05"]) == (r["kind"], r["threshold"], r["exclusive"], r["f05"]) for r in near)

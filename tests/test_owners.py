"""The best pairs of each pool record, and the disk that a search over all rules takes for them."""

import math
import os
import random

import pyarrow as pa
import pytest

from erspark.operators import owners

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_winners_are_the_first_of_each_field(spark, monkeypatch, kind):
    rng = random.Random(7)
    name = (lambda x: None if x == 3 else x) if kind == "long" else (lambda x: None if x == 3 else f"é{x}" if x % 2 else f"S{x}")
    some = sorted({(rng.randrange(300), min(rng.randrange(40), rng.randrange(40))) for _ in range(3000)})
    rows = [(name(s), name(q), rng.choice([0.1, 0.3, 0.3, 0.9, math.inf, math.nan, -0.5]), rng.randrange(4), rng.choice([0, 1, None])) for s, q in some]
    monkeypatch.setattr(owners, "HELD", 50)
    got = owners.winners(spark.createDataFrame(rows, f"s1 {kind}, pool {kind}, p double, field int, y int").repartition(7), 4)
    seen, want = {}, []
    first = lambda r: (not math.isnan(r[2]), 0.0 if math.isnan(r[2]) else -r[2], r[0] is not None, 0 if r[0] is None else r[0].encode() if kind == "string" else r[0])
    for r in sorted(rows, key=first):
        until = seen.get(r[1], 4)
        if r[3] < until:
            seen[r[1]] = r[3]
            want.append((*r, until))
    assert got.columns == ["s1", "pool", "p", "field", "y", "until"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert owners.winners(got.drop("until").where("false"), 4).count() == 0


def test_a_pool_of_all_pairs_needs_no_task_to_hold_them(spark, monkeypatch):
    monkeypatch.setattr(owners, "HELD", 100)
    df = spark.range(0, 20000, 1, 4).selectExpr("id as s1", "1L as pool", "id / 20000 as p", "cast(id % 4 as int) as field")
    assert sorted((r["s1"], r["until"]) for r in owners.winners(df, 4).collect()) == [(19996, 1), (19997, 2), (19998, 3), (19999, 4)]
    at, until = owners.firsts(pa.table({"s1": [5, 4, 3, 2], "pool": [1, 1, 1, 1], "p": [0.9, 0.9, 0.5, 0.4], "field": [2, 2, 2, 0]}), 4)
    assert list(zip(at.tolist(), until.tolist(), strict=True)) == [(1, 4), (3, 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_search_writes_few_bytes_a_pair_and_leaves_none(spark):
    from erspark.plans.fixtures import pair
    from erspark.plans.registry import QUERIES

    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def left() -> dict[str, int]:
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().endswith(".data")}

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    pairs, bytes_before, files_before = pair(spark, SF).count(), written(), left()
    assert len(QUERIES["rule_select_simplest"](spark, SF).collect()) == 1
    assert (written() - bytes_before) / pairs < 25
    assert sum(n for f, n in left().items() if f not in files_before) / pairs < 5
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None

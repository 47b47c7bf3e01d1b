"""Queries that SQL cannot say, against brute force in plain Python."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from erspark.operators import adapter, model, retrieval
from erspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def indel(a, b):
    """Normalised by length: 100 less what must be put in and taken out."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 100.0 if not a and not b else 200 * row[-1] / (len(a) + len(b))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {s}".strip() for s in (left, right))
    return max(indel(one, two), *([indel(both, one), indel(both, two)] if both else [0]))


def twins(spark):
    from erspark.plans.queries import twins as rows

    return {(r["s1"], r["pool"]): r for r in rows(spark, SF).collect()}


@pytest.mark.parametrize("name", ["sim_ratio", "sim_token_sort", "sim_token_set"])
def test_similarities(spark, name):
    plain = lambda t: "".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).strip()
    of = {
        "sim_ratio": indel,
        "sim_token_sort": lambda a, b: indel(" ".join(sorted(a.split())), " ".join(sorted(b.split()))),
        "sim_token_set": token_set,
    }[name]
    rows = twins(spark)
    got = {(r["s1"], r["pool"]): r["value"] for r in QUERIES[name](spark, SF).collect()}
    assert got.keys() == rows.keys() and rows
    for k, r in rows.items():
        assert abs(got[k] - of(plain(r["a"]), plain(r["b"]))) < 1e-4, (k, r["a"], r["b"])


def test_partial_ratio(spark):
    rows = twins(spark)
    got = {(r["s1"], r["pool"]): r["value"] for r in QUERIES["sim_partial"](spark, SF).collect()}
    plain = lambda t: "".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).strip()
    for k in random.Random(1).sample(sorted(rows), min(25, len(rows))):
        a, b = sorted((plain(rows[k]["a"]), plain(rows[k]["b"])), key=len)
        windows = [b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))] if a else [""]
        assert abs(got[k] - max(indel(a, w) for w in windows if w or not a)) < 1e-4, (a, b)


def test_exact_keys(spark):
    from erspark.plans.queries_more import shop

    rows = [r.asDict() for r in shop(spark, SF).collect()]
    want = set()
    for kind in retrieval.EXACT_KINDS:
        def key(r, kind=kind):
            name, city = r["name_core"], r["city"]
            parts = {"exact_name": [name] if len(name) >= 3 else None, "exact_sorted_city": [city, " ".join(sorted(name.split()))] if name and city else None, "exact_postcode": [r["postcode"], name.split(" ")[0]] if r["postcode"] and name else None, "exact_house_city": [city, r["house"]] if city and r["house"] else None}[kind]
            return None if parts is None else "|".join([r["country"], *parts])

        by = "addr" if kind in retrieval.BY_ADDRESS else "name_core"
        groups = {}
        for r in rows:
            if key(r):
                groups.setdefault(key(r), ([], []))[r["src"] > 1].append(r)
        for q, p in groups.values():
            if len(p) <= 200 and len(q) * len(p) <= 20_000:
                for a in q:
                    for src in (2, 3):
                        best = sorted(((-round(token_set(a[by], b[by]) / 100, 6), b["id"]) for b in p if b["src"] == src))[:5]
                        want |= {(kind, a["id"], i, f"S{src}", -s, n) for n, (s, i) in enumerate(best)}
    got = {(r["kind"], r["s1"], r["pool"], r["pool_source"], r["score"], r["rank"]) for r in QUERIES["join_exact_keys"](spark, SF).collect()}
    assert {(*x[:4], round(x[4], 4), x[5]) for x in got} == {(*x[:4], round(x[4], 4), x[5]) for x in want} and len({x[0] for x in got}) == 4


def test_adapter_is_the_closed_form_and_helps(spark):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ turn
    frame = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, vec array<double>")
    pairs = spark.createDataFrame([(i, i) for i in range(60)], "s1 long, pool long")
    towers = adapter.fit(frame(x), frame(y), pairs)
    assert np.allclose(towers.query, np.eye(8) + np.linalg.solve(x.T @ x + np.eye(8), x.T @ y))
    assert np.allclose(towers.pool, np.eye(8) + np.linalg.solve(y.T @ y + np.eye(8), y.T @ x))
    got = np.array([r["vec"] for r in adapter.project(frame(x), towers.query).orderBy("id").collect()])
    want = x @ towers.query
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True))
    rows = {r["space"]: r["cos"] for r in QUERIES["ml_adapter"](spark, SF).collect()}
    assert rows["projected"] > rows["raw"] + 0.3


def test_decomposition_keeps_the_geometry(spark):
    names = ["alpha beta", "alpha betas", "gamma delta", "gama delta", "omega", "", None, "omega"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {r["id"]: np.array(r["vec"]) for r in model.tfidf_svd(df, "name", 500, 4).collect()}
    assert len(got) == len(names) and all(abs(np.linalg.norm(got[i]) - 1) < 1e-9 for i in range(5)) and not got[5].any() and not got[6].any()
    assert got[0] @ got[1] > 0.9 and got[2] @ got[3] > 0.8 and abs(got[0] @ got[2]) < 0.5 and np.allclose(got[4], got[7])


def test_embedders_see_bounded_batches(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) == 1 or len(texts) * max(map(len, texts)) <= 40
        seen.add(len(texts))
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(i, "x" * (i % 13)) for i in range(60)] + [(99, None)], "id long, name string").coalesce(1)
    got = {r["id"]: r["vec"] for r in model.embedded(df, "name", embed, 40).collect()}
    assert got == {**{i: [float(i % 13), 1.0] for i in range(60)}, 99: [0.0, 1.0]}
    seen.value = 0
    assert len(model.embedded_once(df, "name", embed, 40).collect()) == 61 and seen.value == 13


def test_training_path(spark):
    r = QUERIES["ml_train_calibrate"](spark, SF).first()
    assert r["trees"] in (1, 2) and r["threshold"] in (0.3, 0.5) and 0 < r["f05_oof"] < 1 and 0 < r["f05_holdout"] < 1
    rows = QUERIES["ml_cv_oof"](spark, SF).select("s1", "pool", "fold", "oof").collect()
    assert len({(x["s1"], x["pool"]) for x in rows}) == len(rows) and {x["fold"] for x in rows} == {0, 1} and all(0 <= x["oof"] <= 1 for x in rows)


def test_title_case_and_regions(spark):
    from erspark.functions import geo

    rows = [(0, "guinea-bissau", ""), (1, "côte d'ivoire", ""), (2, " U.S. ", ""), (3, None, "")]
    got = [r["c"] for r in spark.createDataFrame(rows, "id int, raw string, x string").select("id", geo.country(F.col("raw")).alias("c")).orderBy("id").collect()]
    assert got == [x.title() for x in ("guinea-bissau", "côte d'ivoire")] + ["US", ""]
    rows = [(0, "x, calif", "US"), (1, "12 road, tn", "India"), (2, "12 road, tn", "US"), (3, "orissa", "US"), (4, "Île de France", "Spain"), (5, "new delhi 560\t001", "India")]
    df = spark.createDataFrame(rows, "id int, addr string, country string")
    got = {r["id"]: r["region"] for r in geo.region(df, "id", "addr", "country", geo.region_table(spark)).collect()}
    assert got == {0: "california", 1: "tamil nadu", 2: "tennessee", 3: "odisha", 4: "ile-de-france", 5: "delhi"}
    assert df.where("id = 5").select(geo.postcode(F.col("addr"), F.col("country")).alias("p")).first()["p"] == "560001"

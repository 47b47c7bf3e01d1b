"""Worked examples of the record-linkage operators."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from erspark.functions import geo, hashing, names, similarity, vectors
from erspark.operators import lists, metrics, retrieval, rules, truth, validate
from erspark.sources import scans, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


def test_macro_f05(spark):
    entities = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 1)], "s1 long, n_true long")
    pred = spark.createDataFrame([(1, 10, 0), (2, 11, 1)], "s1 long, pool long, y int")
    got = {r["s1"]: r["f05"] for r in metrics.entity_scores(pred, entities).collect()}
    assert got[0] == 1 and got[1] == 0 and got[3] == 0 and got[2] == pytest.approx(0.8333333)
    assert metrics.macro_f05(pred, entities).first()[0] == pytest.approx(0.458333, abs=1e-6)


def test_bm25_equals_brute_force(spark):
    docs = [(0, "alpha beta", "x"), (1, "beta gamma", "x"), (2, "alpha alpha delta", "y"), (3, "omega", "y")]
    pool = spark.createDataFrame([(i, n, c, "US") for i, n, c in docs], "id long, name string, city string, country string")
    q = spark.createDataFrame([(9, "alpha delta", "y", "US")], pool.schema)
    got = {r["pool"]: r["score"] for r in retrieval.bm25(q, pool, 4, {"n": "name", "c": "city"}, {"n": 2.0, "c": 0.5}, ["country"]).collect()}
    bags = {i: [f"n:{t}" for t in n.split()] for i, n, _ in docs}  # one-letter cities are no tokens
    avg = sum(map(len, bags.values())) / 4
    want = {}
    for i, bag in bags.items():
        for t in ("n:alpha", "n:delta"):
            df, tf = sum(t in b for b in bags.values()), bag.count(t)
            if tf:
                want[i] = want.get(i, 0) + 2 * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / avg))
    assert got == pytest.approx(want, abs=1e-4) and max(got, key=got.get) == 2


def test_union(spark):
    rows = [("dense", 0, 5, 0.9, 0), ("dense", 0, 6, 0.8, 1), ("dense", 0, 7, 0.7, 2), ("dense", 1, 5, 0.6, 0), ("bm25", 0, 7, 3.0, 0), ("bm25", 0, 8, 2.0, 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "retriever string, s1 long, pool long, score double, rank int")
        u = lists.union(lists.truncated(df, {}), 3).orderBy("s1", "pos_in_entity").collect()
        assert [(r["s1"], r["pool"]) for r in u] == [(0, 7), (0, 5), (0, 6), (1, 5)]
        assert (u[0]["best_rank"], u[0]["dense_rank"], u[0]["bm25_rank"], u[0]["n_retrievers"], u[1]["bm25_rank"]) == (0, 2, 0, 2, 9999)


@pytest.mark.parametrize("block", [7, 70, 4096])
def test_dense_in_blocks_equals_brute_force(spark, block):
    rng = random.Random(0)
    unit = lambda: [x / math.sqrt(sum(y * y for y in v)) for v in [[rng.gauss(0, 1) for _ in range(8)]] for x in v]
    q, p = [(i, unit(), i % 2) for i in range(20)], [(100 + i, unit(), i % 2) for i in range(90)]
    schema = "id long, vec array<double>, country int"
    got = retrieval.dense(spark.createDataFrame(q, schema), spark.createDataFrame(p, schema), 4, ["country"], block).collect()
    for i, v, c in q:
        best = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 6), j) for j, w, d in p if c == d)[:4]
        assert [(r["pool"], r["rank"]) for r in sorted((r for r in got if r["s1"] == i), key=lambda r: r["rank"])] == [(j, n) for n, (_, j) in enumerate(best)]
    rev = retrieval.dense_reverse(spark.createDataFrame(q, schema), spark.createDataFrame(p, schema), 3, ["country"], block)
    assert rev.count() == 270
    again = lists.truncated(rev.withColumn("retriever", F.lit("dense_rev")), {"dense_rev": 1})
    assert again.count() == 90 and all(r["m"] == 0 for r in again.groupBy("s1").agg(F.min("order_rank").alias("m")).collect())


def test_vectors(spark):
    rng = random.Random(1)
    v = [rng.gauss(0, 1) for _ in range(64)]
    df = spark.createDataFrame([(v,)], "v array<double>").select(vectors.unit(F.col("v")).alias("u"))
    r = df.select(similarity.cosine(F.col("u"), vectors.dequantized(vectors.quantized(F.col("u")))).alias("c"), vectors.norm(vectors.truncated(F.col("u"), 4)).alias("n"), vectors.norm(vectors.combined(vectors.truncated(F.col("u"), 32), vectors.truncated(F.col("u"), 16), 0.3)).alias("w")).first()
    assert r["c"] > 0.999 and r["n"] == pytest.approx(1) and r["w"] == pytest.approx(1)


def test_samples_are_nested(spark):
    ids = spark.range(20_000_000_001, 20_000_050_001)
    a, b = ({r["id"] for r in truth.sampled(ids, "id", s, 1).collect()} for s in (0.01, 0.02))
    assert a < b and 0.008 < len(a) / 50_000 < 0.012
    u = [r["u"] for r in ids.limit(3).select(hashing.uniform(F.col("id"), 1).alias("u")).collect()]

    def mix(x):
        z = (x + 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    key = (42 * 0x100000001B3 + 0x9E3779B1 + 12345) % 2**64
    assert u[0] == (mix(20_000_000_001 ^ key) >> 11) / 2**53


def submission(spark, matches, candidates):
    make = lambda rows: spark.createDataFrame([(n, s, i) for n, (s, i) in enumerate(rows)], "row_no long, s1 string, ids string")
    expected = spark.createDataFrame([(0, "S1-1"), (1, "S1-2")], "row_no long, s1 string")
    return validate.check_submission(make(matches), make(candidates), expected, spark.createDataFrame([("S2-10",), ("S3-11",), ("S2-12",)], "id string"))


def test_submission_checks(spark):
    good, cands = [("S1-1", "S2-10"), ("S1-2", "")], [("S1-1", "S2-10,S3-11"), ("S1-2", "S2-12")]
    submission(spark, good, cands)
    bad = [
        ([*good, ("S1-1", "")], cands), (good[:1], cands), ([("S1-1", "S2-99"), good[1]], cands), ([("S1-1", "S2-12"), good[1]], cands),
        (good[::-1], cands), ([("S1-1", "S2-10"), ("S1-2", "S2-10")], [cands[0], ("S1-2", "S2-10")]), ([("S1-1", "nan"), good[1]], cands),
    ]
    for m, c in bad:
        with pytest.raises(validate.SubmissionError):
            submission(spark, m, c)


def test_cap(spark):
    rng = random.Random(4)
    rows = {(rng.randrange(20), rng.randrange(500)): rng.random() for _ in range(600)}
    df = spark.createDataFrame([("dense", a, b, s) for (a, b), s in rows.items()], "retriever string, s1 long, pool long, score double").withColumn("rank", lists.rank_within(["s1"], "score", "pool"))
    u = lists.union(lists.truncated(df, {}), 7)
    assert u.groupBy("s1").count().agg(F.max("count")).first()[0] == 7 and u.agg(F.max("dense_rank")).first()[0] == 6


def test_countries_never_mix(spark):
    s1 = spark.createDataFrame([(0, "US"), (1, "India"), (2, "US"), (3, "France")], "id long, country string")
    pool = spark.createDataFrame([(0, "India"), (1, "US"), (2, "US"), (3, "France"), (4, "France")], "id long, country string")
    count = lambda rows: metrics.cross_country(spark.createDataFrame(rows, "s1 long, pool long"), s1, pool).first()["crossings"]
    assert count([(0, 1), (1, 0), (3, 3), (3, 4)]) == 0 and count([(0, 0), (1, 1)]) == 2
    assert truth.orphans(s1, pool.where("country <> 'France'")).count() == 1


def test_simplest_rule_wins():
    rows = [(rules.Rule("relative", 0.5, True), 0.9005), (rules.Rule(threshold=0.5), 0.9), (rules.Rule(threshold=0.6, exclusive=True), 0.899)]
    assert rules.simplest(rows, 0.001)[0].kind == "global" and rules.simplest(rows, 0)[0].kind == "relative"
    score = lambda r: -abs(r.threshold - 0.4) - abs(r.s3_threshold - 0.6)
    best, _ = rules.ascend(score, rules.Rule("per_source", 0.5, s3_threshold=0.5), [0.4, 0.5, 0.6])
    assert (best.threshold, best.s3_threshold) == (0.4, 0.6)
    assert rules.greedy(lambda r: float(r.exclusive), rules.Rule(), [{"exclusive": True}, {"guard": 0.5}])[0] == rules.Rule(exclusive=True)


def test_exclusive_keeps_each_pool_record_once(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(30), p, round(rng.random(), 2), p % 2, 0) for p in range(40) for _ in range(3)]
    df = spark.createDataFrame(rows, "s1 long, pool long, p double, is_s3 int, y int").dropDuplicates(["s1", "pool"])
    for r in (rules.Rule(threshold=0.3, exclusive=True), rules.Rule("relative", 0.3, True)):
        assert rules.keep(df, r).groupBy("pool").count().agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize(("name", "core", "suffix"), [("smith & sons ltd", "smith and sons", "ltd"), ("ltd", "ltd", ""), ("trust bank co", "trust bank", "co"), ("", "", "")])
def test_suffix(spark, name, core, suffix):
    c, s = names.strip_suffix(F.col("n"))
    assert (one(spark, c, n=name), one(spark, s, n=name)) == (core, suffix)


@pytest.mark.parametrize(("country", "address", "code"), [("US", "12345 main st", ""), ("US", "1 main st, ny 10001-1234", "10001"), ("India", "mg road 560 001", "560001"), ("France", "75001 paris", "75001"), ("Spain", "28001", "")])
def test_postcode(spark, country, address, code):
    assert one(spark, geo.postcode(F.col("a"), F.col("c")), a=address, c=country) == code


def test_small_functions(spark):
    assert one(spark, geo.house_number(F.col("a"), F.col("p")), a="560 mg road 560 001", p="560001") == ""
    assert one(spark, names.non_latin(F.col("a")), a="दिल्ली") is True and one(spark, names.non_latin(F.col("a")), a="é") is False
    assert one(spark, similarity.soft_equal(F.col("a"), F.col("b")), a="", b="x") == 0.5
    assert one(spark, geo.country(F.col("a")), a=" U.S.A. ") == "US" and one(spark, geo.strip_accents(F.col("a")), a="Élan") == "Elan"
    df = spark.createDataFrame([(1, "12 park st, kolkata, wb", "India"), (2, None, "India")], "id long, addr string, country string")
    assert {r["id"]: r["region"] for r in geo.region(df, "id", "addr", "country", geo.region_table(spark)).collect()} == {1: "west bengal", 2: ""}


def test_fuzzy():
    assert similarity.ratio_of("", "") == 100 and similarity.ratio_of("abcd", "abxd") == 75
    assert similarity.partial_of("abc", "xxabcxx") == 100 and similarity.token_set_of("a b c", "c b a d") == 100 and similarity.token_set_of("", "a") == 0
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and similarity.jaro_winkler_of("", "") == 1

    def lcs(a, b):
        return max(len(s) for n in range(len(a) + 1) for s in combinations(a, n) if iter_in(s, b))

    def iter_in(s, b):
        it = iter(b)
        return all(c in it for c in s)

    rng = random.Random(7)
    for _ in range(50):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == lcs(a, b)


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "train"
    p.mkdir()
    (p / "source1.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted\t\tUS\nS1-2\tB\tC\tIndia\n')
    path = scans.locate(spark, str(tmp_path), "train", "source1.tsv")
    df = scans.checked_tsv(spark, path)
    assert [tuple(r) for r in df.orderBy("entity_id").collect()][0] == ("S1-1", '"Quoted', "", "US")
    assert scans.view(df).first()["name_clean"] == '"quoted' and [r["id"] for r in scans.ids(df).orderBy("id").collect()] == [10_000_000_001, 10_000_000_002]
    out = f"{tmp_path}/out"
    made = sinks.checkpointed(spark, out, "abc", lambda: df)
    assert made.count() == 2 and sinks.done(spark, out, "abc") and not sinks.done(spark, out, "xyz")
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "row_no long, vec array<double>")
    sinks.vector_chunks(vec.where("row_no < 4"), f"{tmp_path}/vec", 2, 2)
    assert scans.missing_chunks(spark, f"{tmp_path}/vec", [0, 1, 2, 3]) == [2, 3]
    sinks.vector_chunks(vec, f"{tmp_path}/vec", 2, 2)
    assert scans.vector_store(spark, f"{tmp_path}/vec", 2, 7).count() == 7
    with pytest.raises(ValueError):
        sinks.vector_chunks(vec, f"{tmp_path}/vec", 2, 3)
    with pytest.raises(ValueError):
        scans.vector_store(spark, f"{tmp_path}/vec", 5)
    ids = spark.createDataFrame([(1, "b", ""), (0, "a", "x,y")], "row_no long, s1 string, ids string")
    sinks.submission(ids, f"{tmp_path}/sub", "matched_entity_ids")
    rows = [tuple(r) for r in spark.read.csv(f"{tmp_path}/sub", sep="\t", header=True, emptyValue="", nullValue="\0").collect()]
    assert sorted(rows, key=str) == [("a", "x,y"), ("b", None)] or sorted(rows) == [("a", "x,y"), ("b", "")]


def test_every_file_of_a_folder_has_a_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("source1_entity_id\tmatched_entity_ids\n1\t2, 3\n")
    (tmp_path / "b.tsv").write_text("source1_entity_id\tmatched_entity_ids\n4\t\n5\t6\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tmatched_entity_ids\n")
    got = scans.read_truth(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("1", "2, 3"), ("4", ""), ("5", "6")]

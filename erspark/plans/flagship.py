"""The flagship plan: exact, BM25 and dense candidates of the record view, united with provenance and capped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.functions import names
from erspark.operators import lists, retrieval
from erspark.plans.fixtures import rec, vec


def candidates(spark: SparkSession, sf: str, cap: int = 20) -> DataFrame:
    r = rec(spark, sf).drop("text")
    core, _ = names.strip_suffix(F.col("name"))
    r = r.withColumn("key", F.when(F.length(core) >= 3, F.concat_ws("|", "country", core)).otherwise(F.lit("")))
    q, p = r.where("src = 1"), r.where("src > 1").withColumn("pool_source", F.concat(F.lit("S"), F.col("src").cast("string")))
    exact = retrieval.exact_key(q, p, "key").select(F.lit("exact_name").alias("retriever"), "s1", "pool", "score", "rank")
    found = retrieval.bm25_topk(q, p.drop("pool_source"), 10, {"n": "name", "a": "addr"}, {"n": 2.0, "a": 1.0}, ["country"])
    bm25 = found.select(F.lit("bm25").alias("retriever"), "s1", "pool", "score", "rank")
    v = vec(spark, sf).select("id", "vec").join(r.select("id", "src", "country"), "id")
    dense = retrieval.dense(v.where("src = 1"), v.where("src > 1"), 10, ["country"]).select(F.lit("dense").alias("retriever"), "s1", "pool", "score", "rank")
    return lists.union(lists.truncated(exact.unionByName(bm25).unionByName(dense), {}), cap, ("dense", "bm25", "exact_name"))

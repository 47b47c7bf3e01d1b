"""Truth tables, nested samples and folds."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erspark.functions.hashing import uniform


def explode(truth: DataFrame, entity: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(s1, pool) pairs of comma-separated lists; an empty list has none."""
    return truth.where(F.col(ids) != "").select(F.col(entity).alias("s1"), F.explode(F.split(ids, r",\s*")).alias("pool"))


def build(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs both of whose sides exist, and n_true of every entity, zeros included."""
    known = pairs.join(s1.select(F.col("id").alias("s1")), "s1", "left_semi").join(pool.select(F.col("id").alias("pool")), "pool", "left_semi")
    n = known.groupBy("s1").agg(F.count("*").alias("n_true"))
    return known, s1.select(F.col("id").alias("s1")).join(n, "s1", "left").na.fill(0, ["n_true"])


def owner(pairs: DataFrame) -> DataFrame:
    """The entity that owns each matched pool record; a record with two owners raises."""
    df = pairs.groupBy("pool").agg(F.min("s1").alias("s1"), F.count_distinct("s1").alias("n"))
    return df.select("pool", F.when(F.assert_true(F.col("n") == 1, F.lit("a pool record has two owners")).isNull(), F.col("s1")).alias("s1"))


def sampled(df: DataFrame, key: str, share: float, salt: int) -> DataFrame:
    return df if share >= 1 else df.where(uniform(F.col(key), salt) < share)


def first_by_hash(df: DataFrame, key: str, n: int, salt: int) -> DataFrame:
    """n rows in the order of their hash: the same ones on every run."""
    return df.orderBy(uniform(F.col(key), salt), key).limit(n)


def training_sample(s1: DataFrame, pool: DataFrame, pairs: DataFrame, share: float, distractors: float, salt: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sampled entities; and all their matches with a share of other pool records, flagged samp_match and samp_dist."""
    some = sampled(s1, "id", share, salt)
    match = pairs.join(some.select(F.col("id").alias("s1")), "s1", "left_semi").select(F.col("pool").alias("id"), F.lit(1).alias("samp_match")).distinct()
    df = pool.join(match, "id", "left").na.fill(0, ["samp_match"]).withColumn("samp_dist", (uniform(F.col("id"), salt + 1) < distractors).cast("int"))
    return some, df.where("samp_match = 1 or samp_dist = 1")


def mixed_sample(pairs: DataFrame, key: str, negatives: int, replay: int, salt: int = 5) -> DataFrame:
    """All positives, so many negatives, and so many pairs of the band again, each picked by hash."""
    df = pairs.withColumn("_u", uniform(F.col(key), salt))
    neg = df.where("y = 0").orderBy("_u", *pairs.columns).limit(negatives)
    again = df.where(F.col("p").between(0.05, 0.95)).orderBy(F.desc("_u"), *pairs.columns).limit(replay)
    return df.where("y = 1").unionByName(neg).unionByName(again).drop("_u")


def folds(entity: Column, share_train: float = 0.2, holdout: float = 0.12, n: int = 5) -> Column:
    """-3 evaluation, -1 holdout, 0 to n - 1 for cross-validation, from the entity's hash."""
    train, inner = uniform(entity, 11), uniform(entity, 12)
    return F.when(train >= share_train, F.lit(-3)).when(inner < holdout, F.lit(-1)).otherwise(F.least(F.floor((inner - holdout) / (1 - holdout) * n), F.lit(n - 1)).cast("int"))


def negatives_weight(y: Column, key: Column, keep: float, salt: int = 13) -> Column:
    """1 for positives and a share of negatives, else 0."""
    return F.when((y == 1) | (uniform(key, salt) < keep), F.lit(1.0)).otherwise(F.lit(0.0))


def leaks(pairs: DataFrame, fold: str = "fold") -> DataFrame:
    """Pool records that are positives of entities in several folds."""
    return pairs.where("y = 1").groupBy("pool").agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def country_invariant(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """combos of countries over true pairs, and which of them cross."""
    j = pairs.join(s1.select(F.col("id").alias("s1"), F.col("country").alias("c1")), "s1").join(pool.select(F.col("id").alias("pool"), F.col("country").alias("c2")), "pool")
    return j.groupBy("c1", "c2").agg(F.count("*").alias("n")).withColumn("crosses", (F.col("c1") != F.col("c2")).cast("int"))


def orphans(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Queries whose country has no pool record."""
    return s1.join(pool.select("country").distinct(), "country", "left_anti")


def split_half(ids: Column, salt: str, share: float = 0.25) -> Column:
    """1 for the entities that a second model is fitted on, 0 for those that it is reported on: id times an odd constant plus
    the first eight bytes of the salt's SHA-256, modulo 2**64, as a uniform number."""
    start = np.frombuffer(hashlib.sha256(salt.encode()).digest()[:8], np.uint64)[0]

    @F.pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            z = x.to_numpy("int64").view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start
        return pd.Series(((z >> np.uint64(11)).astype(np.float64) / 2.0**53 < share).astype("int32"))

    return run(ids)


def fit_texts(records: DataFrame, split: str, source: str, key: str, total: int, salt: int = 17) -> DataFrame:
    """Rows to fit a vocabulary on: half of ``total`` from each of two splits, an equal share of that from each source, fewer
    where a source has fewer. Picked by hash, so a run picks the same."""
    sources = records.select(split, source).distinct().groupBy(split).agg(F.count("*").alias("_n"))
    splits = sources.count()
    order = Window.partitionBy(split, source).orderBy(uniform(F.col(key), salt), key)
    ranked = records.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= total // max(1, splits))
    return ranked.join(F.broadcast(sources), split).where(F.col("_r") <= F.floor(F.lit(total // max(1, splits)) / F.col("_n"))).drop("_r", "_n")


def leakage(pairs: DataFrame, fold: str = "fold") -> DataFrame:
    """what, n: entities in several folds, held-out entities among those trained on, and matched pool records that folds share."""
    by = pairs.groupBy("s1").agg(F.count_distinct(fold).alias("folds"), F.min(fold).alias("low"), F.max(fold).alias("high"))
    checks = [
        ("entities in several folds", by.where("folds > 1")),
        ("holdout entities in training", by.where("low < 0 and high >= 0")),
        ("positives shared by folds", leaks(pairs, fold)),
    ]
    out = None
    for what, bad in checks:
        row = bad.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out

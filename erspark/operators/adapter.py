"""A learned projection of two vector spaces into one, and what its lists find.

Each tower is the identity plus a linear map, fitted in closed form: the ridge regression from a vector to those of its true
partners. It takes two sums of outer products, so one pass over the pairs fits both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.functions import similarity


@dataclass(frozen=True)
class Towers:
    query: np.ndarray
    pool: np.ndarray


def _joined(queries: DataFrame, pool: DataFrame, pairs: DataFrame) -> DataFrame:
    q = queries.select(F.col("id").alias("s1"), F.col("vec").alias("qv"))
    return pairs.join(q, "s1").join(pool.select(F.col("id").alias("pool"), F.col("vec").alias("pv")), "pool")


def fit(queries: DataFrame, pool: DataFrame, pairs: DataFrame, ridge: float = 1.0, most: int = 500_000, tasks: int = 16) -> Towers:
    """Both towers from at most ``most`` true pairs, picked by hash; each of ``tasks`` tasks hands on three d x d sums."""
    some = _joined(queries, pool, pairs).orderBy(F.xxhash64("s1", "pool"), "s1", "pool").limit(most).select("qv", "pv").repartition(tasks)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                q, p = (np.stack(c.to_pylist()).astype(np.float64) for c in b.columns)
                part = np.stack([q.T @ q, q.T @ p, p.T @ p])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    rows = some.mapInArrow(sums, "s array<double>").collect()  # ``tasks`` rows
    if not rows:
        raise ValueError("no true pairs to fit on")
    flat = np.sum([r["s"] for r in rows], axis=0)
    d = int((len(flat) / 3) ** 0.5)
    qq, qp, pp = flat.reshape(3, d, d)
    eye = np.eye(d)
    return Towers(eye + np.linalg.solve(qq + ridge * eye, qp), eye + np.linalg.solve(pp + ridge * eye, qp.T))


def project(records: DataFrame, tower: np.ndarray) -> DataFrame:
    """``records`` with ``vec`` projected to length 1; the tower travels as a broadcast of d x d numbers."""
    shared = records.sparkSession.sparkContext.broadcast(tower)
    at = records.columns.index("vec")
    out = records.withColumn("vec", F.col("vec").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(at).to_pylist()).astype(np.float64) @ shared.value
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(x.tolist(), pa.list_(pa.float64())), *b.columns[at + 1 :]], b.schema.names)

    return out.mapInArrow(run, out.schema)


def pair_cosine(queries: DataFrame, pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """cos: the mean cosine of the pairs."""
    return _joined(queries, pool, pairs).agg(F.round(F.avg(similarity.cosine(F.col("qv"), F.col("pv"))), 6).alias("cos"))


def recall(own: DataFrame, old: DataFrame, pairs: DataFrame, countries: DataFrame, depths: list[int]) -> DataFrame:
    """country, k, n_true, recall of the adapter's list, recall of it beside the old list, true pairs that only it has."""
    t = pairs.join(countries, "s1")
    t = t.join(own.select("s1", "pool", F.col("rank").alias("mine")), ["s1", "pool"], "left").join(old.select("s1", "pool", F.lit(1).alias("there")), ["s1", "pool"], "left")
    each = t.withColumn("k", F.explode(F.array(*[F.lit(k) for k in depths])))
    hit, there = F.coalesce(F.col("mine") < F.col("k"), F.lit(False)), F.col("there").isNotNull()
    n = F.count("*")
    return each.groupBy("country", "k").agg(n.alias("n_true"), F.round(F.count_if(hit) / n, 6).alias("recall"), F.round(F.count_if(hit | there) / n, 6).alias("recall_union"), F.count_if(hit & ~there).alias("newly_found"))

"""Retrievers: each takes queries and a pool and returns a ranked list (s1, pool, score, rank from 0).

Nothing crosses a bucket (country, and pool source where lists are kept apart), so buckets are the join keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erspark.functions import similarity


def ranked(pairs: DataFrame, per: list[str], k: int, score: str = "score", tie: str = "pool") -> DataFrame:
    """The k best pairs of each group by score, ties by id; a partial limit runs before the shuffle."""
    order = Window.partitionBy(*per).orderBy(F.desc(score), tie)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


# The exact keys, and those whose candidates are ranked by address; the others are ranked by name.
EXACT_KINDS = ("exact_name", "exact_sorted_city", "exact_postcode", "exact_house_city")
BY_ADDRESS = ("exact_name", "exact_sorted_city")


def exact_key_value(kind: str) -> Column:
    """The key of a record (columns country, name_core, name_sorted, city, postcode, house), empty if a part is missing."""
    c, name, sort, city, code, house = (F.col(x) for x in ("country", "name_core", "name_sorted", "city", "postcode", "house"))
    first = F.split_part(name, F.lit(" "), F.lit(1))
    parts = {"exact_name": (F.length(name) >= 3, [name]), "exact_sorted_city": ((sort != "") & (city != ""), [city, sort]), "exact_postcode": ((code != "") & (first != ""), [code, first]), "exact_house_city": ((house != "") & (city != ""), [city, house])}
    ok, own = parts[kind]
    return F.when(ok, F.concat_ws("|", c, *own)).otherwise(F.lit(""))


def exact_key(queries: DataFrame, pool: DataFrame, key: str, k: int = 5, most_pool: int = 200, most_pairs: int = 20_000, score: Column | None = None) -> DataFrame:
    """Equi-join on a derived key with a guard against oversized blocks; ranked per query and pool source.

    Both sides have columns id, ``key`` and addr (compared by token set), the pool has pool_source too. Empty keys never
    join. A block counts if it has at most ``most_pool`` pool rows and ``most_pairs`` pairs; sizes are aggregated and
    joined before any pair is made, so a skewed key costs a row.
    """
    sizes = pool.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("np"))
    sizes = sizes.join(queries.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("nq")), key)
    fine = sizes.where((F.col("np") <= most_pool) & (F.col("nq") * F.col("np") <= most_pairs)).select(key)
    q = queries.join(fine, key, "left_semi").select(key, F.col("id").alias("s1"), F.col("addr").alias("qa"))
    p = pool.join(fine, key, "left_semi").select(key, F.col("id").alias("pool"), "pool_source", F.col("addr").alias("pa"))
    pairs = q.join(p, key).withColumn("score", F.round(similarity.token_set_ratio("qa", "pa") / 100 if score is None else score, 6))
    return ranked(pairs.select("s1", "pool", "pool_source", "score"), ["s1", "pool_source"], k)


def block_stats(queries: DataFrame, pool: DataFrame, key: str, most_pool: int = 200, most_pairs: int = 20_000) -> DataFrame:
    """shared_keys, skipped_blocks, pairs_before_topk, queries_with_key, queries_in_skipped of an exact key."""
    sizes = pool.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("np"))
    sizes = sizes.join(queries.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("nq")), key)
    fine = (F.col("np") <= most_pool) & (F.col("nq") * F.col("np") <= most_pairs)
    return sizes.agg(
        F.count("*").alias("shared_keys"),
        F.count_if(~fine).alias("skipped_blocks"),
        F.coalesce(F.sum(F.when(fine, F.col("nq") * F.col("np"))), F.lit(0)).alias("pairs_before_topk"),
        F.coalesce(F.sum("nq"), F.lit(0)).alias("queries_with_key"),
        F.coalesce(F.sum(F.when(~fine, F.col("nq"))), F.lit(0)).alias("queries_in_skipped"),
    )


def dense(queries: DataFrame, pool: DataFrame, k: int, bucket: list[str], block: int = 16_384, per: list[str] | None = None) -> DataFrame:
    """Exact k nearest by inner product inside each bucket: blocks of matrix products, then a merge of their best.

    Both sides have id, vec and the bucket's columns. Pool rows are dealt to hash blocks of about ``block`` rows by the
    size of their bucket, query rows likewise, and a task multiplies one query block with one pool block, so no task holds
    a bucket; a vector travels once for each block of the other side. It keeps k of each query from each pool block, a slice
    of queries at a time; a window merges those.
    """
    def blocked(df: DataFrame) -> DataFrame:
        n = df.groupBy(*bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        return df.join(n, bucket).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    q, p = blocked(queries.select("id", "vec", *bucket)), blocked(pool.select("id", "vec", *bucket))
    sizes = q.groupBy(*bucket).agg(F.first("blocks").alias("qn")).join(p.groupBy(*bucket).agg(F.first("blocks").alias("pn")), bucket)
    q = q.join(sizes, bucket).select(*bucket, F.col("mine").alias("i"), F.explode(F.sequence(F.lit(0), F.col("pn") - 1)).alias("j"), "id", "vec")
    p = p.join(sizes, bucket).select(*bucket, F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("i"), F.col("mine").alias("j"), "id", "vec")

    more = [c for c in per or () if c != "s1"]  # bucket columns that lists are kept apart by

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"s1": pd.Series(dtype="int64"), "pool": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), **{c: pd.Series(dtype="object") for c in more}})
        b = b.sort_values("p_id", kind="stable")
        right, parts = np.stack(b["p_vec"]).astype(np.float64).T, []
        for at in range(0, len(a), 1024):
            scores = np.round(np.stack(a["q_vec"].iloc[at : at + 1024]).astype(np.float64) @ right, 6)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(top)), top.shape[1])
            parts.append((a["q_id"].to_numpy()[at + rows], b["p_id"].to_numpy()[top.ravel()], scores[rows, top.ravel()]))
        s1, found, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"s1": s1, "pool": found, "score": score, **{c: a[f"q_{c}"].iloc[0] for c in more}})

    keys = [*bucket, "i", "j"]
    q, p = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns]) for side, df in (("q", q), ("p", p)))
    pairs = q.groupBy(*[f"q_{c}" for c in keys]).cogroup(p.groupBy(*[f"p_{c}" for c in keys])).applyInPandas(best, "s1 long, pool long, score double" + "".join(f", {c} {queries.schema[c].dataType.simpleString()}" for c in more))
    return ranked(pairs, ["s1", *more], k)


def dense_reverse(queries: DataFrame, pool: DataFrame, k: int, bucket: list[str], block: int = 16_384) -> DataFrame:
    """Each pool record's k nearest queries, oriented (s1, pool); ``rank`` is the pool's view of them."""
    return dense(pool, queries, k, bucket, block).select(F.col("pool").alias("s1"), F.col("s1").alias("pool"), "score", "rank")


def term_table(records: DataFrame, fields: dict[str, str], keep: list[str]) -> DataFrame:
    """id, *keep, dl, token, tf: the tokens of each field (``fields`` maps a prefix to a column), and the record's length."""
    df = records.select("id", *keep, _tokens(fields).alias("tokens")).withColumn("dl", F.size("tokens"))
    return df.select("id", *keep, "dl", F.explode("tokens").alias("token")).groupBy("id", *keep, "dl", "token").agg(F.count("*").alias("tf"))


def _tokens(fields: dict[str, str]) -> Column:
    """The tokens of all fields, each with its field's prefix."""
    find = lambda c: F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)
    return F.concat(*[F.transform(find(c), _prefixer(f)) for f, c in fields.items()])


def _prefixer(field: str):
    return lambda t: F.concat(F.lit(field + ":"), t)


def bm25(queries: DataFrame, pool: DataFrame, k: int, fields: dict[str, str], weights: dict[str, float], bucket: list[str], k1: float = 1.2, b: float = 0.75, prune_floor: int = 50, prune_share: float = 0.002) -> DataFrame:
    """BM25 of query tokens (binary, weighed by field) against pool records; statistics are per bucket.

    Tokens in more than max(prune_floor, prune_share x N) records of a bucket are pruned before the join, which bounds
    what one token can match. One shuffle on (bucket, token), one on the pair, one on the query.
    """
    docs = term_table(pool, fields, bucket)
    lengths = pool.groupBy(*bucket).agg(F.count("*").alias("n"), (F.sum(F.size(_tokens(fields))) / F.count("*")).alias("avgdl"))
    df = docs.groupBy(*bucket, "token").agg(F.count("*").alias("df")).join(lengths, bucket)
    df = df.where(F.col("df") <= F.greatest(F.lit(prune_floor), F.col("n") * prune_share)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = docs.join(df, [*bucket, "token"]).select(*bucket, "token", F.col("id").alias("pool"), w.alias("w"))
    q = term_table(queries, fields, [c for c in bucket if c in queries.columns]).select(*[c for c in bucket if c in queries.columns], "token", F.col("id").alias("s1"))
    field_weight = F.lit(0.0)
    for f, x in weights.items():
        field_weight = F.when(F.col("token").startswith(f + ":"), F.lit(x)).otherwise(field_weight)
    pairs = q.withColumn("qw", field_weight).join(weighed, [*[c for c in bucket if c in queries.columns], "token"])
    return pairs.groupBy("s1", "pool", *[c for c in bucket if c not in queries.columns]).agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))


def bm25_topk(queries: DataFrame, pool: DataFrame, k: int, fields: dict[str, str], weights: dict[str, float], bucket: list[str], **how) -> DataFrame:
    return ranked(bm25(queries, pool, k, fields, weights, bucket, **how), ["s1"], k)


def prefix_merge(cached: DataFrame, extra: DataFrame, head: int = 10) -> DataFrame:
    """The cached list's first ``head`` places as they are, then the other list's new pairs in its order."""
    first = cached.where(F.col("rank") < head)
    more = extra.join(first.select("s1", "pool"), ["s1", "pool"], "left_anti").where(F.col("rank") >= 0)
    order = Window.partitionBy("s1").orderBy("late", "rank", "pool")
    both = first.select("s1", "pool", "score", "rank", F.lit(0).alias("late")).unionByName(more.select("s1", "pool", "score", "rank", F.lit(1).alias("late")))
    return both.withColumn("rank", F.row_number().over(order) - 1).drop("late")

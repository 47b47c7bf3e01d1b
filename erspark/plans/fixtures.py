"""Record-linkage views of the test tables, each as a DataFrame and as the SQL of a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REC = """rec AS (SELECT doc_id AS id, CAST(1 + doc_id % 3 AS INT) AS src, concat('S', 1 + doc_id % 3, '-', doc_id) AS entity_id,
  array_to_string(w[1:4], ' ') AS name, array_to_string(w[5:14], ' ') AS addr, lang AS country, text
  FROM (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda x: x <> '') AS w FROM documents))"""
PAIR = """pair AS (SELECT l_orderkey AS s1, l_partkey AS pool, round(max(l_quantity) / 50, 6) AS p,
  CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS y, CAST(max(l_suppkey % 2) AS INT) AS is_s3,
  max(l_extendedprice) AS price, max(l_discount) AS discount FROM lineitem GROUP BY 1, 2)"""
ENTITY = "entity AS (SELECT s1, CAST(sum(y) AS BIGINT) AS n_true FROM pair GROUP BY s1)"
LISTS = """lists AS (
  SELECT 'dense' AS retriever, s1, pool, p AS score, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, pool) - 1 AS rank, y FROM pair
  UNION ALL SELECT 'bm25', s1, pool, price, row_number() OVER (PARTITION BY s1 ORDER BY price DESC, pool) - 1, y FROM pair
  UNION ALL SELECT * FROM (SELECT 'dense_rev' AS retriever, s1, pool, p AS score, row_number() OVER (PARTITION BY pool ORDER BY p DESC, s1) - 1 AS rank, y FROM pair) WHERE rank < 3
  UNION ALL SELECT * FROM (SELECT 'exact_name' AS retriever, s1, pool, discount AS score, row_number() OVER (PARTITION BY s1 ORDER BY discount DESC, pool) - 1 AS rank, y FROM pair) WHERE rank < 2)"""
ORDERED = """ordered AS (SELECT *, CASE WHEN retriever = 'dense_rev' THEN row_number() OVER (PARTITION BY retriever, s1 ORDER BY score DESC, pool) - 1 ELSE rank END AS order_rank FROM lists)"""
VEC = "vec AS (SELECT vec_id AS id, embedding AS vec, CAST(vec_id % 3 AS INT) AS role, CAST(label % 3 AS INT) AS country, label FROM embeddings)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rec(spark: SparkSession, sf: str) -> DataFrame:
    # A record's name and address are the first 14 words: no more of a text is split than holds them.
    first = F.filter(F.slice(F.split(F.ltrim(F.lower("text"), F.lit(" \n")), "[ \n]+", 15), 1, 14), lambda x: x != "")
    d = table(spark, sf, "documents").select("doc_id", "lang", "text", first.alias("w"))
    src = (1 + F.col("doc_id") % 3).cast("int")
    return d.select(F.col("doc_id").alias("id"), src.alias("src"), F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.array_join(F.slice("w", 1, 4), " ").alias("name"), F.array_join(F.slice("w", 5, 10), " ").alias("addr"), F.col("lang").alias("country"), "text")


def pair(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """``dealt``: dealt out by s1 before they are aggregated, so that windows over s1 move them no more."""
    lines = table(spark, sf, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return (
        (lines.repartition("l_orderkey") if dealt else lines)
        .groupBy(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("pool"))
        .agg(F.round(F.max("l_quantity") / 50, 6).alias("p"), F.max("returned").alias("y"), F.max((F.col("l_suppkey") % 2).cast("int")).alias("is_s3"), F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"))
    )


def entity(spark: SparkSession, sf: str) -> DataFrame:
    return pair(spark, sf).groupBy("s1").agg(F.sum("y").alias("n_true"))


def lists(spark: SparkSession, sf: str) -> DataFrame:
    p = pair(spark, sf)

    def one(name: str, score: str, by: str, tie: str, depth: int | None) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
        df = p.withColumn("rank", rank)
        df = df.where(F.col("rank") <= depth) if depth else df
        return df.select(F.lit(name).alias("retriever"), "s1", "pool", F.col(score).alias("score"), (F.col("rank") - 1).cast("long").alias("rank"), "y")

    return one("dense", "p", "s1", "pool", None).unionByName(one("bm25", "price", "s1", "pool", None)).unionByName(one("dense_rev", "p", "pool", "s1", 3)).unionByName(one("exact_name", "discount", "s1", "pool", 2))


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 3).cast("int").alias("role"), (F.col("label") % 3).cast("int").alias("country"), "label")

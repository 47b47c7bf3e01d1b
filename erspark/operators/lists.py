"""Ranked lists, their union into candidates, and ranks and gaps within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABSENT = 9999
RETRIEVERS = ("dense", "dense_global", "dense_rev", "bm25", "tfidf", "exact_name", "exact_sorted_city", "exact_postcode", "exact_house_city")


def rank_within(group: list[str], score: str, tie: str) -> Column:
    """Rank from 0 by score, high to low, ties by id."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), tie)) - 1


def position(group: list[str], rank: str, score: str, tie: str) -> Column:
    """Place from 0 by rank and then score."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(rank, F.desc(score), tie)) - 1


def gap_to_best(value: str, group: list[str]) -> Column:
    return F.max(value).over(Window.partitionBy(*group)) - F.col(value)


def relative_to_best(value: str, group: list[str]) -> Column:
    best = F.max(value).over(Window.partitionBy(*group))
    return F.when(best > 0, F.col(value) / best).otherwise(F.lit(0.0))


def truncated(lists: DataFrame, depth: dict[str, int], reverse: tuple[str, ...] = ("dense_rev",)) -> DataFrame:
    """Lists down to a depth for each retriever, with ``order_rank``: for reverse lists the rank from the query's side."""
    limit = F.lit(None).cast("int")
    for r, k in depth.items():
        limit = F.when(F.col("retriever") == r, F.lit(k)).otherwise(limit)
    kept = lists.where(F.col("rank") < F.coalesce(limit, F.lit(1 << 30)))
    mine = F.row_number().over(Window.partitionBy("retriever", "s1").orderBy(F.desc("score"), "pool")) - 1
    return kept.withColumn("order_rank", F.when(F.col("retriever").isin(*reverse), mine).otherwise(F.col("rank")))


def best_rank_only(lists: DataFrame) -> DataFrame:
    """One row for each pair: that with the lowest rank."""
    order = Window.partitionBy("s1", "pool").orderBy("rank", F.desc("score"), "retriever")
    return lists.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def union(lists: DataFrame, cap: int = 120, retrievers: tuple[str, ...] = RETRIEVERS) -> DataFrame:
    """One row for each pair over all lists, with every retriever's score, rank and flag, capped by position in its query.

    ``lists`` has retriever, s1, pool, score, rank and order_rank. One shuffle on the pair and one on the query; a pair has
    as many rows as it has retrievers, so no group is large.
    """
    cols = []
    for r in retrievers:
        here = F.col("retriever") == r
        best = F.min(F.when(here, F.struct(F.col("rank").alias("rank"), (-F.col("score")).alias("neg"))))
        cols += [best.alias(f"_{r}"), F.min(F.when(here, F.col("order_rank"))).alias(f"_o_{r}")]
    wide = lists.groupBy("s1", "pool").agg(*cols, F.min("order_rank").alias("best_rank"))
    out = wide.select(
        "s1", "pool", "best_rank",
        *[F.coalesce(-F.col(f"_{r}.neg"), F.lit(0.0)).alias(f"{r}_score") for r in retrievers],
        *[F.coalesce(F.col(f"_{r}.rank"), F.lit(ABSENT)).alias(f"{r}_rank") for r in retrievers],
        *[F.col(f"_{r}").isNotNull().cast("int").alias(f"by_{r}") for r in retrievers],
    )
    out = out.withColumn("n_retrievers", sum((F.col(f"by_{r}") for r in retrievers[1:]), F.col(f"by_{retrievers[0]}")))
    fallback = F.when(F.col("by_dense_global") == 1, F.col("dense_global_score")) if "dense_global" in retrievers else F.lit(None).cast("double")
    dense = F.coalesce(F.when(F.col("by_dense") == 1, F.col("dense_score")), fallback, F.lit(-1.0)) if "dense" in retrievers else F.lit(-1.0)
    order = Window.partitionBy("s1").orderBy("best_rank", F.desc("n_retrievers"), dense.desc(), "pool")
    return out.withColumn("pos_in_entity", F.row_number().over(order)).where(F.col("pos_in_entity") <= cap).withColumn("pos_in_entity", F.col("pos_in_entity") - 1)


def entity_context(pairs: DataFrame, band: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """Rank by p in the entity, its best and second p, pairs in the uncertain band, and the gap to the best."""
    by_p = Window.partitionBy("s1").orderBy(F.desc("p"), "pool")
    whole = Window.partitionBy("s1")
    ranked = pairs.withColumn("rk", F.row_number().over(by_p) - 1)
    return (
        ranked.withColumn("p1", F.max("p").over(whole))
        .withColumn("p2", F.coalesce(F.max(F.when(F.col("rk") == 1, F.col("p"))).over(whole), F.lit(0.0)))
        .withColumn("n_band", F.count_if(F.col("p").between(*band)).over(whole))
        .withColumn("gap", F.col("p1") - F.col("p"))
    )


def pool_best(pairs: DataFrame) -> DataFrame:
    """``is_best``: whether a pair is its pool record's best one by p, ties to the lower query."""
    order = Window.partitionBy("pool").orderBy(F.desc("p"), "s1")
    return pairs.withColumn("is_best", (F.row_number().over(order) == 1).cast("int"))


def mutual_top(rank_a: str, rank_b: str, k: int = 5) -> Column:
    return ((F.col(rank_a) < k) & (F.col(rank_b) < k)).cast("int")


def cluster_features(pairs: DataFrame, vectors: DataFrame, near: float = 0.9) -> DataFrame:
    """Similarity of each candidate to its entity's three most confident others: cl_cos_top1, cl_cos_max3, cl_cos_wmax3,
    cl_name_top1, cl_addr_top1, cl_is_top3, cl_n_near. A vector's first half is the name's and its second half the address's:
    their products with the most confident one's halves are not scaled to length 1. ``pairs`` has s1, pool, p and is_new; a new candidate fills a place only after the existing ones
    and weighs nothing. ``vectors`` has id and vec."""
    order = Window.partitionBy("s1").orderBy("is_new", F.desc("p"), "pool")
    top = pairs.withColumn("slot", F.row_number().over(order)).where("slot <= 3")
    top = top.select("s1", "slot", F.col("pool").alias("t"), F.when(F.col("is_new") == 1, F.lit(0.0)).otherwise(F.col("p")).alias("w")).join(vectors.select(F.col("id").alias("t"), F.col("vec").alias("tv")), "t")
    mine = pairs.join(vectors.select(F.col("id").alias("pool"), "vec"), "pool")
    both = mine.join(top, "s1", "left")
    half = F.floor(F.size("vec") / 2).cast("int")

    def product(x: Column, y: Column) -> Column:
        dot = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, a: s + a)
        return F.when(F.col("t") != F.col("pool"), F.round(dot, 6))

    name = product(F.slice("vec", F.lit(1), half), F.slice("tv", F.lit(1), half))
    addr = product(F.slice("vec", half + 1, F.size("vec") - half), F.slice("tv", half + 1, F.size("vec") - half))
    first = F.col("slot") == 1
    both = both.withColumns({"cos": product(F.col("vec"), F.col("tv")), "name": F.when(first, name), "addr": F.when(first, addr)})
    return both.groupBy("s1", "pool").agg(
        F.max(F.when(F.col("slot") == 1, F.col("cos"))).alias("cl_cos_top1"),
        F.coalesce(F.max("cos"), F.lit(-1.0)).alias("cl_cos_max3"),
        F.coalesce(F.max(F.col("cos") * F.col("w")), F.lit(-1.0)).alias("cl_cos_wmax3"),
        F.max("name").alias("cl_name_top1"),
        F.max("addr").alias("cl_addr_top1"),
        F.max(F.coalesce((F.col("t") == F.col("pool")).cast("int"), F.lit(0))).alias("cl_is_top3"),
        F.count_if(F.col("cos") > near).alias("cl_n_near"),
    )


def hard_negatives(pairs: DataFrame, k: int = 6) -> DataFrame:
    """The k most confident pairs of each entity that are no matches."""
    order = Window.partitionBy("s1").orderBy(F.desc("p"), "pool")
    return pairs.where("y = 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def id_lists(entities: DataFrame, pairs: DataFrame, score: str = "p") -> DataFrame:
    """s1, ids: every entity's pool ids by score, high to low, comma-joined; empty for an entity without a pair."""
    best = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("n"), F.col("pool").alias("pool"))))
    lists = pairs.groupBy("s1").agg(F.array_join(F.transform(best, lambda x: x["pool"].cast("string")), ",").alias("ids"))
    return entities.join(lists, "s1", "left").withColumn("ids", F.coalesce("ids", F.lit("")))

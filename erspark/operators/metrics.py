"""Measures of candidates and of matches. ``truth`` has s1 and pool; ``entities`` has s1 and n_true, zeros included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truth_counts(entities: DataFrame, truth: DataFrame) -> DataFrame:
    return entities.select("s1").join(truth.groupBy("s1").agg(F.count("*").alias("n_true")), "s1", "left").na.fill(0, ["n_true"])


def f_beta(tp: Column, n_pred: Column, n_true: Column, beta: float = 0.5) -> Column:
    p, r = F.try_divide(tp, n_pred), F.try_divide(tp, n_true)
    score = F.try_divide((1 + beta**2) * p * r, beta**2 * p + r)
    return F.when(n_true == 0, (n_pred == 0).cast("double")).when(tp > 0, score).otherwise(F.lit(0.0))


def entity_scores(predicted: DataFrame, entities: DataFrame) -> DataFrame:
    """s1, n_true, n_pred, tp, f05 for every entity, those without a predicted pair too."""
    n = predicted.groupBy("s1").agg(F.count("*").alias("n_pred"), F.sum("y").alias("tp"))
    df = entities.join(n, "s1", "left").na.fill(0, ["n_pred", "tp"])
    return df.withColumn("f05", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(predicted: DataFrame, entities: DataFrame) -> DataFrame:
    return entity_scores(predicted, entities).agg(F.round(F.avg("f05"), 9).alias("macro_f05"))


def micro(predicted: DataFrame, entities: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, f05 over all pairs."""
    t = entity_scores(predicted, entities).agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_true").alias("n_true"))
    p, r = F.try_divide("tp", "n_pred"), F.try_divide("tp", "n_true")
    return t.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 9).alias("f1"), F.round(F.try_divide(1.25 * p * r, 0.25 * p + r), 9).alias("f05"))


def breakdown(scored: DataFrame, by: str) -> DataFrame:
    return scored.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("f05"), 9).alias("macro_f05"))


def oracle(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Recall of the candidates, and macro F0.5 of a matcher that would pick all true ones among them."""
    s = entity_scores(candidates.where("y = 1"), entities)
    return s.agg(F.round(F.try_divide(F.sum("tp"), F.sum("n_true")), 9).alias("recall"), F.round(F.avg("f05"), 9).alias("oracle_f05"))


def recall_at(lists: DataFrame, total: int | Column, ks: list[int], group: str = "retriever") -> DataFrame:
    """Share of true pairs at a place below k of their query, after lists are interleaved by rank and score."""
    place = F.row_number().over(Window.partitionBy(group, "s1").orderBy("rank", F.desc("score"), "pool"))
    hit = lists.withColumn("place", place).where("y = 1")
    n = F.lit(total) if isinstance(total, int) else total
    return hit.groupBy(group).agg(*[F.round(F.count_if(F.col("place") <= k) / n, 9).alias(f"recall_{k}") for k in ks])


def cap_table(union: DataFrame, entities: DataFrame, caps: list[int]) -> DataFrame:
    """cap, recall, oracle_f05, mean_candidates at each cap on an entity's candidates."""
    each = union.select("s1", "y", F.explode(F.filter(F.array(*[F.lit(c) for c in caps]), lambda c: F.col("pos_in_entity") < c)).alias("cap"))
    n = each.groupBy("s1", "cap").agg(F.count("*").alias("n"), F.sum("y").alias("tp")).join(entities, "s1")
    total = entities.agg(F.count("*").alias("e"), F.sum("n_true").alias("t"), F.count_if(F.col("n_true") == 0).alias("z")).first()
    f = F.when(F.col("n_true") > 0, f_beta(F.col("tp"), F.col("tp"), F.col("n_true"))).otherwise(F.lit(0.0))
    return n.groupBy("cap").agg(F.round(F.sum("tp") / F.lit(max(1, total["t"] or 0)), 9).alias("recall"), F.round((F.sum(f) + F.lit(total["z"])) / F.lit(max(1, total["e"])), 9).alias("oracle_f05"), F.round(F.sum("n") / F.lit(max(1, total["e"])), 9).alias("mean_candidates"))


def leave_one_out(lists: DataFrame, total: int) -> DataFrame:
    """retriever, recall_without: recall of the union of all other retrievers."""
    pairs = lists.where("y = 1").groupBy("s1", "pool").agg(F.collect_set("retriever").alias("by"))
    names = lists.select("retriever").distinct()
    found = pairs.agg(F.count("*").alias("n"))
    only = pairs.where(F.size("by") == 1).groupBy(F.col("by")[0].alias("retriever")).agg(F.count("*").alias("lost"))
    n = found.first()["n"]
    return names.join(only, "retriever", "left").select("retriever", F.round((F.lit(n) - F.coalesce("lost", F.lit(0))) / F.lit(max(1, total)), 9).alias("recall_without"))


def count_stats(per_entity: DataFrame, column: str) -> DataFrame:
    return per_entity.agg(F.round(F.avg(column), 9).alias("mean"), F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"), F.max(column).alias("max"), F.round(F.avg((F.col(column) == 0).cast("double")), 9).alias("zero_share"))


def auc(scored: DataFrame, score: str = "p", label: str = "y", slots: int = 4096) -> DataFrame:
    """Area under the ROC curve; ties count half.

    Ranks are summed on two levels: scores fall into ``slots`` equal ranges, whose totals one small window adds up, and a window
    inside each slot adds up its own scores. No window runs over all of them, and scores stay as they are.
    """
    ends = scored.agg(F.min(score).alias("low"), F.max(score).alias("high"))
    by = scored.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")).crossJoin(F.broadcast(ends))
    slot = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("s") - F.col("low")) / (F.col("high") - F.col("low")) * slots), F.lit(slots - 1))).otherwise(F.lit(0))
    by = by.select("s", "pos", "neg", slot.cast("int").alias("slot"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # over the slots
    totals = by.groupBy("slot").agg(F.sum("neg").alias("n")).select("slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("slot").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("base") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    ranked = by.join(F.broadcast(totals), "slot").withColumn("below", below)
    return ranked.agg(F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.greatest(F.sum("pos") * F.sum("neg"), F.lit(1)), 9).alias("auc"))


def cross_country(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """crossings: pairs whose sides have different countries; both sides have id and country."""
    j = pairs.join(s1.select(F.col("id").alias("s1"), F.col("country").alias("a")), "s1").join(pool.select(F.col("id").alias("pool"), F.col("country").alias("b")), "pool")
    return j.agg(F.count("*").alias("pairs"), F.count_if(F.col("a") != F.col("b")).alias("crossings"))

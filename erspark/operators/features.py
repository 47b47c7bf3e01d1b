"""The pair feature table: 71 columns for each candidate pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erspark.functions import geo, names, similarity
from erspark.operators.lists import RETRIEVERS, gap_to_best, mutual_top, rank_within, relative_to_best

NAME_FEATURES = ["name_ratio", "name_partial", "name_token_sort", "name_token_set", "core_jw", "core_exact", "sorted_exact", "acronym_match", "phonetic_match", "suffix_agree", "name_jaccard", "name_len_diff"]
ADDRESS_FEATURES = ["addr_ratio", "addr_token_sort", "addr_token_set", "digits_jaccard", "digits_conflict", "city_match", "state_match", "country_match", "city_ratio", "cand_is_s3"]
VECTOR_FEATURES = ["emb_cos", "emb_name_cos", "emb_addr_cos", "tfidf_cos"]
LIST_FEATURES = [f"{r}_{x}" for r in RETRIEVERS for x in ("score", "rank")] + [f"by_{r}" for r in RETRIEVERS] + ["n_retrievers", "best_rank", "mutual_top5"]
PLACE_FEATURES = ["house_agree", "house_present_s1", "house_present_cand", "postcode_agree", "addr_word_jaccard", "s1_city_missing", "cand_city_missing", "cand_state_missing", "cand_addr_missing", "cand_non_latin"]
ENTITY_FEATURES = ["emb_rank_in_entity", "emb_gap_to_best", "name_gap_to_best", "bm25_rel_to_best", "n_cands_entity"]
FEATURES = NAME_FEATURES + ADDRESS_FEATURES + VECTOR_FEATURES + LIST_FEATURES + PLACE_FEATURES + ENTITY_FEATURES


def normalised(records: DataFrame) -> DataFrame:
    """Every derived column of records with id, name, addr, country, city and state; nulls become the empty text."""
    df = records.select("id", *[names.clean(F.col(c)).alias(c) for c in ("name", "addr", "city", "state")], F.coalesce("country", F.lit("")).alias("country"), *[c for c in ("is_s3", "vec") if c in records.columns])
    core, suffix = names.strip_suffix(F.col("name"))
    df = df.withColumns({"core": core, "suffix": suffix})
    code = geo.postcode(F.col("addr"), F.col("country"))
    df = df.withColumns({"sorted": names.sorted_tokens(F.col("core")), "acronym": names.acronym(F.col("core")), "phonetic": names.phonetic(F.col("core")), "tokens": names.token_set(F.col("core")), "words": names.word_set(F.col("addr")), "digits": names.digit_set(F.col("addr")), "non_latin": names.non_latin(F.col("name")).cast("int"), "postcode": code})
    return df.withColumn("house", geo.house_number(F.col("addr"), F.col("postcode")))


def pair_features(candidates: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """s1, pool and the 71 features as floats, in the order of FEATURES.

    Candidates meet each side by its id; all windows share one partitioning by query.
    """
    q = normalised(queries).select(*[F.col(c).alias(f"q_{c}") for c in normalised(queries).columns])
    p = normalised(pool).select(*[F.col(c).alias(f"p_{c}") for c in normalised(pool).columns])
    df = candidates.join(q, F.col("s1") == F.col("q_id")).join(p, F.col("pool") == F.col("p_id"))
    a, b = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"p_{c}"))
    proc = lambda c: names.processed(c)
    have = lambda r: F.when(F.col(f"by_{r}") == 1, F.col(f"{r}_score")) if f"by_{r}" in candidates.columns else F.lit(None).cast("double")
    half = lambda c, i: F.slice(c, 1 + 32 * i, 32)
    cos = similarity.cosine
    flag = lambda c: c.cast("int")
    out: dict[str, Column] = {
        "name_ratio": similarity.ratio(proc(a("name")), proc(b("name"))),
        "name_partial": similarity.partial_ratio(proc(a("name")), proc(b("name"))),
        "name_token_sort": similarity.token_sort_ratio(proc(a("name")), proc(b("name"))),
        "name_token_set": similarity.token_set_ratio(proc(a("name")), proc(b("name"))),
        "core_jw": similarity.jaro_winkler(a("core"), b("core")),
        "core_exact": similarity.exact(a("core"), b("core"), a("core")),
        "sorted_exact": similarity.exact(a("sorted"), b("sorted"), a("core")),
        "acronym_match": similarity.acronym_match(a("acronym"), a("core"), b("acronym"), b("core")),
        "phonetic_match": similarity.phonetic_match(a("phonetic"), b("phonetic")),
        "suffix_agree": similarity.soft_equal(a("suffix"), b("suffix")),
        "name_jaccard": similarity.jaccard(a("tokens"), b("tokens")),
        "name_len_diff": similarity.length_gap(a("name"), b("name")),
        "addr_ratio": similarity.ratio(proc(a("addr")), proc(b("addr"))),
        "addr_token_sort": similarity.token_sort_ratio(proc(a("addr")), proc(b("addr"))),
        "addr_token_set": similarity.token_set_ratio(proc(a("addr")), proc(b("addr"))),
        "digits_jaccard": similarity.jaccard(a("digits"), b("digits")),
        "digits_conflict": similarity.digits_conflict(a("digits"), b("digits")),
        "city_match": similarity.soft_equal(a("city"), b("city")),
        "state_match": similarity.soft_equal(a("state"), b("state")),
        "country_match": similarity.soft_equal(a("country"), b("country")),
        "city_ratio": similarity.ratio(a("city"), b("city")),
        "cand_is_s3": b("is_s3"),
        "emb_cos": F.coalesce(have("dense_rev"), have("dense_global"), have("dense"), cos(a("vec"), b("vec"))),
        "emb_name_cos": cos(half(a("vec"), 0), half(b("vec"), 0)),
        "emb_addr_cos": cos(half(a("vec"), 1), half(b("vec"), 1)),
        "tfidf_cos": F.coalesce(have("tfidf"), F.lit(0.0)),
        **{f"{r}_{x}": F.col(f"{r}_{x}") if f"{r}_{x}" in candidates.columns else F.lit(0.0 if x == "score" else 9999) for r in RETRIEVERS for x in ("score", "rank")},
        **{f"by_{r}": F.col(f"by_{r}") if f"by_{r}" in candidates.columns else F.lit(0) for r in RETRIEVERS},
        "n_retrievers": F.col("n_retrievers"),
        "best_rank": F.col("best_rank"),
        "mutual_top5": mutual_top("dense_rank", "dense_rev_rank"),
        "house_agree": similarity.soft_equal(a("house"), b("house")),
        "house_present_s1": flag(a("house") != ""),
        "house_present_cand": flag(b("house") != ""),
        "postcode_agree": similarity.soft_equal(a("postcode"), b("postcode")),
        "addr_word_jaccard": similarity.jaccard(a("words"), b("words")),
        "s1_city_missing": flag(a("city") == ""),
        "cand_city_missing": flag(b("city") == ""),
        "cand_state_missing": flag(b("state") == ""),
        "cand_addr_missing": flag(b("addr") == ""),
        "cand_non_latin": b("non_latin"),
    }
    df = df.select("s1", "pool", *[c.alias(f) for f, c in out.items()])
    df = df.withColumns({"emb_rank_in_entity": rank_within(["s1"], "emb_cos", "pool"), "emb_gap_to_best": gap_to_best("emb_cos", ["s1"]), "name_gap_to_best": gap_to_best("name_token_set", ["s1"]), "bm25_rel_to_best": relative_to_best("bm25_score", ["s1"]), "n_cands_entity": F.count("*").over(Window.partitionBy("s1"))})
    return df.select("s1", "pool", *[F.col(f).cast("float").alias(f) for f in FEATURES])


def fixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates and both sides from the vector and document tables."""
    from erspark.operators import lists, retrieval
    from erspark.plans.fixtures import rec, vec

    v = vec(spark, sf)
    q, p = v.where("role = 0"), v.where("role > 0")
    fwd = retrieval.dense(q, p, 5, ["country"]).select(F.lit("dense").alias("retriever"), "s1", "pool", "score", "rank")
    rev = retrieval.dense_reverse(q, p, 3, ["country"]).select(F.lit("dense_rev").alias("retriever"), "s1", "pool", "score", "rank")
    union = lists.union(lists.truncated(fwd.unionByName(rev), {}), 20)
    r = rec(spark, sf).select("id", "name", "addr", F.lit("US").alias("country"), F.lit("").alias("city"), F.lit("").alias("state")).join(v.select("id", "vec", (F.col("role") == 2).cast("int").alias("is_s3")), "id")
    return union, r, r

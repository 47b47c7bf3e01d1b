"""Queries of operators that have a function of their own: keys, contexts, projections, splits, checks and files.

Hashes of 64-bit words are SQL as well (``uniform_sql``), so that samples, folds and limits by hash are compared row by row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.functions import geo, hashing, tables
from erspark.operators import adapter, context, lists as ranking
from erspark.operators import metrics, model, retrieval, rules, truth, validate
from erspark.plans.fixtures import ENTITY, LISTS, PAIR, REC, VEC, entity, lists, pair, rec, table, vec
from erspark.plans.queries import GT, ON_PAIR, ORACLES, QUERIES, UNION, gt, keyed, knn_sql, long_rank, predicted, query, sides, united
from erspark.sources import scans, sinks
from erspark.sources.workspace import fresh

TWO_64 = "18446744073709551616::UHUGEINT"


def uniform_sql(rows: str, ids: str, salt: int, out: str = "u", seed: int = 42) -> str:
    """SQL of ``rows`` (a table or a subquery) with ``hashing.uniform`` of a column."""
    key = (seed * 0x100000001B3 + salt * 0x9E3779B1 + 12345) % 2**64
    mul = lambda z, shift, factor: f"((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {TWO_64})::UBIGINT"
    start = f"((xor(CAST({ids} AS UBIGINT), {key}::UBIGINT)::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) % {TWO_64})::UBIGINT"
    a = f"SELECT *, {start} AS _a FROM {rows}"
    b = f"SELECT *, {mul('_a', 30, 0xBF58476D1CE4E5B9)} AS _b FROM ({a})"
    c = f"SELECT *, {mul('_b', 27, 0x94D049BB133111EB)} AS _c FROM ({b})"
    return f"(SELECT * EXCLUDE (_a, _b, _c), (xor(_c, _c >> 31) >> 11)::DOUBLE / 9007199254740992 AS {out} FROM ({c}))"


# ---- hashes, samples, folds --------------------------------------------------------------------------------------------
ORACLES["hash_u01"] = f"WITH {REC} SELECT id, u FROM {uniform_sql('rec', 'id', 1)}"
ORACLES["limit_sample_fraction"] = f"WITH {REC} SELECT id FROM {uniform_sql('rec', 'id', 1)} WHERE u < 0.25"
ORACLES["limit_hash_order"] = f"WITH {REC} SELECT id FROM {uniform_sql('rec', 'id', 3)} ORDER BY u, id LIMIT 25"
ORACLES["ml_neg_sampling"] = f"{ON_PAIR} SELECT s1, pool, CASE WHEN y = 1 OR u < 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM {uniform_sql('pair', 'pool', 13)}"
_TWICE = uniform_sql(uniform_sql("entity", "s1", 11, "u"), "s1", 12, "v")
ORACLES["ml_folds"] = f"WITH {PAIR}, {ENTITY} SELECT s1, CAST(CASE WHEN u >= 0.2 THEN -3 WHEN v < 0.12 THEN -1 ELSE least(floor((v - 0.12) / (1 - 0.12) * 5), 4) END AS INT) AS fold FROM {_TWICE}"
ORACLES["sample_stratified_mix"] = f"""{ON_PAIR}, h AS (SELECT s1, pool, p, y, u FROM {uniform_sql('pair', 'pool', 5)})
  SELECT s1, pool, p, y FROM h WHERE y = 1 UNION ALL (SELECT s1, pool, p, y FROM h WHERE y = 0 ORDER BY u, s1, pool, p, y LIMIT 500)
  UNION ALL (SELECT s1, pool, p, y FROM h WHERE p BETWEEN 0.05 AND 0.95 ORDER BY u DESC, s1, pool, p, y LIMIT 200)"""


@query("scan_mask", f"WITH {REC} SELECT id, CAST(u < 0.02 AS INT) AS wide, CAST(u < 0.01 AS INT) AS narrow FROM {uniform_sql('rec', 'id', 1)}")
def scan_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Two nested masks over all records, as flags."""
    u = hashing.uniform(F.col("id"), 1)
    return rec(spark, sf).select("id", u.alias("u")).select("id", (F.col("u") < 0.02).cast("int").alias("wide"), (F.col("u") < 0.01).cast("int").alias("narrow"))


@query("sample_test", f"WITH {REC} SELECT id, src FROM {uniform_sql('rec', 'id', 4)} WHERE src = 1 OR u < 0.5")
def sample_test(spark, sf):
    """Every query record, and a share of the pool."""
    r = rec(spark, sf).select("id", "src")
    return r.where("src = 1").unionByName(truth.sampled(r.where("src > 1"), "id", 0.5, 4))


@query("sample_random_n", f"WITH {REC}, h AS (SELECT id, src, row_number() OVER (PARTITION BY src ORDER BY u, id) AS n FROM {uniform_sql('rec', 'id', 6)}) SELECT id, src FROM h WHERE n <= 20")
def sample_random_n(spark, sf):
    """So many records of each source, picked by hash."""
    r = rec(spark, sf).select("id", "src", (-hashing.uniform(F.col("id"), 6)).alias("score"))
    return retrieval.ranked(r, ["src"], 20, tie="id").select("id", "src")


@query("sample_fit_texts", f"WITH {REC}, h AS (SELECT id, src, id % 2 AS split, row_number() OVER (PARTITION BY id % 2, src ORDER BY u, id) AS n FROM {uniform_sql('rec', 'id', 17)}) SELECT id, src, split FROM h WHERE n <= 10")
def sample_fit_texts(spark, sf):
    r = rec(spark, sf).select("id", "src", (F.col("id") % 2).alias("split"))
    return truth.fit_texts(r, "split", "src", "id", 60).select("id", "src", "split")


_SALT = "second stage"
_START = int.from_bytes(hashlib.sha256(_SALT.encode()).digest()[:8], "little")


@query("hash_split_sha", f"WITH {PAIR}, {ENTITY} SELECT s1, CAST((((s1::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT + {_START}::UHUGEINT) % {TWO_64})::UBIGINT >> 11)::DOUBLE / 9007199254740992 < 0.25 AS INT) AS fit FROM entity")
def hash_split_sha(spark, sf):
    return entity(spark, sf).select("s1", truth.split_half(F.col("s1"), _SALT).alias("fit"))


# ---- geography ---------------------------------------------------------------------------------------------------------
_OWN = "own(country, spelling, region) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in ((x, y.replace("'", "''"), z.replace("'", "''")) for x, y, z in tables.region_rows())) + ")"
_ANY = "anywhere(spelling, region) AS (VALUES " + ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in tables.long_region_rows()) + ")"
_VALUE = "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'NY.' WHEN 1 THEN 'wb' WHEN 2 THEN 'Calif' WHEN 3 THEN ' Orissa ' WHEN 4 THEN 'Île-de-France' ELSE 'zz top' END"
_PLAIN = "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'ny' WHEN 1 THEN 'wb' WHEN 2 THEN 'calif' WHEN 3 THEN 'orissa' WHEN 4 THEN 'ile-de-france' ELSE 'zz top' END"
_COUNTRY = "CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'Spain' END"


def _places(spark, sf, column, values):
    k = F.col("c_custkey")
    text = F.lit(values[-1])
    for n, v in enumerate(values[:-1]):
        text = F.when(k % len(values) == n, v).otherwise(text)
    return table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, "US").when(k % 3 == 1, "India").otherwise("Spain").alias("country"), text.alias(column))


@query("region_canon", f"WITH {_OWN}, {_ANY}, c AS (SELECT c_custkey AS id, {_COUNTRY} AS country, {_PLAIN} AS spelling FROM customer) SELECT id, coalesce(own.region, anywhere.region, spelling) AS region FROM c LEFT JOIN own USING (country, spelling) LEFT JOIN anywhere USING (spelling)")
def region_canon(spark, sf):
    df = _places(spark, sf, "value", ["NY.", "wb", "Calif", " Orissa ", "Île-de-France", "zz top"])
    return geo.canonical_region(df, "id", "value", "country", geo.region_table(spark))


_ADDRESSES = ["12 park st, new york, ny", "mg road, kolkata, wb", "5 west virginia ave", "old delhi road, calif", "nowhere", "1 rue x, paris, ile de france", "tn"]
_ADDRESS = "CASE CAST(c_custkey % 7 AS INT) " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(_ADDRESSES[:-1])) + f" ELSE '{_ADDRESSES[-1]}' END"


@query("region_extract", f"""WITH {_OWN}, {_ANY}, c AS (SELECT c_custkey AS id, {_COUNTRY} AS country, regexp_replace({_ADDRESS}, '[^a-z\\s,]', ' ', 'g') AS flat FROM customer),
  seg AS (SELECT id, country, trim(s) AS spelling, pos FROM (SELECT id, country, unnest(string_split(flat, ',')) AS s, generate_subscripts(string_split(flat, ','), 1) AS pos FROM c)),
  code AS (SELECT id, arg_min(region, pos) AS region FROM seg JOIN own USING (country, spelling) WHERE length(spelling) BETWEEN 1 AND 3 GROUP BY id),
  w AS (SELECT id, country, list_filter(string_split_regex(replace(flat, ',', ' '), '\\s+'), lambda x: x <> '') AS w FROM c),
  g AS (SELECT id, country, n, i, array_to_string(w[i:i + n - 1], ' ') AS spelling FROM w, range(1, 6) t(n), range(1, 12) u(i) WHERE i + n - 1 <= len(w)),
  name AS (SELECT id, arg_min(coalesce(own.region, anywhere.region), (5 - n) * 100 + i) AS region FROM g LEFT JOIN own USING (country, spelling) LEFT JOIN anywhere USING (spelling) WHERE length(spelling) > 3 AND coalesce(own.region, anywhere.region) IS NOT NULL GROUP BY id)
  SELECT id, coalesce(code.region, name.region, '') AS region FROM c LEFT JOIN code USING (id) LEFT JOIN name USING (id)""")
def region_extract(spark, sf):
    return geo.region(_places(spark, sf, "addr", _ADDRESSES), "id", "addr", "country", geo.region_table(spark))


@query("join_region", f"WITH {_OWN}, r AS (SELECT country, region, string_agg(spelling, ',' ORDER BY spelling) AS spellings FROM own GROUP BY ALL) SELECT c_custkey AS id, region, spellings FROM customer JOIN r ON r.country = {_COUNTRY} AND c_custkey % 60 = length(region)")
def join_region(spark, sf):
    """The registry as a table: its regions, with all spellings, beside the records that ask for them."""
    own = geo.region_table(spark).where("country <> '*'").groupBy("country", "region").agg(F.array_join(F.array_sort(F.collect_list("spelling")), ",").alias("spellings"))
    c = _places(spark, sf, "addr", ["x"]).withColumn("n", F.col("id") % 60)
    return c.join(F.broadcast(own.withColumn("n", F.length("region").cast("long"))), ["country", "n"]).select("id", "region", "spellings")


@query("country_canon", """WITH n AS (SELECT n_nationkey AS id, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '-bissau' ELSE ' o''brien' END AS raw FROM nation UNION ALL SELECT 100 + n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN ' U.S.A. ' WHEN 1 THEN 'bharat' ELSE 'FR' END FROM nation),
  c AS (SELECT id, lower(trim(raw)) AS t FROM n)
  SELECT id, CASE t WHEN 'u.s.a.' THEN 'US' WHEN 'bharat' THEN 'India' WHEN 'fr' THEN 'France' ELSE array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(t[i - 1], '\\pL') THEN upper(t[i]) ELSE t[i] END), '') END AS country FROM c""")
def country_canon(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("id"), "n_name")
    odd = n.select("id", F.concat("n_name", F.when(F.col("id") % 2 == 0, "-bissau").otherwise(" o'brien")).alias("raw"))
    known = n.select((F.col("id") + 100).alias("id"), F.when(F.col("id") % 3 == 0, " U.S.A. ").when(F.col("id") % 3 == 1, "bharat").otherwise("FR").alias("raw"))
    return odd.unionByName(known).select("id", geo.country(F.col("raw")).alias("country"))


# ---- joins -------------------------------------------------------------------------------------------------------------
SHOP = "shop AS (SELECT c_custkey AS id, CAST(1 + c_custkey % 3 AS INT) AS src, CASE WHEN c_nationkey % 2 = 0 THEN 'US' ELSE 'India' END AS country, lower(c_mktsegment) || ' ' || c_custkey % 11 AS name_core, 'c' || c_nationkey AS city, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(10000 + c_custkey % 97 AS VARCHAR) END AS postcode, CAST(c_custkey % 53 AS VARCHAR) AS house FROM customer)"


def shop(spark: SparkSession, sf: str) -> DataFrame:
    """Records with all parts that exact keys take."""
    k = F.col("c_custkey")
    n = lambda c: c.cast("string")
    return table(spark, sf, "customer").select(
        k.alias("id"), (1 + k % 3).cast("int").alias("src"), F.when(F.col("c_nationkey") % 2 == 0, "US").otherwise("India").alias("country"), F.concat(F.lower("c_mktsegment"), F.lit(" "), n(k % 11)).alias("name_core"),
        F.concat(F.lit("c"), n(F.col("c_nationkey"))).alias("city"), F.when(k % 4 == 0, "").otherwise(n(10000 + k % 97)).alias("postcode"), n(k % 53).alias("house"), F.concat_ws(" ", n(k % 53), F.lit("road"), n(F.col("c_nationkey"))).alias("addr"),
    )


@query("join_exact_keys")
def join_exact_keys(spark, sf):
    """Candidates of all four exact keys, ranked by token sets, with the production guard of 200 records and 20,000 pairs."""
    r = shop(spark, sf).withColumn("name_sorted", F.array_join(F.array_sort(F.split("name_core", " ")), " "))
    out = None
    for kind in retrieval.EXACT_KINDS:
        df = r.withColumn("key", retrieval.exact_key_value(kind)).withColumn("pool_source", F.concat(F.lit("S"), F.col("src").cast("string")))
        df = df.withColumn("addr", F.col("addr") if kind in retrieval.BY_ADDRESS else F.col("name_core"))
        part = retrieval.exact_key(df.where("src = 1"), df.where("src > 1"), "key").select(F.lit(kind).alias("kind"), "s1", "pool", "pool_source", "score", F.col("rank").cast("long").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


_KEY = {
    "exact_name": "CASE WHEN length(name_core) >= 3 THEN country || '|' || name_core ELSE '' END",
    "exact_sorted_city": "CASE WHEN name_core <> '' AND city <> '' THEN country || '|' || city || '|' || array_to_string(list_sort(string_split(name_core, ' ')), ' ') ELSE '' END",
    "exact_postcode": "CASE WHEN postcode <> '' AND name_core <> '' THEN country || '|' || postcode || '|' || split_part(name_core, ' ', 1) ELSE '' END",
    "exact_house_city": "CASE WHEN house <> '' AND city <> '' THEN country || '|' || city || '|' || house ELSE '' END",
}


@query("agg_exact_keys", f"WITH {SHOP}, k AS ({' UNION ALL '.join(f'''SELECT '{kind}' AS kind, src, {key} AS key FROM shop''' for kind, key in _KEY.items())}), sz AS (SELECT kind, key, count(*) FILTER (src > 1) AS np, count(*) FILTER (src = 1) AS nq FROM k WHERE key <> '' GROUP BY ALL HAVING np > 0 AND nq > 0) SELECT kind, count(*) AS shared_keys, count(*) FILTER (NOT (np <= 200 AND nq * np <= 20000)) AS skipped_blocks, CAST(coalesce(sum(nq * np) FILTER (np <= 200 AND nq * np <= 20000), 0) AS BIGINT) AS pairs_before_topk, CAST(sum(nq) AS BIGINT) AS queries_with_key, CAST(coalesce(sum(nq) FILTER (NOT (np <= 200 AND nq * np <= 20000)), 0) AS BIGINT) AS queries_in_skipped FROM sz GROUP BY kind")
def agg_exact_keys(spark, sf):
    r = shop(spark, sf).withColumn("name_sorted", F.array_join(F.array_sort(F.split("name_core", " ")), " "))
    out = None
    for kind in retrieval.EXACT_KINDS:
        df = r.withColumn("key", retrieval.exact_key_value(kind))
        part = retrieval.block_stats(df.where("src = 1"), df.where("src > 1"), "key").select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_PARTED = knn_sql("a.role = 0", "b.role > 0", "q, role ORDER BY score DESC, c", 3, " AND a.country = b.country", "q AS s1, c AS pool, role").replace("b.id AS c,", "b.id AS c, b.role AS role,")


@query("join_partitioned", _PARTED)
def join_partitioned(spark, sf):
    """The nearest of each country and pool source, as lists of their own."""
    q, p = sides(spark, sf)
    roles = p.select("role").distinct()
    out = retrieval.dense(q.drop("role").join(F.broadcast(roles)), p, 3, ["country", "role"], per=["s1", "role"])
    return out.select("s1", "pool", "role", "score", F.col("rank").cast("long").alias("rank"))


@query("join_blocked_cosine", knn_sql("a.role = 0", "b.role > 0", "q ORDER BY score DESC, c", 5, " AND a.country = b.country", "q AS s1, c AS pool"))
def join_blocked_cosine(spark, sf):
    """The nearest with blocks so small that every bucket has several: the result does not depend on them."""
    q, p = sides(spark, sf)
    return long_rank(retrieval.dense(q, p, 5, ["country"], block=64))


@query("union_blocks", f"WITH {UNION} SELECT s1 % 3 AS block, s1, pool, pos_in_entity FROM placed WHERE pos_in_entity < 5")
def union_blocks(spark, sf):
    """The union block by block of entities, each written, and read as one."""
    path = fresh(spark, "union")
    united(spark, sf, 5).select((F.col("s1") % 3).alias("block"), "s1", "pool", "pos_in_entity").write.partitionBy("block").parquet(path)
    return spark.read.parquet(path).select(F.col("block").cast("long").alias("block"), "s1", "pool", "pos_in_entity")


@query("topk_dense_block", knn_sql("a.role = 0", "b.role > 0", "q ORDER BY score DESC, c", 4, "", "q AS s1, c AS pool"))
def topk_dense_block(spark, sf):
    """The best of each query over all blocks of the pool, merged from the best of each block."""
    q, p = sides(spark, sf)
    blocks = [retrieval.dense(q.withColumn("all", F.lit(0)), p.where(F.col("id") % 3 == n).withColumn("all", F.lit(0)), 4, ["all"]).drop("rank") for n in range(3)]
    merged = blocks[0].unionByName(blocks[1]).unionByName(blocks[2])
    return long_rank(retrieval.ranked(merged, ["s1"], 4))


@query("topk_sparse_rows", "WITH t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, w) AS n FROM t) SELECT doc_id, w, tf FROM r WHERE n <= 3")
def topk_sparse_rows(spark, sf):
    """The largest entries of each row of a sparse matrix: the most frequent words of each document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    t = table(spark, sf, "documents").select("doc_id", F.explode(words).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    return retrieval.ranked(t, ["doc_id"], 3, "tf", "w").select("doc_id", "w", "tf")


# ---- sources and sinks -------------------------------------------------------------------------------------------------
@query("scan_truth", f"WITH {GT} SELECT source1_entity_id AS s1, coalesce(matched_entity_ids, '') AS ids FROM gt")
def scan_truth(spark, sf):
    """The truth as a file of tab-separated lists, and read from it; a file with other columns is refused."""
    path = fresh(spark, "truth")
    gt(spark, sf).write.option("emptyValue", "").csv(path, sep="\t", header=True, quote="")
    return scans.read_truth(spark, path).select(F.col("source1_entity_id").cast("long").alias("s1"), F.col("matched_entity_ids").alias("ids"))


@query("sink_submission", f"{ON_PAIR}, l AS (SELECT o_orderkey AS s1, coalesce(string_agg(CAST(pool AS VARCHAR), ',' ORDER BY p DESC, pool), '') AS ids FROM orders LEFT JOIN (SELECT * FROM pair WHERE p >= 0.6) x ON x.s1 = o_orderkey GROUP BY ALL) SELECT row_number() OVER (ORDER BY s1) - 1 AS line, s1, ids FROM l")
def sink_submission(spark, sf):
    """The submission's file, and its lines as they stand in it."""
    path = fresh(spark, "submission")
    order = table(spark, sf, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderkey").alias("row_no"))
    sinks.submission(ranking.id_lists(order, predicted(spark, sf)), path, "matched_entity_ids")
    return scans.numbered_lines(spark, path).select("line", F.col("source1_entity_id").cast("long").alias("s1"), F.col("matched_entity_ids").alias("ids"))


@query("sink_emb_cache", f"WITH {VEC} SELECT id AS row_no, round(list_sum(vec::DOUBLE[]), 4) AS total, CAST(len(vec) AS INT) AS dim FROM vec")
def sink_emb_cache(spark, sf):
    """Vectors written twice: the second time finds every chunk there and writes none."""
    path = fresh(spark, "cache")
    v = vec(spark, sf).select(F.col("id").alias("row_no"), "vec")
    sinks.vector_chunks(v, path, 100, 64)
    sinks.vector_chunks(v, path, 100, 64)
    return spark.read.parquet(path).select("row_no", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.size("vec").alias("dim"))


@query("sink_npy", f"WITH {VEC} SELECT CAST(id // 100 AS BIGINT) AS chunk, count(*) AS n, round(sum(list_sum(vec::DOUBLE[])), 3) AS total FROM vec GROUP BY 1")
def sink_npy(spark, sf):
    """Vectors as arrays in the public ``.npy`` format, a chunk each, read back by number."""
    path = fresh(spark, "npy")
    v = vec(spark, sf).select((F.floor(F.col("id") / 100)).cast("long").alias("chunk"), F.col("id").alias("row_no"), "vec")
    sinks.npy_chunks(v, path)
    return scans.npy_sums(spark, path).select("chunk", "n", F.round("total", 3).alias("total"))


_PRF = f"{ORACLES['agg_micro_prf']}"
ORACLES["sink_report"] = f"SELECT precision, recall, f05 FROM ({_PRF})"


@query("sink_json", f"SELECT tp, fp, fn FROM ({_PRF})")
def sink_json(spark, sf):
    """A report replaced by a later one under the same name: the later one stands."""
    path = f"{fresh(spark, 'json')}/report.json"
    sinks.write_json(spark, path, {"tp": -1})
    m = metrics.micro(predicted(spark, sf), entity(spark, sf)).first()
    sinks.write_json(spark, path, {k: m[k] for k in ("tp", "fp", "fn")})
    back = sinks.read_json(spark, path)
    return spark.createDataFrame([(back["tp"], back["fp"], back["fn"])], "tp long, fp long, fn long")


@query("file_sha256", "SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS sha256 FROM region")
def file_sha256(spark, sf):
    path = fresh(spark, "names")
    table(spark, sf, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)
    return scans.file_hashes(spark, path).select("sha256")


# ---- contexts, projections, models -------------------------------------------------------------------------------------
@query("ctx_build", f"WITH {REC} SELECT name, depth, (SELECT count(*) FROM rec WHERE src = 1 AND (name <> 'diag' OR id IN (SELECT id FROM {uniform_sql('rec', 'id', 2)} WHERE u < 0.2))) AS queries, (SELECT count(*) FROM rec WHERE src > 1) AS pool, (SELECT count(*) FROM rec WHERE src = 1) AS reverse FROM (VALUES ('train', 'prod'), ('diag', 'diag'), ('test', 'prod')) t(name, depth)".replace("name <> 'diag'", "t.name <> 'diag'").replace("SELECT name, depth", "SELECT t.name, depth"))
def ctx_build(spark, sf):
    out = None
    for name in ("train", "diag", "test"):
        r = rec(spark, sf).select("id", "src")
        c = context.build(name, r.where("src = 1"), r.where("src > 1"), {"table": "rec"}, diag_share=0.2)
        row = c.queries.agg(F.count("*").alias("queries")).crossJoin(c.pool.agg(F.count("*").alias("pool"))).crossJoin(c.reverse.agg(F.count("*").alias("reverse")))
        row = row.select(F.lit(c.name).alias("name"), F.lit(c.depth).alias("depth"), "queries", "pool", "reverse")
        out = row if out is None else out.unionByName(row)
    return out


@query("ctx_depth", "SELECT DISTINCT CAST(l_linenumber * 100 AS INT) AS k, CAST(l_linenumber * 100 AS INT) AS prod, CAST(greatest(l_linenumber * 100, 500) AS INT) AS diag FROM lineitem")
def ctx_depth(spark, sf):
    n = table(spark, sf, "lineitem").select((F.col("l_linenumber") * 100).cast("int").alias("k")).distinct()
    return n.select("k", context.depth(F.col("k"), "prod").alias("prod"), context.depth(F.col("k"), "diag").alias("diag"))


def _adapter_sides(spark, sf):
    """Queries, pool and true pairs: a query's matches are the records 8 and 16 further on, of the same label."""
    q, p = sides(spark, sf)
    near = q.select(F.col("id").alias("s1"), F.explode(F.array(F.col("id") + 8, F.col("id") + 16)).alias("pool"), F.col("label").alias("ql"))
    return q, p, near.join(p.select(F.col("id").alias("pool"), "label"), "pool").where("label = ql").select("s1", "pool")


@query("ml_adapter")
def ml_adapter(spark, sf):
    """Mean cosine of true pairs before and after the towers."""
    q, p, t = _adapter_sides(spark, sf)
    towers = adapter.fit(q, p, t)
    return adapter.pair_cosine(q, p, t).select(F.lit("raw").alias("space"), "cos").unionByName(adapter.pair_cosine(adapter.project(q, towers.query), adapter.project(p, towers.pool), t).select(F.lit("projected").alias("space"), "cos"))


@query("join_adapter_topk")
def join_adapter_topk(spark, sf):
    """The nearest in the projected space, all pool sources together, in each country."""
    q, p, t = _adapter_sides(spark, sf)
    towers = adapter.fit(q, p, t)
    return long_rank(retrieval.dense(adapter.project(q, towers.query), adapter.project(p, towers.pool), 10, ["country"]))


@query("agg_adapter_recall")
def agg_adapter_recall(spark, sf):
    """Recall of the projected lists by depth and country, alone and beside the raw lists, and what they add."""
    q, p, t = _adapter_sides(spark, sf)
    own = join_adapter_topk(spark, sf)
    old = retrieval.dense(q, p, 5, ["country"])
    return adapter.recall(own, old, t, q.select(F.col("id").alias("s1"), "country"), [1, 5, 10])


@query("ml_tfidf_svd")
def ml_tfidf_svd(spark, sf):
    r = rec(spark, sf).select("id", "name")
    return model.tfidf_svd(r, "name", features=2000, dim=16).select("id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


@query("ml_embed_text")
def ml_embed_text(spark, sf):
    """Text vectors of a pluggable embedder, in batches of bounded characters; hashed character n-grams stand in for weights."""
    return model.embedded(rec(spark, sf).select("id", "name"), "name", model.hashed_embedder(32)).select("id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


@query("ml_dedup_embed", f"WITH {REC} SELECT id, name, count(*) OVER (PARTITION BY name) AS share FROM rec")
def ml_dedup_embed(spark, sf):
    """Each different text is embedded once and joined back; ``share`` counts the records that have a vector in common."""
    v = model.embedded_once(rec(spark, sf).select("id", "name"), "name", model.hashed_embedder(32))
    n = v.groupBy("name", "vec").agg(F.count("*").alias("share"))
    return v.select("id", "name").join(n.select("name", "share"), "name").select("id", "name", "share")


@query("ml_train_calibrate")
def ml_train_calibrate(spark, sf):
    """Folds, grid, out-of-fold predictions, rule, holdout and refit in one."""
    df = pair(spark, sf).withColumn("fold", truth.folds(F.col("s1"), 1.0, 0.2, 2))
    got = model.train_and_calibrate(df, entity(spark, sf), ["p", "price", "discount", "is_s3"], "y", 2, [{"trees": 1, "depth": 2}, {"trees": 2, "depth": 2}], [rules.Rule(threshold=t, exclusive=e) for t in (0.3, 0.5) for e in (False, True)])
    return spark.createDataFrame([got], "trees int, depth int, threshold double, exclusive int, f05_oof double, f05_holdout double")


@query("ml_cv_oof")
def ml_cv_oof(spark, sf):
    """Out-of-fold probabilities, each fold's written under its fingerprint and found again by a second run."""
    df = pair(spark, sf).withColumn("fold", truth.folds(F.col("s1"), 1.0, 0.1, 2))
    path = fresh(spark, "oof")
    make = lambda: model.cross_validated_by_fold(df, ["p", "price", "discount"], "y", 2, path, trees=2, depth=2)
    make()
    return make()


@query("ml_leakage_checks", f"""WITH {PAIR}, {ENTITY}, f AS (SELECT s1, CASE WHEN v < 0.12 THEN -1 ELSE CAST(least(floor((v - 0.12) / (1 - 0.12) * 5), 4) AS INT) END AS fold FROM {uniform_sql('entity', 's1', 12, 'v')}), j AS (SELECT * FROM pair JOIN f USING (s1))
  SELECT 'entities in several folds' AS what, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'holdout entities in training', CAST(0 AS BIGINT)
  UNION ALL SELECT 'positives shared by folds', count(*) FROM (SELECT pool FROM j WHERE y = 1 GROUP BY pool HAVING count(DISTINCT fold) > 1)""")
def ml_leakage_checks(spark, sf):
    df = pair(spark, sf).withColumn("fold", truth.folds(F.col("s1"), 1.0, 0.12, 5))
    return truth.leakage(df)


@query("agg_block_partial", f"WITH {PAIR}, {ENTITY}, pred AS (SELECT s1, count(*) AS n, sum(y) AS tp FROM pair WHERE p >= 0.6 GROUP BY s1) SELECT count(*) AS entities, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_pred, CAST(sum(coalesce(tp, 0)) AS BIGINT) AS tp, CAST(sum(n_true) AS BIGINT) AS n_true FROM entity LEFT JOIN pred USING (s1)")
def agg_block_partial(spark, sf):
    """Counts of each block of entities, written block by block, and their sum."""
    path = fresh(spark, "partial")
    s = metrics.entity_scores(predicted(spark, sf), entity(spark, sf)).withColumn("block", F.floor(F.col("s1") / 1000).cast("long"))
    s.groupBy("block").agg(F.count("*").alias("entities"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true")).write.parquet(path)
    return spark.read.parquet(path).agg(*[F.sum(c).alias(c) for c in ("entities", "n_pred", "tp", "n_true")])


# ---- validation --------------------------------------------------------------------------------------------------------
BROKEN = f"""{PAIR}, l AS (SELECT o_orderkey AS s1, coalesce(string_agg(CAST(pool AS VARCHAR), ',' ORDER BY p DESC, pool), '') AS ids FROM orders LEFT JOIN (SELECT * FROM pair WHERE p >= 0.9) x ON x.s1 = o_orderkey GROUP BY ALL)"""


@query("val_submission", f"""WITH {BROKEN}, gone AS (SELECT s1 FROM l WHERE s1 % 1000 = 1), bad AS (SELECT s1 FROM l WHERE s1 % 1000 = 2), twice AS (SELECT pool FROM pair JOIN orders ON o_orderkey = s1 WHERE p >= 0.9 AND s1 % 1000 NOT IN (1, 2) GROUP BY pool HAVING count(DISTINCT s1) > 1)
  SELECT 'matches: missing entity' AS error, CAST(s1 AS VARCHAR) AS id FROM gone UNION ALL SELECT 'matches: unknown pool id', '-5' FROM bad UNION ALL SELECT 'match is no candidate', '-5' FROM bad
  UNION ALL SELECT 'pool id matched twice', CAST(pool AS VARCHAR) FROM twice UNION ALL SELECT 'pool id matched twice', '-5' FROM (SELECT count(*) AS n FROM bad) WHERE n > 1""")
def val_submission(spark, sf):
    """Findings in lists that lack some entities, name an unknown record for others, and give one record to several."""
    order = table(spark, sf, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderkey").alias("row_no"))
    p = pair(spark, sf).join(order.select("s1"), "s1", "left_semi")
    full = ranking.id_lists(order, p.where("p >= 0.9"))
    spoilt = full.where("s1 % 1000 <> 1").withColumn("ids", F.when(F.col("s1") % 1000 == 2, "-5").otherwise(F.col("ids")))
    return validate.submission_errors(spoilt, full, order, pair(spark, sf).select(F.col("pool").alias("id")).distinct())


@query("val_submission_stream", f"WITH {PAIR} SELECT 'x' AS error, 'x' AS id FROM pair WHERE false")
def val_submission_stream(spark, sf):
    """The same checks over files, as written and read again: none is found where every record has one owner."""
    order = table(spark, sf, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderkey").alias("row_no"))
    best = ranking.pool_best(pair(spark, sf)).where("is_best = 1").join(order.select("s1"), "s1", "left_semi")
    read = {}
    for name, some in (("matched_entity_ids", best.where("p >= 0.6")), ("candidate_entity_ids", best)):
        path = fresh(spark, name)
        sinks.submission(ranking.id_lists(order, some), path, name)
        got = scans.numbered_lines(spark, path)
        read[name] = got.select(F.col("source1_entity_id").cast("long").alias("s1"), F.coalesce(name, F.lit("")).alias("ids"), "line")
    expected = scans.numbered(order.orderBy("row_no"), "row_no").select("s1", F.col("line").alias("row_no"))
    lines = [df.withColumnRenamed("line", "row_no") for df in read.values()]
    return validate.submission_errors(*lines, expected, pair(spark, sf).select(F.col("pool").cast("string").alias("id")).distinct())


@query("val_official", "SELECT CAST(0 AS INT) AS present")
def val_official(spark, sf):
    """Whether the organiser's validator is there to be run; it is not part of any data."""
    return spark.createDataFrame([(int(validate.official(f"{fresh(spark, 'none')}/validator.py", []) is not None),)], "present int")


# ---- vectors -----------------------------------------------------------------------------------------------------------
_DOT = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query("agg_emb_sanity", f"WITH {VEC} SELECT 'same' AS kind, round(avg({_DOT}), 5) AS value FROM vec a JOIN vec b ON b.id IN (a.id + 8, a.id + 16) AND a.label = b.label UNION ALL SELECT 'other', round(avg({_DOT}), 5) FROM vec a JOIN vec b ON b.id = a.id + 1 AND a.label <> b.label")
def agg_emb_sanity(spark, sf):
    """Mean cosine of pairs of one label, and of two; each record meets the one or two that it is compared with."""
    from erspark.functions import similarity

    v = vec(spark, sf).select("id", "vec", "label")
    out = None
    for kind, steps in (("same", (8, 16)), ("other", (1,))):
        a = v.select(F.col("vec").alias("av"), F.col("label").alias("la"), F.explode(F.array(*[F.col("id") + s for s in steps])).alias("id"))
        both = a.join(v, "id").where(F.col("la") == F.col("label") if kind == "same" else F.col("la") != F.col("label"))
        part = both.agg(F.round(F.avg(similarity.cosine(F.col("av"), F.col("vec"))), 5).alias("value")).select(F.lit(kind).alias("kind"), "value")
        out = part if out is None else out.unionByName(part)
    return out

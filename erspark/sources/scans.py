"""Sources: tab-separated records, Parquet, truth lists and vector stores."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erspark.functions.hashing import encode_id, fingerprint

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_small(spark: SparkSession, path: str) -> str:
    """Text of a small file, hidden ones too, which Spark's readers pass over."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def locate(spark: SparkSession, folder: str, split: str, name: str) -> str:
    """``folder/split/name``, or ``folder/name`` where that does not exist; raises if neither does."""
    for path in (f"{folder}/{split}/{name}", f"{folder}/{name}"):
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"{name} is neither in {folder}/{split} nor in {folder}")


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Tab-separated text without quoting; a missing value is the empty string."""
    df = spark.read.csv(path, sep="\t", quote="", header=True, schema=schema, enforceSchema=False, emptyValue="", nullValue="\0")
    return df.na.fill("")


def checked_tsv(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """``read_tsv``, after a check that it parses as many rows as its files have lines below their headers, one in each file."""
    df = read_tsv(spark, path, schema)
    lines = spark.read.text(path).groupBy(F.input_file_name()).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).first()["n"]
    rows = df.count()
    if rows != lines:
        raise ValueError(f"{path}: {rows} rows from {lines} lines")
    return df


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return checked_tsv(spark, path, TRUTH)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Columns and filter reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def block_range(lists: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of ranked lists for queries in [low, high); row groups outside are skipped."""
    return lists.where((F.col("s1") >= low) & (F.col("s1") < high))


def view(records: DataFrame) -> DataFrame:
    """Lower-cased name and address, and empty city and state, computed while reading."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return records.select("entity_id", low("business_name").alias("name_clean"), low("business_address").alias("addr_clean"), F.lit("").alias("extracted_city"), F.lit("").alias("extracted_state"), "country")


def ids(records: DataFrame) -> DataFrame:
    return records.select(encode_id(F.col("entity_id")).alias("id"))


def pool(s2: DataFrame, s3: DataFrame) -> DataFrame:
    return s2.withColumn("pool_source", F.lit("S2")).unionByName(s3.withColumn("pool_source", F.lit("S3")))


def raw_by_id(records: DataFrame, wanted: DataFrame, key: str = "entity_id") -> DataFrame:
    """Raw rows of the wanted ids; Spark broadcasts them if they are few."""
    return records.join(wanted.select(key).distinct(), key, "left_semi")


def stale(spark: SparkSession, source: str, target: str) -> bool:
    """Whether ``target`` was built from another state of ``source`` (path, size, time), or never."""
    meta = f"{target}/_meta.json"
    if not exists(spark, meta):
        return True
    said = json.loads(read_small(spark, meta))
    return said.get("source") != source_state(spark, source)


def source_state(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    s = fs.getFileStatus(p)
    return fingerprint({"path": path, "size": s.getLen(), "time": s.getModificationTime()})


def vector_store(spark: SparkSession, path: str, dim: int, rows: int | None = None) -> DataFrame:
    """Vectors (row_no, vec) of a Parquet store; row numbers must be a permutation of 0..n-1, vectors ``dim`` long."""
    df = spark.read.parquet(path)
    got = df.agg(F.count("*").alias("n"), F.count_distinct("row_no").alias("d"), F.min("row_no").alias("a"), F.max("row_no").alias("b"), F.count_if(F.size("vec") != dim).alias("bad")).first()
    n = got["n"] if rows is None else rows
    if got["n"] != n or got["d"] != n or (n and (got["a"], got["b"]) != (0, n - 1)) or got["bad"]:
        raise ValueError(f"{path}: not a store of {n} vectors of {dim}: {got.asDict()}")
    return df


def missing_chunks(spark: SparkSession, path: str, chunks: list[int]) -> list[int]:
    """Chunks of a partitioned store that have not been written."""
    return [c for c in chunks if not exists(spark, f"{path}/chunk={c}")]


def vectors_agree(vectors: DataFrame, names: DataFrame, least: float = 0.999) -> DataFrame:
    """share: records of one name whose vectors agree with those of the name's first record. ``vectors`` has id and vec."""
    j = names.join(vectors, "id")
    first = j.groupBy("name").agg(F.min_by("vec", "id").alias("first"), F.min("id").alias("fid"))
    both = j.join(first, "name").where(F.col("id") != F.col("fid"))
    cos = F.aggregate(F.zip_with("vec", "first", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.agg(F.count("*").alias("pairs"), F.round(F.avg((cos > least).cast("double")), 9).alias("share"))



def _numbered(df: DataFrame) -> DataFrame:
    """``df``, read from files, with ``line``: its row's place over all files, in the order of their names.

    Rows are numbered inside each file; the sizes of files, a number for each, are added up on the driver.
    """
    own = df.columns
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    sizes = {r["_file"]: r["count"] for r in df.groupBy("_file").count().collect()}
    begins, total = {}, 0
    for f in sorted(sizes):
        begins[f], total = total, total + sizes[f]
    place = F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_at")) - 1
    starts = F.create_map(*[F.lit(x) for kv in begins.items() for x in kv]) if begins else F.create_map().cast("map<string,int>")
    return df.withColumn("line", (F.element_at(starts, F.col("_file")) + place).cast("long")).select(*own, "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a submission with ``line``, counted from 0 without headers; empty lists are null."""
    return _numbered(spark.read.csv(path, sep="\t", header=True, quote="")).na.fill("")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``line``, its rows' places in the order of ``key``."""
    from erspark.sources.workspace import fresh

    path = fresh(df.sparkSession, "numbered")
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
    return _numbered(df.sparkSession.read.parquet(path))


def npy_sums(spark: SparkSession, path: str) -> DataFrame:
    """chunk, n, total of arrays that ``sinks.npy_chunks`` wrote."""

    def run(batches):
        for b in batches:
            arrays = [np.load(io.BytesIO(x), allow_pickle=False) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array([float(a.astype(np.float64).sum()) for a in arrays], pa.float64())], ["chunk", "n", "total"])

    return spark.read.parquet(path).select("chunk", "npy").mapInArrow(run, "chunk long, n long, total double")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every data file in a folder, read where the files are."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))

"""Sinks: fingerprinted Parquet, partitioned lists, vector chunks and submissions."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.sources.scans import _fs, exists, read_small


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small report, written beside its place and renamed."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(tmp, p)


def read_json(spark: SparkSession, path: str) -> dict | None:
    return json.loads(read_small(spark, path)) if exists(spark, path) else None


def save(df: DataFrame, path: str, meta: dict, partition_by: tuple[str, ...] = (), sort: tuple[str, ...] = ()) -> None:
    """Parquet with zstd, and what it was made from beside it."""
    df = df.sortWithinPartitions(*sort) if sort else df
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    write_json(df.sparkSession, f"{path}/_meta.json", meta)


def done(spark: SparkSession, path: str, print_: str) -> bool:
    """Whether ``path`` holds a finished table of that fingerprint."""
    return exists(spark, f"{path}/_SUCCESS") and (read_json(spark, f"{path}/_meta.json") or {}).get("fingerprint") == print_


def checkpointed(spark: SparkSession, path: str, print_: str, make) -> DataFrame:
    """The table at ``path`` if its fingerprint is the wanted one; else ``make()``, written there."""
    if not done(spark, path, print_):
        save(make(), path, {"fingerprint": print_})
    return spark.read.parquet(path)


def ranked_lists(lists: DataFrame, path: str) -> None:
    """A folder for each retriever and pool source, in order of query and rank."""
    lists.repartition("retriever", "pool_source", F.pmod(F.xxhash64("s1"), F.lit(64))).sortWithinPartitions("s1", "rank").write.mode("overwrite").partitionBy("retriever", "pool_source").parquet(path)


def vector_chunks(vectors: DataFrame, path: str, chunk_rows: int, dim: int) -> None:
    """Chunks of a vector store; chunks that are there stay, a store of another size is refused."""
    spark = vectors.sparkSession
    said = read_json(spark, f"{path}/_meta.json")
    if said is not None and said["dim"] != dim:
        raise ValueError(f"{path} holds vectors of {said['dim']}, not {dim}")
    write_json(spark, f"{path}/_meta.json", {"dim": dim, "chunk_rows": chunk_rows})
    df = vectors.withColumn("chunk", F.floor(F.col("row_no") / chunk_rows).cast("int"))
    here = [r["chunk"] for r in df.select("chunk").distinct().collect() if exists(spark, f"{path}/chunk={r['chunk']}")]
    todo = df.where(~F.col("chunk").isin(here)) if here else df
    todo.repartition("chunk").write.mode("append").partitionBy("chunk").parquet(path)


def submission(lists: DataFrame, path: str, column: str) -> None:
    """source1_entity_id and a list of ids, tab-separated without quotes, in the order of row_no.

    Range partitions keep the order over part files, so no single task writes it all.
    """
    out = lists.repartitionByRange("row_no").sortWithinPartitions("row_no")
    out.select(F.col("s1").alias("source1_entity_id"), F.col("ids").alias(column)).write.mode("overwrite").option("emptyValue", "").csv(path, sep="\t", header=True, quote="")


def log_metric(spark: SparkSession, path: str, row: dict) -> None:
    """One line in a folder of JSON lines."""
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def npy_chunks(vectors: DataFrame, path: str) -> None:
    """Each chunk (columns chunk, row_no, vec) as one array in the ``.npy`` format, in the order of row_no."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_no")
        held = io.BytesIO()
        np.save(held, np.array(table["vec"].to_pylist(), np.float32), allow_pickle=False)
        return pa.Table.from_arrays([table["chunk"].slice(0, 1), pa.array([held.getvalue()], pa.binary())], ["chunk", "npy"])

    vectors.select("chunk", "row_no", "vec").groupBy("chunk").applyInArrow(run, "chunk long, npy binary").write.parquet(path)

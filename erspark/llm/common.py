"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as the inside of a character class and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path may be one that only Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and everything runs in one process,
    as in tests, a temporary folder takes its place and is remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="erspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it was running, not everything before them, and a frame that
    several branches use is computed once. What was written is deleted when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete what ``materialize`` wrote; no frame that is still to be computed may read it."""
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        system, where = _file_system(written.sparkSession, folder)
        system.delete(where, True)


def kept_columns(df: DataFrame, *own: str) -> list[str]:
    """The caller's columns that an operator hands on: all but its input column and those it makes itself."""
    return [c for c in df.columns if c not in own]


def packed(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``__own``, the caller's columns as one struct, and ``__text``, null as empty: no name can clash with an operator's."""
    return df.select(F.struct(F.lit(True).alias("__row"), *[df[f"`{c}`"] for c in keep]).alias("__own"), empty_texts(df, text).alias("__text"))


def unpacked(keep: list[str]) -> list[Column]:
    return [F.col("__own")[c].alias(c) for c in keep]


def cut(start: Column, end: Column) -> Column:
    """Text of one span, ``start:end``."""
    return F.concat(start.cast("string"), F.lit(":"), end.cast("string"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of every span (struct start, ord, kind, end), by start and then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(s["kind"], F.lit(":"), cut(s["start"], s["end"]))), ",")


def empty_texts(df: DataFrame, text: str = "text") -> Column:
    """The text column, with null as the empty text."""
    return F.coalesce(df[f"`{text}`"], F.lit(""))

"""Values of all pairs of two sides that share a key, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.functions import bulk

# Records of a side that a task holds at once, pairs of different texts that it scores at once, rows that it hands on at once.
BLOCK, AT_ONCE, ROWS = 1024, 1 << 17, 1 << 16


def scored(records: DataFrame, key: list[str], kernel: bulk.Kernel, digits: int | None = None) -> DataFrame:
    """s1, pool, value of every pair of a record of the left side and one of the other that have the same key.

    ``records`` has the key's columns, left (whether it is of that side), id and text, which is not null; a null key equals none.
    Keys of more than ``BLOCK`` records a side are cut into blocks, and a row holds one block of either side, so that neither a
    task nor a row grows with a key's pairs. Those keys are broadcast: they are at most one in ``BLOCK`` of the records. Inside
    a row each pair of different texts is scored once. The number of partitions is fixed, as few bytes make many pairs.
    """
    spark, kind = records.sparkSession, records.schema["id"].dataType.simpleString()
    records = records.where(" and ".join(f"`{k}` is not null" for k in key))
    side = lambda here, there: F.when(F.col("left"), here).otherwise(there)
    blocks = lambda c: F.greatest(F.ceil(F.count_if(c) / BLOCK), F.lit(1)).cast("int")
    hot = records.groupBy(*key).agg(blocks(F.col("left")).alias("nl"), blocks(~F.col("left")).alias("nr")).where("nl > 1 or nr > 1")
    dealt = records.join(F.broadcast(hot), key, "left").na.fill(1, ["nl", "nr"])
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id", "text"), side(F.col("nl"), F.col("nr"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), side(F.col("nr"), F.col("nl")) - 1)))
    dealt = dealt.select(*key, side(F.col("mine"), F.col("other")).alias("i"), side(F.col("other"), F.col("mine")).alias("j"), "left", "id", "text")
    at = [*key, "i", "j"]
    members = lambda c: F.collect_list(F.when(c, F.struct("id", "text")))
    met = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *at).groupBy(*at).agg(members(F.col("left")).alias("l"), members(~F.col("left")).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [b.column(k).value_lengths().to_numpy() for k in (0, 1)]
            (left, a), (right, c) = (b.column(k).flatten().flatten() for k in (0, 1))
            said = pa.concat_arrays([a, c]).dictionary_encode()
            texts, codes = said.dictionary.to_pylist(), said.indices.to_numpy().astype(np.int64)
            ends = [np.cumsum(s) for s in sizes]
            groups, rows, n, waiting = [], [], 0, 0

            def values(texts=texts) -> Iterator[tuple]:
                got = kernel(texts, np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups]))
                got = got if digits is None else bulk.rounded(got, digits)
                begin = 0
                for x, _, i, j, l0, r0 in groups:
                    grid = got[begin : begin + len(x)].reshape(int(i.max()) + 1, -1)
                    begin += len(x)
                    step = max(1, ROWS // len(j))
                    for k in range(0, len(i), step):
                        some = i[k : k + step]
                        yield np.repeat(np.arange(l0 + k, l0 + k + len(some)), len(j)), np.tile(np.arange(r0, r0 + len(j)), len(some)), grid[some][:, j].ravel()

            def batch(left=left, right=right) -> pa.RecordBatch:
                s1, pool, value = (np.concatenate(x) for x in zip(*rows, strict=True))
                rows.clear()
                return pa.RecordBatch.from_arrays([left.take(pa.array(s1)), right.take(pa.array(pool)), pa.array(value)], ["s1", "pool", "value"])

            for g in range(b.num_rows):
                l0, r0 = int(ends[0][g] - sizes[0][g]), int(ends[1][g] - sizes[1][g])
                u, i = np.unique(codes[l0 : l0 + sizes[0][g]], return_inverse=True)
                v, j = np.unique(codes[len(a) + r0 : len(a) + r0 + sizes[1][g]], return_inverse=True)
                groups.append((np.repeat(u, len(v)), np.tile(v, len(u)), i, j, l0, r0))
                waiting += len(u) * len(v)
                if waiting >= AT_ONCE or g + 1 == b.num_rows:
                    for row in values():
                        rows.append(row)
                        n += len(row[0])
                        if n >= ROWS:
                            yield batch()
                            n = 0
                    groups.clear()
                    waiting = 0
            if rows:
                yield batch()

    return met.where((F.size("l") > 0) & (F.size("r") > 0)).select("l", "r").mapInArrow(run, f"s1 {kind}, pool {kind}, value double")

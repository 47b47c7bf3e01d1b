"""The best pairs of every pool record, moved in compressed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs that a task holds before it leaves out those that win nothing, rows that it hands on at once.
HELD, ROWS = 1 << 19, 1 << 16


def firsts(pairs: pa.Table, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that ``winners`` keeps, by place, and the ``until`` of each."""
    pool = pairs["pool"].combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    s1 = pc.rank(pairs["s1"], "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    p, field = pairs["p"].to_numpy(), pairs["field"].to_numpy().astype(np.int64)
    order = np.lexsort((s1, -np.nan_to_num(p, nan=np.inf, posinf=np.inf), ~np.isnan(p), pool))  # NaN is the largest, as in Spark
    group = np.cumsum(np.diff(pool[order], prepend=-1) != 0) * sets
    least = np.minimum.accumulate(field[order] - group)  # each pool's values are below those of the pools before it
    until = np.minimum(np.concatenate([[sets], least[:-1]]) + group, sets)
    won = field[order] < until
    at = order[won]
    return np.sort(at), until[won][np.argsort(at)]


def winners(pairs: DataFrame, sets: int) -> DataFrame:
    """The pairs that come first in their pool, by falling p and s1, among its pairs with a field of at most k, for some k below
    ``sets``; such k are those from field up to ``until``, which is left out.

    ``pairs`` has s1, pool, p and field, the last two not null; other columns are handed on. A pool has at most ``sets`` such
    pairs, so a task leaves out others both before and after pairs move, and none has to hold a pool's pairs. They move as
    columns under zstd, a row for each block of a task and target.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            t = t.take(firsts(t, sets)[0])
            target = t["target"].to_numpy()
            order = np.argsort(target, kind="stable")
            t = t.drop_columns("target").take(order).combine_chunks()
            targets, begins = np.unique(target[order], return_index=True)
            for to, begin, end in zip(targets, begins, [*begins[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(t.slice(begin, end - begin))
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["target", "block"])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= HELD:
                yield from dealt(held)
                held, rows = [], 0
        if rows:
            yield from dealt(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, most = [], 0, HELD
        for b in batches:
            for block in b.column("block"):
                held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
                rows += len(held[-1])
                if rows >= most:
                    t = pa.concat_tables(held)
                    held = [t.take(firsts(t, sets)[0]).combine_chunks()]
                    rows = len(held[0])
                    most = max(HELD, 2 * rows)
        if rows:
            t = pa.concat_tables(held)
            at, until = firsts(t, sets)
            yield from t.take(at).append_column("until", pa.array(until, pa.int32())).to_batches(ROWS)

    blocks = pairs.withColumn("target", F.pmod(F.xxhash64("pool"), F.lit(n)).cast("int")).mapInArrow(pack, "target int, block binary")
    return blocks.repartitionById(n, "target").mapInArrow(unpack, pairs.withColumn("until", F.lit(0)).schema)

"""Connected components of a link table, without collecting links or nodes anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.llm.common import discard, materialize


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: each batch of them as stars around its smallest nodes. Needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root: dict[int, int] = {}

            def top(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]  # noqa: B023
                return x

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            nodes = np.array(list(root), np.int64)
            roots = np.array([top(x) for x in root], np.int64)
            apart = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def smallest_reachable(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link; ``links`` has columns a and b.

    Alternates the large-star and small-star steps (Kiveris et al., 2014). Each step hangs neighbours on the smallest
    node seen and writes its links to the shared folder; the number of rounds grows with the logarithm of the longest
    path, which contracting the links of each batch beforehand makes short. A hot node only ever costs rows in proportion to its links: minima are taken by partial aggregation and joined
    back, and no neighbourhood is gathered.
    """
    now = materialize(contracted(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))).distinct(), "links")
    last = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, materialize(small, "small")
        discard(before)
        discard(large)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"links not settled after {most_rounds} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

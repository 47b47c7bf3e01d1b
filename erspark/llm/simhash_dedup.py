"""Near-duplicates by SimHash, with links found by the pigeonring principle.

A fingerprint is cut into a ring of segments. If two fingerprints differ in at most ``tau`` bits, then from some segment on
every chain of consecutive segments differs in no more than its proportional share of ``tau``. So pairs are looked up by
the first segments of a chain, chains are followed while they stay within budget, and only what survives is compared in full.
How many segments the lookup takes depends on how many fingerprints there are: more segments make groups smaller, and every
difference that their budgets allow is probed, so that no link depends on the choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from erspark.llm.common import kept_columns, materialize, packed, read_table, unpacked
from erspark.llm.components import smallest_reachable

BITS = 64
#: Fingerprints of one segment value that are compared with each other in one go; larger groups go block against block.
BLOCK = 4096
#: See ``depth_for``.
LOAD, PROBES = 512, 2000
_SPACES = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)} | {ord(c): 0x20 for c in _SPACES}


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle, repeats included; a shorter text is one shingle, an empty one none."""
    words = [w for w in text.translate(_LOWER).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - width + 1].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[width - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if set in over half of them."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash over the XXH64 (seed 42) of all ``width``-word shingles."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """``docs`` without its text and any column named fp, with ``fp`` (long, the fingerprint's bits). Null texts are empty."""
    keep = kept_columns(docs, text, "fp")
    df = packed(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["__own", "fp"])

    return df.mapInArrow(run, StructType([df.schema["__own"], StructField("fp", LongType())])).select(*unpacked(keep), "fp")


def segments_of(count: int) -> list[int]:
    """Widths of the ring's segments."""
    return [BITS // count + (i < BITS % count) for i in range(count)]


def masks_of(count: int) -> list[int]:
    """Bit mask of each segment, from the lowest bits on."""
    out, at = [], 0
    for w in segments_of(count):
        out.append(((1 << w) - 1) << at)
        at += w
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def budgets(tau: int, count: int) -> list[int]:
    """What a chain of 1, 2, ... segments may differ in."""
    return [n * tau // count for n in range(1, count + 1)]


def _flips(masks: list[int], start: int, depth: int, tau: int) -> list[int]:
    """Every difference in the first ``depth`` segments of the chain from ``start`` that stays within its budgets."""
    out = [0]
    for n, most in enumerate(budgets(tau, len(masks))[:depth]):
        mask = masks[(start + n) % len(masks)]
        bits = [1 << i for i in range(BITS) if mask >> i & 1]
        out = [f | sum(c) for f in out for r in range(most - f.bit_count() + 1) for c in combinations(bits, r)]
    return out


def depth_for(n: int, tau: int, count: int) -> int:
    """Segments that the lookup of ``n`` fingerprints takes: the fewest that leave ``LOAD`` fingerprints or less for one probe
    of an evenly spread set, as long as a fingerprint has no more than ``PROBES`` probes."""
    masks = masks_of(count)
    depth = 1
    while depth < count - 1 and n / 2 ** sum(segments_of(count)[:depth]) > LOAD:
        if sum(len(_flips(masks, i, depth + 1, tau)) for i in range(count)) > PROBES:
            break
        depth += 1
    return depth


def chain_links(a: np.ndarray, b: np.ndarray, segment: int, tau: int, masks: list[int]) -> np.ndarray:
    """Places of the pairs (a, b) whose chain from ``segment`` stays within budget at every length, the full one last."""
    left = np.arange(len(a))
    diff = a ^ b
    chain, m = 0, len(masks)
    for n in range(1, m + 1):
        chain |= masks[(segment + n - 1) % m]
        ok = np.bitwise_count(diff & np.uint64(chain)) <= n * tau // m
        left, diff = left[ok], diff[ok]
        if not len(left):
            break
    return left


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of links between values."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def linked(left: np.ndarray, right: np.ndarray, near: np.ndarray, segment: int, tau: int, masks: list[int]) -> list[tuple[int, int]]:
    """Links between two sets of fingerprints, reduced to a forest as rows of the block matrix go by. Of two that both stand
    at their own value (``right`` where not ``near``), the smaller one is taken from the left."""
    out: list[tuple[int, int]] = []
    rows = max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        a, b = np.repeat(part, len(right)), np.tile(right, len(part))
        fresh = (a < b) | (np.tile(near, len(part)) & (a != b))
        a, b = a[fresh], b[fresh]
        hit = chain_links(a, b, segment, tau, masks)
        if len(hit):
            out = forest([*out, *zip(a[hit].tolist(), b[hit].tolist(), strict=True)])
    return out


def _probe(segment: int, mask: int):
    """From bits to flip to the chain's key; ``near`` tells a probe from the fingerprint's own place."""
    return lambda flip: F.struct(F.lit(segment).alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(flip).alias("val"), (flip != 0).alias("near"))


def links_of(fps: DataFrame, tau: int = 4, segments: int = 5, block: int = BLOCK, depth: int | None = None) -> DataFrame:
    """(a, b): links that connect every pair of distinct ``fp`` values within ``tau`` bits.

    Each fingerprint stands at its own value of the first ``depth`` segments of each chain, and probes the values that the
    chain's budgets leave within reach; one of the two ends of a link finds the other. A group that shares a value is cut
    into blocks of about ``block``, dealt by hash; a task compares one block with itself or with one other, so no task holds
    more than two blocks however hot the value is, and emits a spanning forest, never all pairs. Links do not depend on
    ``segments`` and ``depth``; the default depth goes by the number of fingerprints (``depth_for``).
    """
    masks = masks_of(segments)
    if depth is None:
        depth = depth_for(fps.count(), tau, segments)
    chain = [sum(masks[(i + n) % segments] for n in range(depth)) for i in range(segments)]
    each = F.concat(*[F.transform(F.lit([_signed(f) for f in _flips(masks, i, depth, tau)]), _probe(i, m)) for i, m in enumerate(chain)])
    keyed = fps.select("fp", F.explode(each).alias("k")).select("fp", "k.seg", "k.val", "k.near")
    sizes = keyed.groupBy("seg", "val").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("own")).where("n > 1 and own > 0").select("seg", "val", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, ["seg", "val"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # Task (i, j) with i <= j compares blocks i and j: a block is sent to every pair that it is part of.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    dealt = dealt.withColumn("t", F.explode(others)).select("seg", "val", "t.i", "t.j", "mine", "near", "fp")
    dealt = dealt.repartition("seg", "val", "i", "j").sortWithinPartitions("seg", "val", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        out: list[tuple[int, int]] = []

        def close(cols: tuple[np.ndarray, ...]) -> None:
            seg, _, i, j, mine, near, fp = cols
            fp = fp.view(np.uint64)
            for x, y in {(i[0], j[0]), (j[0], i[0])}:
                out.extend(linked(fp[(mine == x) & ~near], fp[mine == y], near[mine == y], int(seg[0]), tau, masks))

        def made() -> pa.RecordBatch:
            pairs = np.array([(min(p), max(p)) for p in out], np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(cols[0]):
                continue
            if held:
                cols = tuple(np.concatenate([*(h[k] for h in held), c]) for k, c in enumerate(cols))
            edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1])) + 1
            bounds = [0, *edge.tolist()]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a > 1:
                    close(tuple(c[a:b] for c in cols))
            held = [tuple(c[bounds[-1] :] for c in cols)]
            if out:
                yield made()
        if held and len(held[0][0]) > 1:
            close(held[0])
        yield made()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = 4, segments: int = 5) -> DataFrame:
    """``docs`` without its text, with ``fp`` and ``component_id``, the smallest id that links lead to.

    Equal fingerprints are one node. Links, nodes and components stay in tables. Null ids take part in linking, but never
    name a component unless they have no other. The caller's columns named fp or component_id give way.
    """
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept_columns(docs, text, "fp", "component_id")]).alias("__own"), docs[f"`{doc_id}`"].alias("__id"), docs[f"`{text}`"].alias("__text"))
    df = materialize(fingerprints(own, "__text"), "simhash")
    nodes = materialize(df.groupBy("fp").agg(F.min("__id").alias("least")), "nodes")
    roots = smallest_reachable(links_of(nodes.select("fp"), tau, segments))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return df.join(named.join(ids, "root").select("fp", "component_id"), "fp", "left").select("__own.*", "fp", "component_id")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null and empty texts have fingerprint zero and link like any other; a text of any length is hashed whole; repeated rows
    stay, and a bit that exactly half of the hashes have is 0; an empty table gives no rows. The smallest id names a
    component, so ties cannot arise. Columns besides doc_id and text are not read.
    """
    df = components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

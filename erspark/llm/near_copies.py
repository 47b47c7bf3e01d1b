"""Near copies by the Jaccard similarity of word shingles, as a stage that SimHash links lead.

Texts with equal shingle sets are one node. Candidates are the links of ``simhash_dedup`` between fingerprints of the same
shingles and, as a fingerprint of 64 bits cannot tell a similarity of 0.8 from less, nodes that agree in a band of MinHash
values. A pair at 0.8 agrees in no band with a chance of 3e-6 (``(1 - 0.8 ** ROWS) ** BANDS``), a closer pair with less. A
candidate is a link only if the similarity of the whole sets reaches the threshold.

Sets are compared in rounds, and only between nodes that are in different components by then: first each node with the most
similar of the nodes that lead its groups, then with the others of those, and at last, inside each group, with the rest of it.
A group hands on a forest of links, not its pairs. The share of equal MinHash values settles beforehand which pairs are far
apart. Joins that move texts or sets are merge joins at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erspark.llm.common import discard, empty_texts, materialize
from erspark.llm.components import smallest_reachable
from erspark.llm.simhash_dedup import links_of, majority, shingle_hashes

#: The default rule of near-duplicate stages: five-word shingles, a similarity of 4 / 5 or more.
WIDTH, OVER, UNDER = 5, 4, 5
BANDS, ROWS = 24, 4
#: A pair with a smaller share of equal MinHash values is left: at 0.8, that share is below 0.6 with a chance of 5e-7.
LEAST_EQUAL = 0.6 * BANDS * ROWS
#: Parts into which the pairs of one node are dealt, and nodes of one group that are compared in one go.
SALTS, BLOCK = 64, 2048
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 of a text's ``width``-word shingles, sorted; a shorter text is one shingle."""
    return np.unique(shingle_hashes(text, width))


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """The node that a set of sorted hashes is, its band values (both signed), and 16 bits of each MinHash value."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + 4096]).min(axis=1))
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        value = (value ^ column) * _MIX
        value ^= value >> np.uint64(29)
    node = int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))
    return node, value.view(np.int64), ((least * _MIX) >> np.uint64(48)).astype("<u2").tobytes()


def sketches(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep``, node, fp, bands, size and sig of each row. Null texts are empty."""
    df = rows.select(F.struct(*keep).alias("__own"), empty_texts(rows, text).alias("__text"))
    own = df.schema["__own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, bands, size, sig = [], [], [], [], []
            for t in b.column(1):
                hashes = shingle_hashes(t.as_py(), WIDTH)
                fp.append(majority(hashes))
                hashes = np.unique(hashes)
                n, v, s = sketch(hashes)
                node.append(n)
                bands.append(v)
                size.append(len(hashes))
                sig.append(s)
            fps = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), fps, pa.array(bands, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], ["__own", "node", "fp", "bands", "size", "sig"])

    return df.mapInArrow(run, f"__own {own}, node long, fp long, bands array<long>, size long, sig binary").select("__own.*", "node", "fp", "bands", "size", "sig")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, set) from (node, text); a set is its sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py() or "").tobytes() for t in b.column(1)], pa.binary())], ["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of sorted hashes reach the threshold."""
    if OVER * max(len(x), len(y)) > UNDER * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return UNDER * both >= OVER * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. The pairs of a hot node are dealt over ``SALTS`` keys."""
    pairs = pairs.select("a", "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    left = pairs.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
    both = pairs.join(left.hint("merge"), ["a", "salt"]).join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [near(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _equal(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """Equal MinHash values of each row of x and of y, or 0 for a pair that is out of the threshold's reach: by its sizes, or
    by too few equal values."""
    equal = (x == y).sum(axis=1)
    equal[(OVER * np.maximum(size_x, size_y) > UNDER * np.minimum(size_x, size_y)) | (equal < LEAST_EQUAL)] = 0
    return equal


def hopeful(pairs: DataFrame) -> DataFrame:
    """(a, b, equal) of the rows (a, b, sig_a, sig_b, size_a, size_b) that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for k in (2, 3))
                equal = _equal(x, y, part.column(4).to_numpy(), part.column(5).to_numpy())
                keep = pa.array(equal > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(equal[equal > 0], pa.int64())], ["a", "b", "equal"])

    return pairs.select("a", "b", "sig_a", "sig_b", "size_a", "size_b").mapInArrow(run, "a long, b long, equal long")


def across(members: DataFrame) -> DataFrame:
    """(a, b): links that connect the nodes of each group ``v`` that are near copies in different components ``root``.

    Columns: v, band, root, node, size, sig, bands, set. A group is cut into blocks of about ``BLOCK``, and a task compares one
    block with itself or with one other. A pair is looked at in the first band that it agrees in, while its ends are in
    different components, and only if sizes and MinHash values leave it within reach.
    """
    sizes = members.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low < high").select("v", "blocks")
    dealt = members.join(sizes, "v").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    dealt = dealt.withColumn("t", F.explode(others)).select("v", "t.i", "t.j", "mine", "band", "root", "node", "size", "sig", "bands", "set")
    dealt = dealt.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links() -> list[tuple[int, int]]:
            i, j, band = held[0][1], held[0][2], held[0][4]
            mine, root, node, size = (np.array([r[k] for r in held], np.int64) for k in (3, 5, 6, 7))
            sig = np.frombuffer(b"".join(r[8] for r in held), "<u2").reshape(-1, BANDS * ROWS)
            bands = np.array([r[9] for r in held], np.int64)
            sets = [np.frombuffer(r[10], np.uint64) for r in held]
            out = []
            for x in np.flatnonzero(mine == i).tolist():
                y = np.flatnonzero((mine == j) & (root != root[x]) & ((node > node[x]) if i == j else True))
                y = y[(bands[y] == bands[x]).argmax(axis=1) == band]
                equal = _equal(sig[y], sig[x][None, :], size[y], size[x])
                for k in np.argsort(-equal, kind="stable")[: int((equal > 0).sum())].tolist():
                    if root[y[k]] != root[x] and near(sets[x], sets[y[k]]):
                        out.append((min(node[x], node[y[k]]), max(node[x], node[y[k]])))
                        root[root == root[y[k]]] = root[x]
            return out

        def made(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield made(links())
                    held.clear()
                held.append(row)
        if held:
            yield made(links())

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def components(rows: DataFrame, key: list[str], text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``more`` of each row with ``root``: equal for rows that links connect. ``key`` tells texts apart, without nulls."""
    own = materialize(sketches(rows, [*key, *more], text), "sketches")
    nodes = materialize(own.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "bands", "size", "sig")]), "nodes")
    grouped = nodes.select("node", F.posexplode("bands").alias("band", "v"))
    lead = grouped.groupBy("v").agg(F.min("node").alias("m"), F.max("node").alias("most")).where("m < most").select("v", "m")
    members = materialize(grouped.join(materialize(lead, "groups").hint("merge"), "v").select("v", "band", "m", "node"), "members")
    # Fingerprints that SimHash links, each as the smallest of its nodes; nodes of one fingerprint follow their smallest.
    shared = nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("m"))
    links = links_of(shared.select("fp"))
    close = links.join(shared.select(F.col("fp").alias("a"), F.col("m").alias("x")), "a").join(shared.select(F.col("fp").alias("b"), F.col("m").alias("y")), "b").select("x", "y")
    same = nodes.join(shared, "fp").where("node <> m").select(F.col("m").alias("x"), F.col("node").alias("y"))
    found = members.where("m <> node").select(F.col("m").alias("x"), F.col("node").alias("y")).unionByName(close).unionByName(same)
    found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for end in ("a", "b"):
        found = found.join(nodes.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}"), F.col("size").alias(f"size_{end}")).hint("merge"), end)
    star = materialize(hopeful(found), "candidates")

    # One row of each node that has a candidate lends its text.
    wanted = members.select("node").union(star.select("a")).union(star.select("b")).distinct()
    lent = own.join(wanted, "node").groupBy("node").agg(F.min(F.struct(*key)).alias("k")).select("node", "k.*")
    sets = materialize(shingle_sets(rows.join(materialize(lent, "lent").hint("merge"), key).select("node", text)).dropDuplicates(["node"]), "sets")

    best = star.groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a")).select("a", "b")
    first = materialize(verified(best, sets), "links")
    roots = smallest_reachable(first)
    second = materialize(verified(_apart(star, roots).join(best, ["a", "b"], "left_anti"), sets), "links")
    placed = members.join(roots, "node", "left").select("v", "band", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("v")
    placed = placed.join(mixed, "v", "left_semi").join(nodes.select("node", "size", "sig", "bands").hint("merge"), "node").join(sets.hint("merge"), "node")
    third = materialize(across(materialize(placed, "mixed")), "links")
    if not (second.isEmpty() and third.isEmpty()):
        roots = smallest_reachable(first.union(second).union(third))
    discard(sets)
    return own.select(*key, *more, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the smallest id; one without an id if none has any.

    Rows are told apart by hashes of all their columns and of the text, not by id: null and repeated ids lose no text, and
    a row that is there twice stays once. Null, empty and blank texts are one node; an empty table stays empty. Names that
    begin with two underscores are the operator's own.
    """
    key = ["__all", "__text_hash"]
    hashes = [F.xxhash64(*docs.columns).alias(key[0]), F.xxhash64(F.lit(1), docs[f"`{text}`"]).alias(key[1])]
    rows = docs.select(docs[f"`{doc_id}`"].alias("__id"), docs[f"`{text}`"].alias("__text"), *hashes)
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), *key)).alias("first")
    keep = components(rows, key, "__text", ("__id",)).groupBy("root").agg(first).select(*[f"first.{k}" for k in key])
    return docs.select("*", *hashes).join(keep.hint("merge"), key, "left_semi").dropDuplicates(key).select(*docs.columns)

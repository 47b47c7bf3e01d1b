"""Packing of documents into training sequences of several permitted lengths.

Best-fit decreasing over bins of variable capacity: an item goes to the open bin that it fills best. Where none has room, a
bin is opened in the permitted size of least cost: that which costs least for each token that the bin would hold, once the
items still to come have filled it. At last each bin shrinks to the cheapest size that holds its contents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm.common import kept_columns, materialize, packed, read_table, unpacked

#: Where the public byte-level BPE vocabulary lies; every caller may name another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation pattern of that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Bins:
    """Permitted sequence lengths, and what a sequence costs besides its tokens (in tokens): something for itself, and for
    attention, which takes the square of its length."""

    sizes: tuple[int, ...] = (512, 1024, 2048, 4096)
    overhead: int = 16
    attention: float = 2.0**-16
    separator: int = 1
    shard_items: int = 20_000

    def cost(self, size: int) -> float:
        return size + self.overhead + self.attention * size * size


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens of each whole text (in place of a column of that name).

    The vocabulary's file travels as a broadcast: its size is the vocabulary's, whatever the data's.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = kept_columns(docs, text, "n_tokens")
    df = packed(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        encode = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["__own", "n_tokens"])

    return df.mapInArrow(run, f"__own {df.schema['__own'].dataType.simpleString()}, n_tokens long").select(*unpacked(keep), "n_tokens")


def filled(n: int, size: int, coming: list[int], lengths: int) -> int:
    """What a bin opened for an item of ``n`` tokens would hold, if the longest items still to come that fit went into it.

    ``coming`` counts the items of each length, ``lengths`` has a bit for each length of which there are any.
    """
    load, taken = n, {}
    while fits := lengths & ((1 << (size - load + 1)) - 1):
        m = fits.bit_length() - 1
        k = min(coming[m] - taken.get(m, 0), (size - load) // m)
        if not k:  # those are in it already
            lengths ^= 1 << m
            continue
        taken[m] = taken.get(m, 0) + k
        load += k * m
    return load


def best_fit(lengths: list[int], bins: Bins, opened: int | None = None) -> tuple[list[int], list[int]]:
    """Bin of each item, and the load of each bin. ``lengths`` descend.

    A new bin has the size that costs least for each token that it would hold, or, if ``opened`` is given, that size or the
    next one that the item needs.
    """
    at, load = [], []
    rooms: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has r tokens of room
    coming = [0] * (bins.sizes[-1] + 1)
    for n in lengths:
        coming[n] += 1
    there = sum(1 << n for n, c in enumerate(coming) if c)
    for n in lengths:
        coming[n] -= 1
        if not coming[n]:
            there ^= 1 << n
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            possible = [s for s in bins.sizes if s >= n]
            if opened is not None:
                room = min(s for s in possible if s >= min(opened, bins.sizes[-1]))
            else:
                held = {s: filled(n, s, coming, there) for s in possible}
                room = min(possible, key=lambda s: (bins.cost(shrunk(held[s], bins)) / held[s], -s))  # noqa: B023
            k = len(load)
            load.append(0)
        at.append(k)
        load[k] += n
        left = room - n
        if left:
            rooms.setdefault(left, []).append(k)
            mask |= 1 << left
    return at, load


def shrunk(load: int, bins: Bins) -> int:
    """The cheapest permitted size that holds a bin's contents."""
    return min((s for s in bins.sizes if s >= load), key=bins.cost)


def pack(lengths: list[int], bins: Bins = Bins()) -> tuple[list[int], list[int]]:
    """Bin of each item (any order of items), and the size of each bin.

    Sizes are chosen bin by bin; a plan that opens one size throughout takes its place only where it is cheaper. Items of
    equal length keep their order.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    plans = []
    for n, opened in enumerate((None, *bins.sizes)):
        at, load = best_fit([lengths[i] for i in order], bins, opened)
        sizes = [shrunk(x, bins) for x in load]
        plans.append((sum(map(bins.cost, sizes)), n, at, sizes))
    _, _, at, sizes = min(plans, key=lambda p: p[:2])
    out = [0] * len(lengths)
    for i, k in zip(order, at, strict=True):
        out[i] = k
    return out, sizes


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bins: Bins = Bins(), vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, n_tokens, bin_id, bin_size, offset.

    A document has its tokens and a separator; one that is longer than the largest size is cut into pieces of that size and
    a rest. A document without tokens (null or empty) has one row, without a bin. Items are dealt by hash to shards of about
    ``shard_items``, so that each packing task has the same size however large the corpus is; lengths alone are dealt, not
    texts. The plan depends on ids and texts only, not on the order or the files of the rows: a repeated row is told from its
    likes by its number among them, and packed for itself. No other column than id and text is read.
    """
    top = max(bins.sizes)
    own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("hash"), docs[f"`{text}`"].alias("text"))
    counted = materialize(token_counts(own, vocabulary), "tokens").groupBy("doc_id", "hash", "n_tokens").agg(F.count("*").alias("copies"))
    length = F.when(F.col("n_tokens") > 0, F.col("n_tokens") + bins.separator).otherwise(F.lit(0))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / top), F.lit(1)) - 1)
    items = counted.select("doc_id", "hash", length.alias("length"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    items = items.withColumn("piece", F.explode(pieces)).withColumn("start", F.col("piece") * top).withColumn("n_tokens", F.least(F.lit(top), F.col("length") - F.col("start")))
    items = materialize(items.select("doc_id", "hash", "copy", "piece", "start", "n_tokens"), "lengths")
    shards = max(1, -(-items.count() // bins.shard_items))
    dealt = items.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "hash", "copy", "piece"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("n_tokens", "descending"), ("doc_id", "ascending"), ("hash", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        table = table.take(order)
        lengths = table["n_tokens"].to_pylist()
        at, sizes = pack(lengths, bins)
        load, offset = [0] * len(sizes), []
        for k, n in zip(at, lengths, strict=True):
            offset.append(load[k])
            load[k] += n
        first = table["shard"][0].as_py() << 32
        made = [pa.array([first + k for k in at], pa.int64()), pa.array([sizes[k] for k in at], pa.int64()), pa.array(offset, pa.int64())]
        return pa.Table.from_arrays([*(table[c] for c in ("doc_id", "piece", "start", "n_tokens")), *made], ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_size", "offset"])

    kind = items.schema["doc_id"].dataType.simpleString()
    placed = dealt.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece long, start long, n_tokens long, bin_id long, bin_size long, offset long")
    none = F.lit(None).cast("long")
    return placed.unionByName(items.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", none.alias("bin_id"), none.alias("bin_size"), none.alias("offset")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of all of ``documents``; see ``pack_documents``.

    Null and empty texts have no tokens and no bin; long texts are cut into pieces; items of equal length are packed in the
    order of their ids; repeated rows are packed each; an empty table gives no rows. Columns besides doc_id and text are not
    read.
    """
    return pack_documents(read_table(spark, sf_dir, "documents"))

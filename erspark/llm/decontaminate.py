"""Benchmark decontamination by the q-gram lemma.

A passage within k edits of an item of m characters shares at least m + 1 - q - kq of its q-grams, on diagonals that lie
within k of each other. Shared q-grams are counted in overlapping bands of diagonals; a band that reaches the bound is
verified by alignment inside the band.

Not all q-grams of an item need to be looked up. An edit spoils q neighbours at most, so k edits spoil kq at most, and none of
k edits can spoil all of a set that takes more than k of them to be covered by runs of q. Each item is indexed by its rare
q-grams, and by frequent ones only until it has such a set: a stem that thousands of items share costs nothing where it stands.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm.common import materialize, read_table

HIT = "array<struct<item_id:long,start:long,end:long,edits:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
SPACE = np.uint32(0x20)
#: Bands of one document, with items of one length, from which on they are aligned together.
MANY = 8


@dataclass(frozen=True)
class Budget:
    """q-gram length, edits per character of an item, and what bounds memory: characters of items in one broadcast block,
    blocks that are alive at a time, postings that a q-gram has before it counts as frequent, postings looked at in one go."""

    q: int = 8
    rate: float = 0.08
    block_chars: int = 4_000_000
    chain: int = 8
    frequent: int = 32
    slice: int = 1_000_000

    def edits(self, m: int) -> int:
        """Edits allowed for an item of m characters, so that the lemma still asks for one shared q-gram at least."""
        return max(0, min(int(self.rate * m), (m - self.q) // self.q))


def _lower() -> np.ndarray:
    out = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if chr(c).isspace():
            out[c] = SPACE
        elif len(low := chr(c).lower()) == 1:
            out[c] = ord(low)
    return out


_TABLE: list[np.ndarray] = []


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with runs of white space as one space, and the place of each in the text."""
    if not _TABLE:
        _TABLE.append(_lower())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 1 << 16, _TABLE[0][np.minimum(codes, (1 << 16) - 1)], codes)
    space = codes == SPACE
    at = np.flatnonzero(~(space & np.concatenate(([True], space[:-1])))) if len(codes) else np.zeros(0, np.int64)
    if len(at) and codes[at[-1]] == SPACE:
        at = at[:-1]
    return codes[at], at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q-gram."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - q + 1, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - q + 1 + i].astype(np.uint64)
    return h ^ (h >> np.uint64(29))


def spoiling(places: np.ndarray, q: int, most: int | None = None) -> int:
    """The fewest edits that spoil the q-grams at all of these places (ascending), or one more than ``most``."""
    until, edits = -1, 0
    for p in places.tolist():
        if p > until:
            until, edits = p + q - 1, edits + 1
            if most is not None and edits > most:
                break
    return edits


class Index:
    """The rarest q-grams of a block of benchmark items. Items of equal text are one, with several ids."""

    FILTER = 22

    def __init__(self, items: list[tuple[int, str]], budget: Budget) -> None:
        self.budget = budget
        texts: dict[bytes, list[int]] = {}
        for i, t in items:
            codes = normal(t)[0]
            if len(codes):
                texts.setdefault(codes.tobytes(), []).append(i)
        self.ids = list(texts.values())
        self.codes = [np.frombuffer(t, np.uint32) for t in texts]
        self.hashes = [grams(c, budget.q) for c in self.codes]
        self.length = m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.array([budget.edits(int(x)) for x in m], np.int64)
        self.stride = 2 * self.k + 1
        every = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(self.hashes)), [len(h) for h in self.hashes])
        place = np.concatenate([np.arange(len(h)) for h in self.hashes]) if self.hashes else np.zeros(0, np.int64)
        _, where, count = np.unique(every, return_inverse=True, return_counts=True)
        often = count[where] if len(every) else np.zeros(0, np.int64)
        # Of each item the rare q-grams, and of the others the rarest, until edits within budget cannot spoil all of them.
        begins = np.concatenate(([0], np.cumsum([len(h) for h in self.hashes]))).astype(np.int64)
        chosen = [np.zeros(0, np.int64)]
        for n, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
            order = np.argsort(often[a:b], kind="stable")
            low, high = int((often[a:b] <= budget.frequent).sum()), b - a
            while low < high:  # more q-grams never take fewer edits
                middle = (low + high) // 2
                low, high = (low, middle) if spoiling(np.sort(order[:middle]), budget.q) > self.k[n] else (middle + 1, high)
            chosen.append(a + order[:low])
        taken = np.concatenate(chosen)
        self.least = np.maximum(1, np.bincount(item[taken], minlength=len(m)) - self.k * budget.q) if len(m) else np.zeros(0, np.int64)
        taken = taken[np.argsort(every[taken], kind="stable")]
        self.item, self.place = item[taken], place[taken]
        self.keys, self.first = np.unique(every[taken], return_index=True)
        self.until = np.append(self.first[1:], len(taken))
        self.filter = np.zeros(1 << self.FILTER, bool)
        self.filter[(self.keys >> np.uint64(64 - self.FILTER)).astype(np.int64)] = True
        self.short = {codes_text(c): n for n, c in enumerate(self.codes) if len(c) < budget.q}
        self.short_words = sorted({t.count(" ") + 1 for t in self.short})

    def search(self, text: str) -> list[dict]:
        """Every item that occurs in the text within its edit budget: one hit for each item, that with the fewest edits, of
        those the first."""
        codes, at = normal(text)
        best: dict[int, tuple[int, int, int]] = {}

        def found(n: int, start: int, end: int, edits: int) -> None:
            if n not in best or (edits, start) < (best[n][2], best[n][0]):
                best[n] = (start, end, edits)

        if self.short:  # no q-gram: exact occurrences as whole words
            words = codes_text(codes).split(" ")
            starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
            for width in self.short_words:
                for i in range(len(words) - width + 1):
                    n = self.short.get(" ".join(words[i : i + width]))
                    if n is not None:
                        found(n, int(starts[i]), int(starts[i]) + int(self.length[n]), 0)
        for n, band in self.near(codes, self.bands(codes)):
            hit = self.verify(codes, n, band)
            if hit:
                found(n, *hit)
        return [{"item_id": i, "start": int(at[s]), "end": int(at[e - 1]) + 1, "edits": d} for n, (s, e, d) in sorted(best.items()) for i in self.ids[n]]

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) pairs with as many shared q-grams as the lemma asks for; band b holds diagonals from b * stride on,
        two strides wide, so that neighbours overlap and every run of diagonals one stride wide lies in one of them."""
        h = grams(codes, self.budget.q)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(64 - self.FILTER)).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return []
        spot = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        same = self.keys[spot] == h[maybe]
        where, spot = maybe[same], spot[same]
        if not len(where):
            return []
        counts = self.until[spot] - self.first[spot]
        cuts = np.searchsorted(np.cumsum(counts) // self.budget.slice, np.arange(int(counts.sum()) // self.budget.slice + 1), side="right")
        low = int(-self.length.max() // self.stride.min()) - 2
        width = len(codes) - low + 3
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(spot)], strict=True):
            if a < b:
                c = counts[a:b]
                rows = np.repeat(self.first[spot[a:b]] - np.cumsum(c) + c, c) + np.arange(c.sum())
                item = self.item[rows]
                band = (np.repeat(where[a:b], c) - self.place[rows]) // self.stride[item]
                both = np.concatenate((keys, item * width + band - low, item * width + band - 1 - low))
                weight = np.concatenate((n, np.ones(2 * len(item), np.int64)))
                keys, back = np.unique(both, return_inverse=True)
                n = np.bincount(back, weight, len(keys)).astype(np.int64)
        keys = keys[n >= self.least[keys // width]]
        return [(int(x // width), int(x % width + low)) for x in keys]

    def hopeful(self, n: int, region: np.ndarray) -> bool:
        """Whether edits within budget can spoil all q-grams of an item that a region lacks."""
        lacks = np.flatnonzero(~np.isin(self.hashes[n], grams(region, self.budget.q)))
        return spoiling(lacks, self.budget.q, int(self.k[n])) <= self.k[n]

    def near(self, codes: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The bands that have an alignment within budget, or may have: many items of one length are aligned at once."""
        alike: dict[int, list[tuple[int, int]]] = {}
        for n, band in found:
            alike.setdefault(int(self.length[n]), []).append((n, band))
        out = []
        for m, group in alike.items():
            if len(group) < MANY:
                out += group
                continue
            k, stride = int(self.k[group[0][0]]), int(self.stride[group[0][0]])
            for at in range(0, len(group), 1024):
                part = group[at : at + 1024]
                low = np.array([band * stride for _, band in part], np.int64)
                items = np.stack([self.codes[n] for n, _ in part])
                ok = banded_many(items, codes, low, 2 * stride, k) <= k
                out += [x for x, good in zip(part, ok.tolist(), strict=True) if good]
        return out

    def verify(self, codes: np.ndarray, n: int, band: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best alignment of an item in a band, if it is within budget."""
        item, m, k = self.codes[n], int(self.length[n]), int(self.k[n])
        low = band * int(self.stride[n])
        high = low + 2 * int(self.stride[n]) - 1
        first = max(0, low)
        region = codes[first : max(first, min(len(codes), high + m + 1))]
        spot = region.tobytes().find(item.tobytes())
        if spot >= 0 and spot % 4 == 0:
            return first + spot // 4, first + spot // 4 + m, 0
        if not self.hopeful(n, region):
            return None
        end, edits = banded(item, region, low - first, high - first, k)
        if edits > k:
            return None
        back, _ = banded(item[::-1], region[:end][::-1], end - m - high + first - k, end - m - low + first + k, k, anchored=True)
        return first + end - back, first + end, edits


def codes_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def banded(item: np.ndarray, region: np.ndarray, low: int, high: int, k: int, anchored: bool = False) -> tuple[int, int]:
    """(end, edits) of the best alignment of ``item`` to a stretch of ``region`` on diagonals low - k to high + k.

    The stretch may start anywhere in the band; if ``anchored`` it starts at 0. Costs beyond k + 1 are not told apart.
    """
    low, high = low - k, high + k
    width = high - low + 1
    far = k + 1
    steps = np.arange(width)
    place = low + steps  # region place before row 0
    inside = (place >= 0) & (place <= len(region))
    cost = np.where(inside, np.abs(place) if anchored else 0, far)
    for i in range(len(item)):
        at = place + i  # region index matched on the diagonal
        ok = (at >= 0) & (at < len(region))
        other = np.where(ok, region[np.clip(at, 0, max(0, len(region) - 1))] if len(region) else 0, 0)
        match = np.where(ok, cost + (other != item[i]), far)
        skip = np.append(cost[1:], far) + 1  # an item character without partner
        cost = np.minimum(match, skip)
        cost = np.minimum.accumulate(cost - steps) + steps  # region characters without partner
        end = at + 1
        cost = np.where((end >= 0) & (end <= len(region)), np.minimum(cost, far), far)
        if cost.min() > k:
            return 0, far
    best = int(cost.argmin())
    return low + best + len(item), int(cost[best])


def banded_many(items: np.ndarray, codes: np.ndarray, low: np.ndarray, wide: int, k: int) -> np.ndarray:
    """Edits of the best alignment of each item (a row) to a stretch of ``codes`` on diagonals low - k to low + wide - 1 + k.

    The same recurrence as ``banded``, for items of one length; those that are beyond k leave the matrix.
    """
    steps = np.arange(wide + 2 * k)
    far, out = k + 1, np.full(len(items), k + 1)
    rows, place = np.arange(len(items)), low[:, None] - k + steps
    cost = np.where((place >= 0) & (place <= len(codes)), 0, far)
    for i in range(items.shape[1]):
        at = place + i
        ok = (at >= 0) & (at < len(codes))
        other = codes[np.clip(at, 0, len(codes) - 1)]
        match = np.where(ok, cost + (other != items[rows, i][:, None]), far)
        skip = np.concatenate((cost[:, 1:], np.full((len(rows), 1), far)), axis=1) + 1
        cost = np.minimum.accumulate(np.minimum(match, skip) - steps, axis=1) + steps
        cost = np.where((at + 1 >= 0) & (at < len(codes)), np.minimum(cost, far), far)
        alive = cost.min(axis=1) <= k
        if not alive.all():
            rows, place, cost = rows[alive], place[alive], cost[alive]
            if not len(rows):
                return out
    out[rows] = cost.min(axis=1)
    return out


def blocks(benchmark: DataFrame, item_id: str, text: str, budget: Budget) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).toLocalIterator():
        if block and size + len(r[1]) > budget.block_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: Budget = Budget(), out: str = "hits") -> DataFrame:
    """``docs`` with ``hits`` (or another name, in place of a column called so): the benchmark items found in each whole text,
    as item, start, end (code points) and edits.

    Each block of items is a broadcast of bounded size. Documents pass block after block in one narrow chain, without a
    shuffle; after ``budget.chain`` blocks they are written and those broadcasts dropped, so that memory does not grow with
    the benchmark. Null texts hold nothing; null or blank items match nothing; items of equal text are all named.
    """
    columns = docs.columns
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("__doc"), docs[f"`{text}`"].alias("__text"), F.array().cast(HIT).alias("__found"))
    alive = []
    for n, block in enumerate(blocks(benchmark, item_id, item_text, budget)):
        if n and n % budget.chain == 0:
            df = materialize(df, "searched")
            for shared in alive:
                shared.destroy()
            alive = []
        alive.append(df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, budget)))
        df = _search(df, alive[-1])
    return df.select(*[F.col("__doc")[c].alias(c) for c in columns if c != out], F.col("__found").alias(out))


#: Indexes of the blocks that this worker process has at hand; a task builds none that an earlier one has built.
_INDEXES: dict[str, Index] = {}


def _index(key: str, block: list[tuple[int, str]], budget: Budget) -> Index:
    if key not in _INDEXES:
        while len(_INDEXES) >= budget.chain:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[key] = Index(block, budget)
    return _INDEXES[key]


def _search(df: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*shared.value)
        for b in batches:
            now = [old.as_py() + (index.search(x.as_py()) if x.as_py() else []) for x, old in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(now, _HIT)], b.schema.names)

    return df.mapInArrow(run, df.schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    return contaminated(docs, benchmark, text, out="__hits").where(F.size("__hits") == 0).select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every whole text of ``documents``: doc_id, contaminated, n_items, hits.

    hits is ``item:start:end:edits`` of each item found, by item, comma-joined; of places with equally few edits the first.
    Null and empty texts are clean; a text of any length is searched whole; repeated rows and repeated items stay; an empty
    benchmark leaves every document clean, and an empty table gives no rows. Columns besides doc_id, item_id and text are not
    read.
    """
    df = contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    each = F.transform(F.array_sort("hits"), lambda h: F.concat_ws(":", h["item_id"], h["start"], h["end"], h["edits"]))
    return df.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), F.array_join(each, ",").alias("hits"))

"""Removal of byte strings that repeat anywhere in a corpus, by a sparse suffix structure with bucket-pointer refinement.

Which 200-byte windows occur twice is a question of sorting all windows. Two facts make that small:

* Every window is dealt to its minimiser, the place in it whose q-gram hashes lowest. Equal windows have equal minimisers
  at equal offsets, so windows are only ever compared within the bucket of one q-gram. A run of windows with the same
  minimiser is one *context*: a stretch of text that is handled as a whole.
* A context whose q-gram is alone is unique. Contexts of a bucket that are equal as a whole repeat as a whole. Only
  different contexts of one bucket, at the edges of what was copied, are refined window by window.

Equal texts are one text with a number of copies: a text that is there twice goes as a whole, and lends its contexts once.

Refinement is that of the bucket-pointer algorithm: positions start in buckets of their first bytes, and buckets are split
by sorting on the bucket identifiers of later offsets; identifiers of length h serve to refine to 2h, again and again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm.common import empty_texts, materialize, read_table

#: Bytes of a minimiser's q-gram.
Q = 32
#: Bytes of contexts that one round of refinement takes in; a bucket is never divided by it.
BATCH = 1_000_000
#: Different contexts of one q-gram that are refined in one task. The windows of a larger bucket are divided first.
HOT = 2_000
#: Anchors in one batch of rows.
ROWS = 50_000
#: Bytes of a text that anchors are found in at a time.
CHUNK = 1 << 20


def qgram_hashes(b: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of every q-gram (q a power of two), by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    n = 1
    while n < q:
        h = h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + (h[n:] ^ (h[n:] >> np.uint64(31)))
        n *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash, first and last window start of every context of a text, in order; windows are ``width`` bytes long."""
    parts = []
    starts = len(text) - width + 1
    for at in range(0, max(0, starts), CHUNK):
        n = min(CHUNK, starts - at)
        h = qgram_hashes(np.frombuffer(text, np.uint8, n + width - 1, at))
        span = width - Q + 1
        # The leftmost lowest hash: the upper 40 bits decide, then the place.
        low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        last = np.append(first[1:], n) - 1
        parts.append((place[first] + at, h[place[first]], first + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def refine(buffer: np.ndarray, width: int) -> np.ndarray:
    """Bucket pointer of the ``width``-byte string at every place of ``buffer`` (places too near its end get -1).

    A bucket is named by the place of its first member, so a place that is alone needs no further sorting: each round sorts
    only the places whose bucket has others.
    """
    n = len(buffer)
    if n < width:
        return np.full(n, -1, np.int64)
    word = buffer.astype(np.uint64)  # buckets of the first 8 bytes, exactly
    for s in (1, 2, 4):
        word = (word[:-s] << np.uint64(8 * s)) | word[s:]
    _, first, bucket, count = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
    ids, active = first[bucket], np.flatnonzero(count[bucket] > 1)
    have = 8
    while have < width and len(active):
        step = min(have, width - have)
        active = active[active + step + have <= n]
        pair = (ids[active].astype(np.uint64) << np.uint64(32)) | ids[active + step].astype(np.uint64)
        _, first, bucket, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        ids = ids.copy()
        ids[active] = active[first[bucket]]
        active = active[count[bucket] > 1]
        have += step
    out = np.full(n, -1, np.int64)
    out[: n - width + 1] = ids[: n - width + 1]
    return out


def repeated(contexts: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """For each context the runs (first, last) of window starts whose window occurs at another place in ``contexts``."""
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    ids = refine(buffer, width)
    ends = np.cumsum([len(c) for c in contexts])
    begins = ends - [len(c) for c in contexts]
    valid = np.zeros(len(buffer), bool)
    for a, e in zip(begins.tolist(), ends.tolist(), strict=True):
        valid[a : max(a, e - width + 1)] = True
    spots = np.flatnonzero(valid)
    order = spots[np.argsort(ids[spots], kind="stable")]
    key = ids[order]
    same = np.zeros(len(order), bool)
    same[1:] |= key[1:] == key[:-1]
    same[:-1] |= key[1:] == key[:-1]
    hit = np.zeros(len(buffer) + 1, np.int8)
    hit[order[same]] = 1
    out = []
    for a, e in zip(begins.tolist(), ends.tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:e], [0]))))
        out.append([(int(edge[i]), int(edge[i + 1]) - 1) for i in range(0, len(edge), 2)])
    return out


def text_key(docs: DataFrame, text: str = "text") -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(empty_texts(docs, text), 256), 1, 32))


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, copies, z: each distinct text once, compressed, and how often it is there."""
    source = docs.select(text_key(docs, text).alias("key"), empty_texts(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [c.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], ["key", "z"])

    return source.mapInArrow(run, "key binary, z binary").groupBy("key").agg(F.count("*").alias("copies"), F.first("z").alias("z"))


def _find_anchors(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cols, size = [], [], 0

        def made() -> pa.RecordBatch:
            key = pa.array([k for k, n in keys for _ in range(n)], pa.binary())
            batch = pa.RecordBatch.from_arrays([key, *(pa.array(np.concatenate(x)) for x in zip(*cols, strict=True))], ["key", "h", "ctx", "first", "last"])
            keys.clear()
            cols.clear()
            return batch

        for b in batches:
            for key, z in zip(b.column(0), b.column(1), strict=True):
                t = _unpack(z.as_py())
                place, h, first, last = anchors(t, width)
                if len(place):
                    ctx = np.fromiter((xxhash.xxh3_64_intdigest(t[f : e + width], int(p - f)) for p, f, e in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(place))
                    keys.append((key.as_py(), len(place)))
                    cols.append((h.view(np.int64), ctx.view(np.int64), first, last))
                    size += len(place)
                if size >= ROWS:
                    yield made()
                    size = 0
        if cols:
            yield made()

    return texts.select("key", "z").mapInArrow(run, "key binary, h long, ctx long, first long, last long")


RUNS = "array<struct<first:long,last:long>>"
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _refined(bodies: DataFrame, width: int, by: str = "h") -> DataFrame:
    """h, ctx, runs: the windows that contexts of one bucket (column ``by``) share, by refinement of whole buckets."""
    dealt = bodies.select(F.col(by).alias("bucket"), "h", "ctx", "body").repartition("bucket").sortWithinPartitions("bucket")
    # Buckets of different q-grams have no window in common; a context may be in several of its smaller buckets.
    most = BATCH if by == "h" else 0

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            runs = repeated([x[3] for x in held], width)
            rows = [(x[1], x[2], [{"first": a, "last": e} for a, e in r]) for x, r in zip(held, runs, strict=True) if r]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], _RUNS)], ["h", "ctx", "runs"])

        for b in batches:
            for row in zip(*b.columns, strict=True):
                row = tuple(x.as_py() for x in row)
                if size >= most and held and held[-1][0] != row[0]:
                    yield done()
                    size = 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done()

    return dealt.mapInArrow(sort, f"h long, ctx long, runs {RUNS}")


def halves(body: bytes, low: int, high: int, width: int) -> list[tuple]:
    """A context's windows with ``low`` to ``high`` bytes before their minimiser, as two halves of that range: low, high, narrow
    (hash of what windows of the range have in common), full (hash of all that they cover), first and last window start."""
    place = int((qgram_hashes(np.frombuffer(body, np.uint8, width)) >> np.uint64(24)).argmin())
    middle, out = (low + high) // 2, []
    for a, b in dict.fromkeys(((low, middle), (min(middle + 1, high), high))):
        most, least = min(b, place), max(a, place - (len(body) - width))
        if least <= most:
            narrow = xxhash.xxh3_128_digest(b"%d %d " % (a, b) + body[max(0, place - a) : place + width - b], 1)
            full = xxhash.xxh3_128_digest(b"%d %d " % (least, most) + body[place - most : place + width - least], 2)
            out.append((a, b, narrow, full, place - most, place - least))
    return out


def _divided(bodies: DataFrame, width: int, hot: int) -> DataFrame:
    """h, ctx, runs like ``_refined``, for buckets that no task should hold.

    The windows of a bucket are halved again and again by how many bytes they have before the minimiser. Windows of one half
    that are equal have their common middle part in common: it names a smaller bucket. Contexts that are equal over all of a
    half repeat there as a whole, and one of them stands for all; buckets that have become small are refined. So a context
    costs about two rows for each halving, and only as long as its bucket stays hot.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for b in batches:
            rows = []
            for h, ctx, body, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(h, ctx, body, *half) for half in halves(body, low, high, width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["h", "ctx", "body", "low", "high", "narrow", "full", "first", "last"])

    level = bodies.select("h", "ctx", "body", F.lit(0).alias("low"), F.lit(width - Q).alias("high"))
    parts = None
    while parts is None or not level.isEmpty():
        rows = materialize(level.mapInArrow(split, "h long, ctx long, body binary, low int, high int, narrow binary, full binary, first long, last long"), "halves")
        classes = rows.groupBy("narrow", "full").agg(F.count("*").alias("n"), F.min(F.struct("h", "ctx")).alias("one"))
        sizes = classes.groupBy("narrow").agg(F.count("*").alias("classes"))
        judged = materialize(rows.join(classes, ["narrow", "full"]).join(sizes, "narrow"), "judged")
        left = judged.where((F.col("classes") > 1) & (F.struct("h", "ctx") == F.col("one")))
        found = judged.where("n > 1").select("h", "ctx", F.array(F.struct("first", "last")).alias("runs")).unionByName(_refined(left.where(F.col("classes") <= hot), width, "narrow"))
        parts = found if parts is None else parts.unionByName(found)
        level = left.where(F.col("classes") > hot).select("h", "ctx", "body", "low", "high")
    return parts.groupBy("h", "ctx").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def repeated_runs(texts: DataFrame, width: int = 200, hot: int = HOT) -> DataFrame:
    """key, runs: for each of the distinct ``texts`` (key, z) the window starts (first, last) of windows that stand elsewhere too.

    Anchors are summed up by bucket and by context inside each task before any shuffle, so a passage in a third of all texts
    sends one row from each task; joins back to the anchors are ones that Spark may split. A q-gram with more than ``hot``
    different contexts is not sorted in one task: its windows are divided first.
    """
    found = materialize(_find_anchors(texts, width), "anchors")
    buckets = found.groupBy("h").agg(F.count("*").alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("n > 1").select("h", (F.col("a") != F.col("b")).alias("mixed"))
    # Written first, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
    some = materialize(found.join(materialize(buckets, "buckets"), "h"), "repeats")
    # Every context of a mixed bucket once, with one place where it stands, and whether it stands elsewhere too.
    kinds = materialize(some.where("mixed").groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("at")), "contexts")
    large = materialize(kinds.groupBy("h").count().where(F.col("count") > hot).select("h"), "large")
    wanted = kinds.select("at.key", F.struct("h", "ctx", F.col("at.first").alias("first"), F.col("at.last").alias("last")).alias("c")).groupBy("key").agg(F.collect_list("c").alias("wanted"))
    cut = texts.select("key", "z").join(wanted, "key").select("z", "wanted")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, ctx, body = [], [], []
            for z, wanted in zip(b.column(0), b.column(1), strict=True):
                t = _unpack(z.as_py())
                for c in wanted.as_py():
                    h.append(c["h"])
                    ctx.append(c["ctx"])
                    body.append(t[c["first"] : c["last"] + width])
                if len(h) >= ROWS // 10:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(ctx, pa.int64()), pa.array(body, pa.binary())], ["h", "ctx", "body"])
                    h, ctx, body = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(ctx, pa.int64()), pa.array(body, pa.binary())], ["h", "ctx", "body"])

    bodies = cut.mapInArrow(contexts, "h long, ctx long, body binary")
    if large.isEmpty():
        parts = _refined(bodies, width)
    else:
        bodies = materialize(bodies, "bodies")
        parts = _refined(bodies.join(large, "h", "left_anti"), width).unionByName(_divided(bodies.join(large, "h", "left_semi"), width, hot))
    multiple = kinds.where("n > 1").select("h", "ctx", F.lit(True).alias("again"))
    # What the edges of copies share, at every place where such a context stands.
    shared = materialize(parts.join(multiple, ["h", "ctx"], "full"), "shared")
    mixed = some.where("mixed").join(shared, ["h", "ctx"])
    whole = F.array(F.struct("first", "last"))
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("first")).alias("first"), (r["last"] + F.col("first")).alias("last")))
    runs = mixed.select("key", F.when(F.col("again"), whole).otherwise(moved).alias("runs")).unionByName(some.where("not mixed").select("key", whole.alias("runs")))
    # A text's runs are no more than its anchors: what is gathered is in proportion to one text.
    return runs.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def strip(docs: DataFrame, width: int = 200, text: str = "text", hot: int = HOT) -> DataFrame:
    """For each distinct text: key, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    Texts are dealt by their key, compressed, and written once. A text of several copies that holds a window goes whole.
    """
    texts = materialize(distinct_texts(docs, text), "texts")
    joined = texts.join(repeated_runs(texts, width, hot), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for key, copies, z, runs in zip(*b.columns, strict=True):
                t = _unpack(z.as_py())
                again = copies.as_py() > 1 and len(t) >= width
                gone: list[list[int]] = []
                for a, e in [(0, len(t))] if again else sorted((r["first"], r["last"] + width) for r in runs.as_py() or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(e, gone[-1][1])
                    else:
                        gone.append([a, e])
                edges = [0, *(x for g in gone for x in g), len(t)]
                kept = b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                out.append((key.as_py(), len(t), len(t) - len(kept), len(gone), kept))
                held += len(kept)
                if held >= 8 * BATCH:
                    yield _stripped(out)
                    out, held = [], 0
            yield _stripped(out)

    return joined.select("key", "copies", "z", "runs").mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _stripped(rows: list[tuple]) -> pa.RecordBatch:
    key, n, removed, spans, kept = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
        ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the hash of what remains.

    Equal texts are handled once and joined back to their rows. Null texts are empty; texts of less than 200 bytes lose
    nothing; repeated rows are copies of each other, so texts of 200 bytes or more that are there twice go whole; a very
    long text is handled in one task, a chunk at a time; an empty table gives no rows. No order decides anything, so there
    are no ties, and columns besides doc_id and text are not read.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", text_key(docs).alias("key"))
    return keyed.join(strip(docs).drop("kept"), "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

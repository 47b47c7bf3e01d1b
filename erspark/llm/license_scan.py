"""License scan by diagonal voting.

All rolling word k-grams of all documents are joined by their hashes to their places in license templates. A match votes for
the diagonal (place in the document less place in the template); neighbouring diagonals are merged, which bridges words put
in, left out or changed; and a merged run is verified: the words of the template that it covers, each counted once, must be
enough of it and stand closely together.

The base phrases are templates as well. They are shorter than the k-grams of whole license texts, so words are rolled twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from erspark.llm.common import kept_columns, packed, read_table, unpacked
from erspark.llm.license_texts import LICENSE_TEXTS

#: Words of a k-gram of a base phrase, and of a license text.
PHRASE_K, K = 2, 5
#: Bytes of texts whose words are hashed in one go.
CHUNK = 1 << 20
#: Rows of template places that may be broadcast (about 50 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Template:
    """``base`` phrases count at every place where they stand whole; the others where enough of them is covered."""

    label: str
    text: str
    base: bool = False

    @property
    def k(self) -> int:
        return PHRASE_K if self.base else K


# The base phrases and their labels.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
TEMPLATES = tuple(Template(label, text, True) for label, text in PHRASES) + tuple(Template(label, text) for label, text in LICENSE_TEXTS)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[0x80:] = True
_RANDOM = np.random.default_rng(17)
_BYTE, _PLACE, _ROLL = (_RANDOM.integers(1, 1 << 63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, 1 << 12, max(PHRASE_K, K)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word of a text (bytes), and two independent 64-bit hashes of it (a row each); A-Z as a-z."""
    text = _LOWER[text]
    inside = _WORD[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros((2, 0), np.uint64)
    at = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    letters, spot = text[at], place & (len(_PLACE[0]) - 1)
    return starts, np.stack([_mixed(np.add.reduceat(_BYTE[n][letters] * _PLACE[n][spot], first) + lengths.astype(np.uint64)) for n in (0, 1)])


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """A long text in parts of about ``CHUNK`` bytes, cut between words."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and _WORD[_LOWER[data[end]]]:
            gaps = np.flatnonzero(~_WORD[_LOWER[data[end : end + CHUNK]]])
            end = end + int(gaps[0]) if len(gaps) else end + CHUNK
        yield data[at:end]
        at = end


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Two hashes (rows) of every ``k`` consecutive words, from those of the words."""
    n = max(0, words.shape[1] - k + 1)
    return np.stack([_mixed(sum((words[r][j : j + n] * _ROLL[r][j] for j in range(k)), np.full(n, k, np.uint64))) for r in (0, 1)])


def text_words(text: bytes) -> np.ndarray:
    return np.concatenate([np.zeros((2, 0), np.uint64), *(word_hashes(p)[1] for p in _pieces(text))], axis=1)


def template_places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """k, hash, check, template, label, base, size (words), place: a row for each k-gram of each template."""
    rows = []
    for n, t in enumerate(templates):
        words = text_words(t.text.encode())
        for place, (h, c) in enumerate(rolled(words, t.k).view(np.int64).T.tolist()):
            rows.append((t.k, h, c, n, t.label, t.base, words.shape[1], place))
    df = spark.createDataFrame(rows, "k int, hash long, check long, template int, label string, base boolean, size int, place int")
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def _grams(df: DataFrame) -> DataFrame:
    """A row (own, n_words) for each text, and a row (k, at, hash, check) for each of its k-grams; both with ``row``."""
    own = df.schema["__own"]
    schema = StructType([StructField("row", LongType()), StructField("__own", own.dataType), StructField("n_words", LongType())])
    schema = schema.add("k", IntegerType()).add("at", LongType()).add("hash", LongType()).add("check", LongType())
    names = schema.fieldNames()

    def made(rows: pa.Array, owns: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(texts) == 1:
            words, of = text_words(texts[0]), None
        else:
            starts, words = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
            of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        n = [words.shape[1]] if of is None else np.bincount(of, minlength=len(texts))
        none = lambda m, t: pa.nulls(m, t)
        m = len(texts)
        yield pa.RecordBatch.from_arrays([rows, owns, pa.array(n, pa.int64()), *(none(m, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)
        row = rows.to_numpy()
        begin = np.zeros(1, np.int64) if of is None else np.concatenate(([0], np.cumsum(n)))[:-1]
        for k in (PHRASE_K, K):
            both = rolled(words, k).view(np.int64)
            last = both.shape[1]
            whole = np.ones(last, bool) if of is None else of[:last] == of[k - 1 :]
            for a in range(0, last, 4 * CHUNK):
                at = a + np.flatnonzero(whole[a : a + 4 * CHUNK])
                doc = np.zeros(len(at), np.int64) if of is None else of[at]
                yield pa.RecordBatch.from_arrays([pa.array(row[doc]), none(len(at), owns.type), none(len(at), pa.int64()), pa.array(np.full(len(at), k, np.int32)), pa.array(at - begin[doc]), pa.array(both[0][at]), pa.array(both[1][at])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size, texts = 0, 0, []
            for n, t in enumerate(b.column(2)):
                text = t.as_py().encode("utf-8", "surrogatepass")
                if texts and size + len(text) > CHUNK:
                    yield from made(b.column(0).slice(first, n - first), b.column(1).slice(first, n - first), texts)
                    first, size, texts = n, 0, []
                texts.append(text)
                size += len(text)
            if texts:
                yield from made(b.column(0).slice(first), b.column(1).slice(first), texts)

    return df.select("row", "__own", "__text").mapInArrow(run, schema)


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, cover: float = 0.75, gap: int = 8, spread: float = 1.5) -> DataFrame:
    """``docs`` without its text, with n_words, n_base, first_word, last_word, base_labels, labels, score.

    K-grams stream through the join with the templates' places, which are a broadcast of checked size, and only votes are
    shuffled, by document: a hot phrase is a vote in each document that has it. A vote needs 128 equal bits. Each text also
    sends a row without a vote, which keeps texts without a license. A run counts if it covers ``cover`` of a template's
    words inside ``spread`` times its length. Null texts are empty. The caller's columns of the names above give way.
    """
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keep = kept_columns(docs, text, *made)
    grams = _grams(packed(docs, keep, text).withColumn("row", F.monotonically_increasing_id()))
    votes = grams.join(template_places(docs.sparkSession, templates), ["k", "hash", "check"], "left").where("template is not null or k is null")
    lines = votes.groupBy("row", "template", "label", "base", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.max("k").alias("k"), F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"), F.first("__own", True).alias("__own"), F.max("n_words").alias("n_words")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    lines = lines.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"))
    lines = lines.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(order))
    whole = F.col("base") & (F.size("places") == F.col("size") - F.col("k") + 1)
    runs = lines.groupBy("row", "template", "label", "base", "size", "run").agg(
        F.first("__own", True).alias("__own"),
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"),
        (F.max("high") - F.min("low") + F.max("k")).alias("span"),
        F.max("k").alias("k"),
        F.count_if(whole).alias("whole"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last_word"),
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    runs = runs.withColumn("cover", F.when((F.col("span") <= spread * F.col("size")), words / F.col("size")).otherwise(F.lit(0.0)))
    found = F.col("template").isNotNull() & F.when(F.col("base"), F.col("whole") > 0).otherwise(F.col("cover") >= cover)
    return runs.groupBy("row").agg(
        F.first("__own", True).alias("__own"),
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum("whole"), F.lit(0)).cast("long").alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"),
        F.max("last_word").cast("long").alias("last_word"),
        _labels(F.col("whole") > 0).alias("base_labels"),
        _labels(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("cover")))), F.lit(0.0)).alias("score"),
    ).select(*unpacked(keep), *made)


def _labels(ok: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every whole text of ``documents``.

    Null and empty texts have no words and no labels; a text of any length is read whole, in parts; repeated rows stay; of
    runs with equal cover one decides the score, which is the same; an empty table gives no rows. Columns besides doc_id and
    text are not read.
    """
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

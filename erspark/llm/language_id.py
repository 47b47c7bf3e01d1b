"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to 3, the blended spectrum) present in both, divided by the
geometric mean of the numbers present in each. A Nyström map over landmark texts turns it into features, and a one-versus-
rest kernel ridge regression is solved over them; a batch of texts is scored by two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erspark.llm.common import empty_texts, kept_columns, packed, read_table, unpacked

#: Presence is kept by hash in so many cells for each n; 1-grams and 2-grams of common scripts hardly ever collide.
CELLS = 1 << 15
ORDERS = (1, 2, 3)
SPACE = 0x20


@dataclass(frozen=True)
class Bounds:
    """Documented bounds of the sample that the classifier is fitted on; every text is then scored.

    Of each language ``per_language`` different texts at most, fewer if there are so many languages that ``texts`` would be
    exceeded (one at least: no language is left out); of each language ``chars`` characters at most, and no text of more than
    ``longest``, unless the language has no shorter one.
    """

    per_language: int = 300
    texts: int = 60_000
    chars: int = 2_000_000
    longest: int = 100_000
    landmarks: int = 160
    ridge: float = 1e-2


def _letters() -> np.ndarray:
    """For each code point below 2**16: its code point if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else SPACE for c in range(1 << 16)], np.uint32)


_TABLE: list[np.ndarray] = []


def presence(text: str) -> np.ndarray | None:
    """Indices of the n-gram cells present in a whole text, in lower case with runs of non-letters as one space.

    None if the text has no letter.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    astral = codes[codes >= 1 << 16]
    codes = np.where(codes < 1 << 16, _TABLE[0][np.minimum(codes, (1 << 16) - 1)], codes)
    if len(astral):  # the table ends here: their few distinct values are asked one by one
        codes[np.isin(codes, [c for c in np.unique(astral).tolist() if not chr(c).isalpha()])] = SPACE
    space = codes == SPACE
    if space.all():
        return None
    codes = codes[~(space & np.concatenate(([False], space[:-1])))]
    seen = np.zeros((len(ORDERS), CELLS), bool)
    gram = codes
    for n in ORDERS:
        if n > 1:
            if len(codes) < n:
                break
            gram = gram[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        mixed = gram * np.uint32(0x85EBCA6B)
        seen[n - 1, (mixed ^ (mixed >> np.uint32(15))) & np.uint32(CELLS - 1)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """Landmarks as a presence matrix over the cells that any of them has, and the regression's weights."""

    column: np.ndarray  # cell -> column of ``marks``, or -1
    marks: np.ndarray  # landmarks x columns
    sizes: np.ndarray  # cells present in each landmark
    weights: np.ndarray  # landmarks x languages
    languages: list[str]

    def kernel(self, cells: list[np.ndarray]) -> np.ndarray:
        """Kernel of texts and landmarks, one matrix product."""
        x = np.zeros((len(cells), self.marks.shape[1]), np.float32)
        for row, c in zip(x, cells, strict=True):
            at = self.column[c]
            row[at[at >= 0]] = 1
        sizes = np.array([len(c) for c in cells], np.float32)
        return (x @ self.marks.T) / np.sqrt(sizes[:, None] * self.sizes[None, :])

    def scores(self, cells: list[np.ndarray]) -> np.ndarray:
        return self.kernel(cells) @ self.weights


def fit(texts: list[str], langs: list[str], bounds: Bounds = Bounds()) -> Model | None:
    """Kernel ridge regression on the Nyström features of a sample, one column of targets for each language.

    Landmarks are dealt round-robin over the languages in the sample's order. Without a usable text there is no model.
    """
    pairs = [(c, g) for t, g in zip(texts, langs, strict=True) if (c := presence(t)) is not None]
    if not pairs:
        return None
    names = sorted({g for _, g in pairs})
    by = {g: [c for c, h in pairs if h == g] for g in names}
    marks = [by[g][k] for k in range(max(map(len, by.values()))) for g in names if k < len(by[g])][: max(bounds.landmarks, len(names))]
    cells = np.unique(np.concatenate(marks))
    column = np.full(len(ORDERS) * CELLS, -1, np.int32)
    column[cells] = np.arange(len(cells))
    dense = np.zeros((len(marks), len(cells)), np.float32)
    for row, c in zip(dense, marks, strict=True):
        row[column[c]] = 1
    model = Model(column, dense, np.array([len(c) for c in marks], np.float32), np.zeros((len(marks), len(names)), np.float32), names)
    values, vectors = np.linalg.eigh(model.kernel(marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    nystrom = vectors[:, good] / np.sqrt(values[good])  # kernel @ nystrom are the features
    features = np.concatenate([model.kernel([c for c, _ in pairs[i : i + 256]]) for i in range(0, len(pairs), 256)]).astype(np.float64) @ nystrom
    targets = np.array([[float(g == n) for n in names] for _, g in pairs])
    # Each language weighs the same, however many texts of it there are.
    weight = (1 / targets.sum(axis=0))[targets.argmax(axis=1)] * len(pairs) / len(names)
    left = features.T @ (features * weight[:, None]) + bounds.ridge * len(pairs) / len(marks) * np.eye(features.shape[1])
    beta = np.linalg.solve(left, features.T @ (targets * weight[:, None]))
    model.weights = (nystrom @ beta).astype(np.float32)
    return model


def sample(labelled: DataFrame, bounds: Bounds) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts (columns lang and text): of each language the different texts that hash lowest.

    Texts are picked by hash and length, without being moved; then one copy of each picked text comes to the driver. Copies
    are counted as one before the ranking, so neither a hot text nor repeated rows can enlarge the sample. Only the least
    long text of a language can break the bound on characters, where all its texts do.
    """
    known = labelled.select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n")).groupBy("lang", "h").agg(F.min("n").alias("n"))
    languages = known.agg(F.count_distinct("lang").alias("n")).first()["n"]
    per = max(1, min(bounds.per_language, bounds.texts // max(1, languages)))
    order = Window.partitionBy("lang").orderBy(F.when(F.col("n") <= bounds.longest, 0).otherwise(F.col("n")), "h")
    ranked = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per)
    ranked = ranked.withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    picked = ranked.where((F.col("rank") == 1) | ((F.col("sum") <= bounds.chars) & (F.col("n") <= bounds.longest))).select(F.col("lang").alias("picked_lang"), F.col("h").alias("picked"))
    # texts x 2 values at most: the bound that Bounds states.
    rows = labelled.join(F.broadcast(picked), (F.xxhash64("text") == F.col("picked")) & (F.col("lang") == F.col("picked_lang"))).groupBy("lang", "picked").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["lang"], r["picked"]))
    order = np.random.default_rng(7).permutation(len(rows))
    return [rows[i]["text"] for i in order], [rows[i]["lang"] for i in order]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with lang_pred and score; ``und`` and 0 without a letter or a model.

    The caller's columns named lang_pred or score give way. Of languages with equal scores the first by name is taken.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # landmarks x cells: bounded by Bounds
    keep = kept_columns(docs, text, "lang_pred", "score")
    df = packed(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1)
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            for at in range(0, len(texts) if m else 0, 128):
                cells = [presence(t.as_py()) for t in texts.slice(at, 128)]
                rows = [i for i, c in enumerate(cells) if c is not None]
                if rows:
                    f = m.scores([cells[i] for i in rows])
                    best = f.argmax(axis=1)
                    langs[[at + i for i in rows]] = [m.languages[k] for k in best]
                    scores[[at + i for i in rows]] = np.clip(f[np.arange(len(rows)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["__own", "lang_pred", "score"])

    return df.mapInArrow(run, f"__own {df.schema['__own'].dataType.simpleString()}, lang_pred string, score double").select(*unpacked(keep), "lang_pred", "score")


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose language the model tells; ``und`` goes."""
    own = docs.select(F.struct(*docs.columns).alias("__doc"), empty_texts(docs, text).alias("__body"))
    return predict(own, model, "__body").where("lang_pred <> 'und'").select("__doc.*")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", bounds: Bounds = Bounds()) -> Model | None:
    """The model of a table with columns doc_id, text and lang, from documents that are not held out."""
    ok = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)
    return fit(*sample(docs.where(ok).select("lang", "text"), bounds), bounds)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of ``documents``.

    Null texts and texts without a letter are ``und`` with score 0; a null id is not held out and not learned from; a text of
    any length is read whole; repeated rows stay and are learned from once; of equal scores the first language by name is
    taken; an empty table gives no rows; without a labelled text all are ``und``. Columns besides doc_id, lang and text are
    not read.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs))

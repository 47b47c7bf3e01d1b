"""Host-level quality rules, in DataFrame functions alone.

Each document is measured once. The failures of the soft rules are summed by host, a host's failure rate is shrunk towards
the corpus by a beta prior fitted to all hosts, and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm.common import SPACE_CHARS, kept_columns, materialize, packed, read_table, unpacked


@dataclass(frozen=True)
class HostPolicy:
    """A host is bad if its shrunken rate of failing documents is over ``max_rate``; see ``judge_hosts``."""

    max_rate: float = 0.5
    symbol_share: float = 0.1
    dup_line_share: float = 0.3
    min_word_chars: float = 2.0
    max_word_chars: float = 15.0


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but the six white-space characters."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    Null texts have no words. Rows come back one for one; the caller's columns of these names give way. n_repeat_words counts
    the words in 3-word windows that occur twice or more: windows are compared by 64-bit hash, only a text with an equal pair
    pays for sorting them, and none of them leaves its row.
    """
    keep = kept_columns(docs, text, *MEASURES)
    body = F.col("__text")
    symbols = "#*$%&|<>"
    df = packed(docs, keep, text).select(
        "__own",
        words_of(body).alias("words"),
        F.length(F.translate(body, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, symbols, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0).alias("lines"),
    )
    df = df.withColumns({"n_words": F.size("words").cast("long"), "n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("lines")
    df = df.withColumn("ids", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    window = lambda i: F.xxhash64(F.get("ids", i), F.get("ids", i + 1), F.get("ids", i + 2))
    grams = F.when(F.size("ids") >= 4, F.transform(F.sequence(F.lit(0), F.size("ids") - 3), window)).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("grams", grams).drop("ids")
    # Places of each window, sorted by window: neighbours that are equal are repeats.
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) == F.size("grams"), F.array().cast("array<struct<g:long,i:int>>")).otherwise(F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("grams")
    same = lambda x, j: (x["g"] == F.get("sorted", j - 1)["g"]) | (x["g"] == F.get("sorted", j + 1)["g"])
    df = df.withColumn("at", F.array_sort(F.transform(F.filter("sorted", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))).drop("sorted")
    steps = F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")).drop("at")
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.select(*unpacked(keep), *MEASURES)


def soft_failed(p: HostPolicy) -> Column:
    """Whether a document fails a rule that says something of its host: too many symbols, repeated lines or odd words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / n
    return (F.col("n_words") > 0) & ((F.col("n_symbols") / n > p.symbol_share) | (F.col("n_dup_lines") > p.dup_line_share * F.col("n_lines")) | (length < p.min_word_chars) | (length > p.max_word_chars)) | F.col("base_failed")


def judge_hosts(measured: DataFrame, host: str, p: HostPolicy) -> DataFrame:
    """host, host_docs, host_rate (posterior mean), host_bad: one row for each host, null a host of its own.

    The beta prior is fitted by moments to the rates of all hosts, each weighted by its documents. Where the rates do not
    differ more than chance explains, the prior is as heavy as the whole corpus and every host gets the corpus's rate.
    """
    hosts = measured.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("host_docs"), F.sum(soft_failed(p).cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(F.col("host_docs") * rate * rate).alias("q"), F.count("*").alias("k"))
    m = F.try_divide("f", "n")
    spread = F.try_divide("q", "n") - m * m
    chance = m * (1 - m) * F.try_divide(F.col("k"), F.col("n"))
    between = F.greatest(spread - chance, F.lit(0.0))
    weight = F.when(between > 0, F.greatest(m * (1 - m) / between - 1, F.lit(1.0))).otherwise(F.col("n").cast("double"))
    fitted = prior.select(m.alias("rate"), weight.alias("weight")).first()  # an aggregate without keys: one row
    a, w = (fitted["rate"] or 0.0), (fitted["weight"] or 0.0)
    posterior = (F.col("host_failed") + F.lit(a * w)) / (F.col("host_docs") + F.lit(w))
    return hosts.select("host", "host_docs", posterior.alias("host_rate"), (posterior > p.max_rate).alias("host_bad"))


VERDICTS = ("host_docs", "host_rate", "host_bad", "soft_failed", "kept")


def apply_rules(docs: DataFrame, host: str = "source", text: str = "text", policy: HostPolicy = HostPolicy()) -> DataFrame:
    """Measures, host verdicts and ``kept`` for every row of ``docs`` (without its text).

    The measures are written once, as they are needed for the hosts and again for the documents. A hot host is summed
    inside each task first, and its documents are the side of the join that Spark may split. The caller's columns named like
    a measure or a verdict give way; a host column of such a name is still judged by.
    """
    keep = kept_columns(docs, text, *MEASURES, *VERDICTS)
    own = docs.select(F.struct(F.lit(True).alias("__row"), *[docs[f"`{c}`"] for c in keep]).alias("__doc"), docs[f"`{host}`"].alias("__host"), docs[f"`{text}`"].alias("__body"))
    measured = materialize(measure(own, "__body"), "quality")
    hosts = judge_hosts(measured, "__host", policy)
    judged = measured.join(hosts, measured["__host"].eqNullSafe(hosts["host"]), "left").withColumn("soft_failed", soft_failed(policy))
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed")))
    return judged.select(*[F.col("__doc")[c].alias(c) for c in keep], *MEASURES, *VERDICTS)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over every whole text of ``documents``; the host of a document is its source.

    A document that fails a base rule goes; one that only fails a soft rule goes if its host is bad as well: a rate of
    exactly the limit is not bad. Null and empty texts have no words and fail; a text of any length is measured whole; a null
    source is a host of its own; repeated rows stay and count each; an empty table gives no rows. Columns besides doc_id,
    source and text are not read.
    """
    df = apply_rules(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", F.round("host_rate", 6).alias("host_rate"), "host_bad")

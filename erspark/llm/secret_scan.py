"""Incremental secret scan over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger remembers which (blob, rule, rule version)
have been scanned and what was found by which; a run scans only the pairs that the ledger lacks, and joins findings back to
every path that holds the blob. A text that thousands of paths share is scanned once, and raising one rule's version rescans
blobs for that rule alone: findings of the old version stay in the ledger, but are no longer current.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm.common import empty_texts, joined_spans, kept_columns, read_table


@dataclass(frozen=True)
class Rule:
    """A pattern with a version: ``accept`` decides on each leftmost non-overlapping match, a failing match is dropped."""

    name: str
    version: int
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: Base rules first, in the order that breaks ties between spans that start together.
RULES = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20, True),
    Rule("hex", 1, r"[0-9a-f]+", lambda m: m.end() - m.start() >= 24, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("hook", 1, r"https://hooks\.[a-z0-9.-]+/services/[A-Za-z0-9/]{20,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: What a ledger row holds: the blob, the rule versions that scanned it, and what each of them found.
FINDINGS = "array<struct<kind:string,version:int,start:long,end:long>>"
LEDGER = f"blob_id string, rules array<string>, findings {FINDINGS}"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
#: Blobs whose findings a redacting task remembers, for the copies that follow.
REMEMBERED = 10_000


def find(text: str, rules: tuple[Rule, ...] = RULES, only: set[str] | None = None) -> list[dict]:
    """kind, version, start, end of every accepted match of each rule, in code points, end exclusive."""
    out = []
    for rule in rules:
        if only is None or rule.key in only:
            out += [{"kind": rule.name, "version": rule.version, "start": m.start(), "end": m.end()} for m in re.finditer(rule.pattern, text) if rule.accept(m)]
    return out


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blob_of(df: DataFrame, text: str = "text") -> Column:
    """A text's address; null is the empty text."""
    return F.sha2(empty_texts(df, text), 256)


def unseen(rules: tuple[Rule, ...], seen: Column) -> Column:
    """Keys of the rules that have not scanned a blob."""
    return F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce(seen, F.array().cast("array<string>")))


def made_by(rules: tuple[Rule, ...]) -> Callable[[Column], Column]:
    """Whether a finding is of one of these very rule versions."""
    return lambda f: F.concat_ws("@", f["kind"], f["version"]).isin([r.key for r in rules])


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows: one for each blob with an unseen rule version, with the keys scanned now and their findings.

    ``versions`` has a row for each version of each path. ``ledger`` has the rows of earlier runs. Null
    texts are empty texts, and equal texts are one blob whatever their paths. Texts cross the network once, after each task
    has kept one copy of each blob that it holds; ledger and texts meet on the blob's address.
    """
    blobs = versions.select(blob_of(versions, text).alias("blob_id"), empty_texts(versions, text).alias("text")).groupBy("blob_id").agg(F.first("text").alias("text"))
    ledger = empty_ledger(versions.sparkSession) if ledger is None else ledger
    seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    todo = blobs.join(seen, "blob_id", "left").select("blob_id", "text", unseen(rules, F.col("seen")).alias("rules")).where(F.size("rules") > 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py(), rules, set(keys.as_py())) for t, keys in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, _FOUND)], ["blob_id", "rules", "findings"])

    return todo.mapInArrow(scan, LEDGER)


def current(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id, findings (start, ord, kind, end) of these very rule versions, out of all ledger rows of a blob."""
    merged = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("found"))
    order = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.name, n)])
    placed = F.transform(F.filter("found", made_by(rules)), lambda f: F.struct(f["start"].alias("start"), order[f["kind"]].alias("ord"), f["kind"].alias("kind"), f["end"].alias("end")))
    return merged.select("blob_id", placed.alias("findings"))


def join_back(versions: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Every version row (without columns named blob_id or findings) with its blob's address and findings.

    The versions' side may hold one blob in a third of its rows: it is the side of a plain join that Spark may split.
    """
    own = [versions[f"`{c}`"] for c in kept_columns(versions, "blob_id", "findings", text)]
    return versions.select(*own, blob_of(versions, text).alias("blob_id")).join(found.select("blob_id", "findings"), "blob_id", "left")


def redacted(text: str, findings: list[dict], mark: str = "<secret>") -> str:
    """The text with each run of overlapping or touching findings replaced by ``mark``."""
    out, at = [], 0
    for f in sorted(findings, key=lambda f: (f["start"], -f["end"])):
        if f["start"] > at or not out:
            out += [text[at : f["start"]], mark]
        at = max(at, f["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every secret in its texts replaced; documents without one, null texts too, stay as they are.

    Rows cross the network once, dealt by their blob, and meet there what the ledger has of it; only rules that the ledger
    lacks are scanned, once for each blob that a task holds. Spark splits the rows of a blob that very many documents share.
    """
    columns = docs.columns
    keyed = docs.select("*", blob_of(docs, text).alias("__blob"))
    keys = [r.key for r in rules]
    if ledger is None:
        none = F.array().cast(FINDINGS)
        dealt = keyed.hint("rebalance", F.col("__blob")).withColumns({"__todo": F.array(*[F.lit(k) for k in keys]), "__known": none})
    else:
        old = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("__seen"), F.array_distinct(F.flatten(F.collect_list("findings"))).alias("__found"))
        joined = keyed.join(old.hint("merge"), F.col("__blob") == F.col("blob_id"), "left")
        known = F.filter(F.coalesce("__found", F.array().cast(FINDINGS)), made_by(rules))
        dealt = joined.select(*columns, "__blob", unseen(rules, F.col("__seen")).alias("__todo"), known.alias("__known"))
    at, n = columns.index(text), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[dict]] = {}
        for b in batches:
            out = []
            for t, blob, todo, known in zip(b.column(at), b.column(n), b.column(n + 1), b.column(n + 2), strict=True):
                body, address = t.as_py(), blob.as_py()
                if body is not None and address not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[address] = known.as_py() + find(body, rules, set(todo.as_py()))
                out.append(redacted(body, seen[address], mark) if body is not None and seen[address] else body)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 : n]], columns)

    return dealt.mapInArrow(run, docs.schema)


def count_of(kind: str) -> Column:
    return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: a run over an empty ledger, whose new rows are joined back to all documents.

    Null texts count as empty, a text of any length is scanned whole, and an empty table gives no rows. Equal texts are
    scanned once and repeated rows come back as often as they came. Spans that start together are told apart by the order of
    the rules. Columns besides doc_id and text are not read.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = empty_ledger(spark)
    ledger = ledger.unionByName(scan_blobs(docs, ledger))
    found = join_back(docs, current(ledger))
    base = F.filter("findings", lambda s: s["ord"] < sum(r.base for r in RULES))
    return found.select(
        "doc_id",
        *[count_of(r.name).alias(f"n_{r.name}") for r in RULES if r.base],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("findings")).alias("spans"),
        "blob_id",
    )

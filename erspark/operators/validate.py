"""Checks of submissions and gates before anything ships."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class SubmissionError(ValueError):
    """What is wrong with a submission, at most 50 findings."""


def _ids(df: DataFrame) -> DataFrame:
    return df.where(F.col("ids") != "").select("s1", F.explode(F.split("ids", ",")).alias("pool"))


def submission_errors(matches: DataFrame, candidates: DataFrame, expected: DataFrame, pool: DataFrame, exclusive: bool = True) -> DataFrame:
    """(error, id) findings. Lists have row_no, s1, ids; ``expected`` has row_no and s1, ``pool`` has id."""
    out = None
    for name, lists in (("matches", matches), ("candidates", candidates)):
        each = _ids(lists)
        found = [
            (f"{name}: duplicate entity", lists.groupBy("s1").count().where("count > 1").select("s1")),
            (f"{name}: missing entity", expected.join(lists, "s1", "left_anti").select("s1")),
            (f"{name}: unknown entity", lists.join(expected, "s1", "left_anti").select("s1")),
            (f"{name}: wrong order", lists.alias("l").join(expected.alias("e"), F.col("l.s1") == F.col("e.s1")).where("l.row_no <> e.row_no").select("l.s1")),
            (f"{name}: empty or nan token", each.where("lower(trim(pool)) in ('', 'nan', 'none', 'null')").select("pool")),
            (f"{name}: unknown pool id", each.where("lower(trim(pool)) not in ('', 'nan', 'none', 'null')").join(pool.select(F.col("id").alias("pool")), "pool", "left_anti").select("pool")),
            (f"{name}: repeated pool id", each.groupBy("s1", "pool").count().where("count > 1").select("pool")),
        ]
        for what, bad in found:
            rows = bad.select(F.lit(what).alias("error"), F.col(bad.columns[0]).cast("string").alias("id"))
            out = rows if out is None else out.unionByName(rows)
    m, c = _ids(matches), _ids(candidates)
    out = out.unionByName(m.join(c, ["s1", "pool"], "left_anti").select(F.lit("match is no candidate").alias("error"), F.col("pool").cast("string").alias("id")))
    if exclusive:
        twice = m.groupBy("pool").agg(F.count_distinct("s1").alias("n")).where("n > 1")
        out = out.unionByName(twice.select(F.lit("pool id matched twice").alias("error"), F.col("pool").cast("string").alias("id")))
    return out


def check_submission(*tables: DataFrame, exclusive: bool = True) -> None:
    rows = submission_errors(*tables, exclusive=exclusive).limit(50).collect()
    if rows:
        raise SubmissionError("\n".join(f"{r['error']}: {r['id']}" for r in rows))


def gate(recall: float, crossings: int, macro: float, fingerprints: set[str], least: float = 0.99) -> list[str]:
    """Reasons not to go on; empty if all is well."""
    checks = [(recall >= least, f"recall {recall} under {least}"), (crossings == 0, f"{crossings} pairs cross countries"), (math.isfinite(macro), "F0.5 is not finite"), (len(fingerprints) == 1, f"retrievals differ: {sorted(fingerprints)}")]
    return [why for ok, why in checks if not ok]


def check_features(model: list[str], table: list[str]) -> None:
    """A model is refused if its features are not the table's, in order."""
    if model != table:
        raise ValueError(f"features differ: {sorted(set(model) ^ set(table)) or 'their order'}")


def audit(pairs: DataFrame, texts: DataFrame, entities: int, candidates: int = 10) -> DataFrame:
    """Rows to label by hand: hash-picked entities, their top candidates and every predicted match, with both texts.

    ``pairs`` has s1, pool, p, predicted; ``texts`` has id and text.
    """
    chosen = pairs.select("s1").distinct().orderBy(F.xxhash64("s1"), "s1").limit(entities)
    order = Window.partitionBy("s1").orderBy(F.desc("p"), "pool")
    own = pairs.join(chosen, "s1", "left_semi").withColumn("cand_rank", F.row_number().over(order)).where((F.col("cand_rank") <= candidates) | (F.col("predicted") == 1))
    left = texts.select(F.col("id").alias("s1"), F.col("text").alias("s1_text"))
    right = texts.select(F.col("id").alias("pool"), F.col("text").alias("cand_text"))
    return own.join(left, "s1", "left").join(right, "pool", "left").na.fill("", ["s1_text", "cand_text"])


def audit_score(labelled: DataFrame) -> DataFrame:
    """Precision and recall of predictions against hand labels ``is_match``."""
    t = labelled.where("is_match is not null").agg(F.sum(F.col("predicted") * F.col("is_match")).alias("tp"), F.sum("predicted").alias("n_pred"), F.sum("is_match").alias("n_true"))
    return t.select(F.round(F.try_divide("tp", "n_pred"), 9).alias("precision"), F.round(F.try_divide("tp", "n_true"), 9).alias("recall"))


def official(script: str, paths: list[str], timeout: int = 3600) -> tuple[bool, str] | None:
    """Whether an external validator accepts the files, and what it said; None if there is none on the driver."""
    if not Path(script).is_file():
        return None
    done = subprocess.run([sys.executable, script, *paths], capture_output=True, text=True, timeout=timeout)
    return done.returncode == 0, done.stdout + done.stderr

"""Named contexts of a run: which queries meet which pool, how deep, and what it is called on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erspark.functions.hashing import fingerprint, uniform

# The contexts and their depth.
DEPTHS = {"diag": "diag", "train": "prod", "test": "prod"}


@dataclass(frozen=True)
class Context:
    """``reverse`` holds every query record of the split, whichever of them are asked."""

    name: str
    depth: str
    queries: DataFrame
    pool: DataFrame
    reverse: DataFrame
    fingerprint: str

    @property
    def folder(self) -> str:
        return f"retrieval/{self.name}_{self.fingerprint}"


def build(name: str, s1: DataFrame, pool: DataFrame, config: dict, key: str = "id", diag_share: float = 0.02, salt: int = 2) -> Context:
    """``diag`` asks a share of the queries, picked by hash, at diagnostic depth; the others ask all, at production depth."""
    if name not in DEPTHS:
        raise ValueError(f"no context {name}")
    asked = s1.where(uniform(F.col(key), salt) < diag_share) if name == "diag" else s1
    return Context(name, DEPTHS[name], asked, pool, s1, fingerprint(config | {"context": name}))


def depth(k: int | Column, kind: str, diag: int = 500):
    """Candidates to ask for: the production number, or the diagnostic one if that is larger."""
    if isinstance(k, Column):
        return F.greatest(k, F.lit(diag)) if kind == "diag" else k
    return max(k, diag) if kind == "diag" else k

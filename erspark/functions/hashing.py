"""Ids, fingerprints and deterministic uniform hashes."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_SPAN = 10_000_000_000


def encode_id(entity_id: Column) -> Column:
    """``S<source>-<number>`` as one long; other forms raise."""
    ok = F.assert_true(entity_id.rlike("^S[123]-[0-9]{1,10}$"), F.concat(F.lit("bad entity id: "), entity_id))
    value = F.regexp_extract(entity_id, "^S([0-9])", 1).cast("long") * SOURCE_SPAN + F.regexp_extract(entity_id, "-([0-9]+)$", 1).cast("long")
    return F.when(ok.isNull(), value)


def decode_id(value: Column) -> Column:
    return F.concat(F.lit("S"), F.floor(value / SOURCE_SPAN).cast("string"), F.lit("-"), (value % SOURCE_SPAN).cast("string"))


def uniform(ids: Column, salt: int, seed: int = 42) -> Column:
    """A uniform double in [0, 1) for each id: samples at a smaller share lie inside those at a larger one.

    The splitmix64 finaliser on 64-bit words; Catalyst's long arithmetic checks for overflow, so an Arrow function does it.
    """
    key = (seed * 0x100000001B3 + salt * 0x9E3779B1 + 12345) % 2**64

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            z = (x.to_numpy("int64").view(np.uint64) ^ np.uint64(key)) + np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            z ^= z >> np.uint64(31)
        return pd.Series((z >> np.uint64(11)).astype(np.float64) / 2.0**53)

    return run(ids)


def fingerprint(config: dict) -> str:
    """Ten hex digits that stand for a configuration."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:10]


def file_sha256(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")

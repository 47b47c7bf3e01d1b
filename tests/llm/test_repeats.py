"""Repeated byte strings in hot buckets and hot texts, against all windows."""

import hashlib
import random
from collections import Counter

import pytest

from erspark.llm import substring_dedup

WIDTH = 200


def brute(texts):
    seen = Counter(t[i : i + WIDTH] for t in texts for i in range(len(t) - WIDTH + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - WIDTH + 1):
            if seen[t[i : i + WIDTH]] > 1:
                gone[i : i + WIDTH] = b"\1" * WIDTH
        out.append(hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 3, 2000])
def test_one_q_gram_in_many_contexts(spark, hot):
    rng = random.Random(hot)
    stem = "".join(rng.choices("abcdefgh", k=150))  # too short to repeat by itself
    around = ["".join(rng.choices("abcdefgh", k=120)) for _ in range(8)]
    texts = [rng.choice(around)[rng.randint(0, 90) :] + stem + rng.choice(around)[: rng.randint(0, 120)] for _ in range(60)]
    texts += ["".join(rng.choices("ab", k=90)) + stem + "".join(rng.choices("ab", k=90)) for _ in range(30)] + [stem * 3, "a" * 700, "ab" * 300, "", "short", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"].hex(): r["kept_sha256"] for r in substring_dedup.strip(df, WIDTH, hot=hot).collect()}
    raw = [t.encode() for t in texts]
    want = {hashlib.sha256(t).hexdigest()[:32]: k for t, k in zip(raw, brute(raw), strict=True)}
    assert got == want


def test_a_text_of_very_many_copies(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(300)]
    hot = " ".join(rng.choices(words, k=80))
    other = " ".join(rng.choices(words, k=80))
    rows = [(i, hot) for i in range(10_000)] + [(10_001, other + " " + hot[:300]), (10_002, other[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["key"].hex(): r for r in substring_dedup.strip(df).collect()}
    a, b = (got[hashlib.sha256(t.encode()).hexdigest()[:32]] for t in (hot, rows[-2][1]))
    assert (a["n_removed"], a["n_spans"], a["kept"]) == (len(hot), 1, b"") and (b["n_removed"], b["kept"].decode()) == (300, other + " ") and len(got) == 3

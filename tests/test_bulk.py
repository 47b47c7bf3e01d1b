"""Similarities of many pairs at once, against those of one pair, and pairs of blocks against a plain join."""

import os
import random

import numpy as np
import pytest

from erspark.functions import bulk, similarity
from erspark.operators import pairs


def texts(rng, letters, longest, n=60):
    words = ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(15)]
    plain = ["".join(rng.choices(letters + " ", k=rng.randint(0, longest))) for _ in range(n)]
    return sorted({"", "a", *plain, *(" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(n)), "x" * 64, "x" * 65, "ab" * 32, "ab" * 40, " ".join("abcdefghijk")})


def slow_partial(a, b):
    a, b = sorted((a, b), key=len)
    n = len(a)
    windows = [b[i : i + n] for i in range(len(b) - n + 1)] + [b[:i] for i in range(1, n)] + [b[-i:] for i in range(1, n)]
    return max(similarity.ratio_of(a, w) for w in windows) if a else 0.0 if b else 100.0


@pytest.mark.parametrize("letters,longest", [("ab", 12), ("abcdefgh", 30), ("aé漢😀b", 20), ("abc", 90)])
def test_many_pairs_at_once(letters, longest):
    t = texts(random.Random(longest), letters, longest)
    x, y = (k.ravel() for k in np.meshgrid(np.arange(len(t)), np.arange(len(t))))
    sets = [set(s.split("\n")) - {""} for s in t]
    one = {
        bulk.ratio: similarity.ratio_of,
        bulk.partial_ratio: slow_partial,
        bulk.jaro_winkler: similarity.jaro_winkler_of,
        bulk.token_set_ratio: similarity.token_set_of,
    }
    for many, single in one.items():
        want = [single(t[i], t[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        assert many(t, x, y).tolist() == want, single
    lines = [s.replace(" ", "\n").strip("\n") for s in t]
    sets = [set(s.split("\n")) if s else set() for s in lines]
    want = [len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert bulk.jaccard(lines, x, y).tolist() == want


def test_small_tables_give_the_same(monkeypatch):
    t = texts(random.Random(5), "abcd", 20)
    x, y = (k.ravel() for k in np.meshgrid(np.arange(len(t)), np.arange(len(t))))
    want = bulk.partial_ratio(t, x, y)
    monkeypatch.setattr(bulk, "CELLS", 50)
    monkeypatch.setattr(bulk, "LANES", 700)
    assert (bulk.partial_ratio(t, x, y) == want).all()


def test_long_texts_take_few_runs():
    a, b = "ab" * 1500, "ba" * 1500
    assert similarity.partial_of(a, b) == pytest.approx(200 * 2999 / 5999)


def test_rounds_half_up():
    assert bulk.rounded(np.array([0.0000005, 66.6666665, 1 / 3, 100.0]), 6).tolist() == [1e-06, 66.666667, 0.333333, 100.0]


def test_blocks_make_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    monkeypatch.setattr(pairs, "ROWS", 7)
    monkeypatch.setattr(pairs, "AT_ONCE", 5)
    rng = random.Random(2)
    rows = [("k" if n % 3 else rng.choice(["p", "q|", None]), n % 2 == 0, n if n < 70 else None, rng.choice(["a", "b b", "abc", ""])) for n in range(72)]
    rows += rows[:5]  # repeated ids
    df = spark.createDataFrame(rows, "key string, left boolean, id long, text string").repartition(3)
    got = sorted(map(repr, ((r["s1"], r["pool"], r["value"]) for r in pairs.scored(df, ["key"], bulk.ratio, 6).collect())))
    want = sorted(repr((a[2], b[2], round(similarity.ratio_of(a[3], b[3]), 6))) for a in rows for b in rows if a[1] and not b[1] and a[0] == b[0] is not None)
    assert got == want


SF = "/root/testdata/sf0.001"
PLAIN = lambda t: "".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).strip()


def soundex(name):
    out = ""
    for word in (["".join(c for c in w if "a" <= c <= "z") for w in name.split()] + ["", ""])[:2]:
        code = {c: str(k) for k, cs in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}
        digits, last = "", code.get(word[:1])
        for c in word[1:]:
            if code.get(c) and code.get(c) != last:
                digits += code[c]
            last = last if c in "hw" else code.get(c)
        out += (word[:1].upper() + (digits + "000")[:3]) if word else ""
    return out


BLOCKED = {
    "ml_pair_scorer": lambda r: similarity.ratio_of(r["a"], r["b"]) / 100,
    "sim_acronym": lambda r: float(any(len(x.split()) > 1 and "".join(w[0] for w in x.split()) == y.replace(" ", "") for x, y in ((r["a"], r["b"]), (r["b"], r["a"])))),
    "sim_city_ratio": lambda r: similarity.ratio_of(r["aa"].split(" ")[0], r["ba"].split(" ")[0]),
    "sim_exact_sorted": lambda r: float(r["a"] != "" and sorted(r["a"].split()) == sorted(r["b"].split())),
    "sim_jaccard": lambda r: len({*r["a"].split()} & {*r["b"].split()}) / max(1, len({*r["a"].split(), *r["b"].split()})),
    "sim_jaro_winkler": lambda r: similarity.jaro_winkler_of(r["a"], r["b"]),
    "sim_token_set": lambda r: similarity.token_set_of(PLAIN(r["a"]), PLAIN(r["b"])),
    "sim_token_sort": lambda r: similarity.ratio_of(" ".join(sorted(PLAIN(r["a"]).split())), " ".join(sorted(PLAIN(r["b"]).split()))),
    "sim_phonetic": lambda r: float(soundex(r["a"]) == soundex(r["b"]) != ""),
    "sim_partial": lambda r: slow_partial(PLAIN(r["a"]), PLAIN(r["b"])),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", BLOCKED)
def test_similarities_come_from_blocks(spark, name):
    from erspark.plans.queries import twins
    from erspark.plans.registry import QUERIES

    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "MapInArrow" in plan  # no row for a pair before its value is there
    want = {(r["s1"], r["pool"]): BLOCKED[name](r) for r in twins(spark, SF).collect()}
    got = {(r["s1"], r["pool"]): r[2] for r in df.collect()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - v) < 2e-6 for k, v in want.items())

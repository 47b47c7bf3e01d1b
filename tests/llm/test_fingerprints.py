"""Fingerprints: deeper lookups lose no link, ties of bits, clashing columns, long texts."""

import random

import pytest

from erspark.llm import simhash_dedup as sim


def near_pairs(fps, tau=4):
    return {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= tau}


def roots(links, fps):
    root = {f: f for f in fps}
    for _ in range(len(fps)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("depth", [1, 2, 3])
@pytest.mark.parametrize("block", [4096, 8])
def test_links_are_whole_at_every_depth(spark, depth, block):
    rng = random.Random(10 * depth + block)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(25)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in sim.links_of(df, depth=depth, block=block).collect()}
    assert got <= near_pairs(fps) and roots(got, fps) == roots(near_pairs(fps), fps)


def test_every_close_difference_is_probed_from_some_chain():
    rng = random.Random(1)
    masks = sim.masks_of(5)
    for depth in (1, 2, 3):
        flips = [set(sim._flips(masks, i, depth, 4)) for i in range(5)]
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            assert any(diff & sum(masks[(i + n) % 5] for n in range(depth)) in flips[i] for i in range(5))


def test_depth_grows_with_the_fingerprints():
    depths = [sim.depth_for(n, 4, 5) for n in (10, 10**6, 10**8, 10**11)]
    assert depths[0] == 1 and depths == sorted(depths) and depths[-1] == 3


def test_ties_long_texts_and_clashing_columns(spark):
    long_text = "alpha beta gamma delta epsilon " * 20_000
    rows = [(i, t, 1, "c", i) for i, t in enumerate([long_text, long_text + "alpha", None, "", " \n", "one", "ONE"])] + [(6, "ONE", 1, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string, node long")
    got = sorted((r["doc_id"], r["component_id"], r["node"]) for r in sim.components(df).collect())
    by = {d: c for d, c, _ in got}
    assert len(got) == 8 and (6, by[6], 9) in got and by[2] == by[3] == by[4] == 2 and by[5] == by[6] == 5 and by[0] == by[1]
    # Two hashes: a bit that one of them has is in half of them, which is not over half.
    assert sim.fingerprint("a b c d e") == sim.shingle_hashes("a b c d e", 4)[0] & sim.shingle_hashes("a b c d e", 4)[1]

"""Decontamination against all alignments, and with items that share most of their text."""

import random
import time

import pytest

from erspark.llm import decontaminate
from erspark.llm.decontaminate import Budget, Index, codes_text, normal


def least_edits(item, text):
    """The fewest edits between an item and any stretch of a text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def spoil(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(max(1, len(out)))
        if not out:
            break
        rng.choice([lambda: out.__setitem__(at, rng.choice("abc ")), lambda: out.pop(at), lambda: out.insert(at, rng.choice("abc "))])()
    return "".join(out)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("frequent", [0, 2, 32])
def test_nothing_within_budget_is_missed(seed, frequent, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(decontaminate, "MANY", rng.choice([1, 8]))
    budget = Budget(frequent=frequent, slice=rng.choice([7, 1000]))
    stem = "".join(rng.choices("abcde ", k=40))
    items = [(i, stem + "".join(rng.choices("abcde ", k=rng.randint(5, 60)))) for i in range(12)]
    items += [(20 + i, "".join(rng.choices("abcdefgh ", k=rng.randint(9, 120)))) for i in range(12)] + [(50, items[0][1]), (51, "abc"), (52, None or "")]
    index = Index(items, budget)
    for _ in range(4):
        parts = [spoil(rng, rng.choice(items)[1] or "abc", rng.randint(0, 9)) if rng.random() < 0.6 else "".join(rng.choices("abcde ", k=50)) for _ in range(5)]
        text = " ".join(parts) + stem
        plain = codes_text(normal(text)[0])
        got = {h["item_id"]: h["edits"] for h in index.search(text)}
        for i, t in items:
            item = codes_text(normal(t)[0])
            if len(item) >= budget.q:
                fewest = least_edits(item, plain)
                assert got.get(i, 10**6) == fewest if fewest <= budget.edits(len(item)) else i not in got, (i, item, plain)
            else:
                assert (i in got) == (bool(item) and f" {item} " in f" {plain} ")


def test_a_stem_of_very_many_items_is_cheap():
    rng = random.Random(3)
    stem = "Which of the following statements is correct about "
    items = [(i, stem + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=90))) for i in range(20_000)]
    index = Index(items, Budget())
    text = " ".join([stem] * 8 + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1600))]) + items[77][1]
    began = time.process_time()
    assert [h["item_id"] for h in index.search(text)] == [77]
    assert time.process_time() - began < 3
    assert len(index.item) < 20_000 * 110


def test_blocks_are_written_between_and_ties_named(spark):
    items = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "alpha beta gamma delta epsilon zeta", "tiny"]
    bench = spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {items[0]} b {items[1]} c {items[0]}", "h", 5), (2, "nothing, tiny", "h", 6), (3, None, "h", 7)], "doc_id long, text string, hits string, __text int")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench, budget=Budget(block_chars=10, chain=2)).collect()}
    assert {i: sorted((h["item_id"], h["start"]) for h in r["hits"]) for i, r in got.items()} == {1: [(0, 2), (1, 40), (2, 2)], 2: [(3, 9)], 3: []}
    assert {i: r["__text"] for i, r in got.items()} == {1: 5, 2: 6, 3: 7}
    assert [r.asDict() for r in decontaminate.clean(docs, bench).collect()] == [{"doc_id": 3, "text": None, "hits": "h", "__text": 7}]

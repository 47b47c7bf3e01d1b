"""Weak supervision: estimated reliabilities, a classifier that decides, spans in texts of very many matches."""

import random
import re
from collections import Counter

from erspark.llm import pii


def test_em_finds_the_labelers_that_can_be_trusted():
    rng = random.Random(8)
    hit, false = (0.9, 0.85, 0.75), (0.1, 0.2, 0.25)
    truth, counts = {}, Counter()
    for _ in range(20_000):
        yes = rng.random() < 0.4
        votes = tuple(int(rng.random() < (h if yes else f)) for h, f in zip(hit, false, strict=True))
        counts[votes] += 1
        truth.setdefault(votes, []).append(yes)
    got = pii.fit_votes(list(counts.items()))
    for votes, yes in truth.items():
        assert abs(got[votes] - sum(yes) / len(yes)) < 0.15, votes
    assert got[(1, 0, 0)] > got[(0, 0, 1)] and pii.fit_votes([])[(1, 1, 1)] > 0.5


def test_classifier_learns_from_soft_labels():
    patterns = [("tel", (1, 1, 1, 0, 1), 300), ("tel", (1, 1, 0, 0, 1), 100), ("tel", (0, 0, 0, 1, 0), 400), ("tel", (0, 1, 0, 1, 0), 100)]
    model = pii.train(patterns)
    assert model["tel:11101"] > 0.9 and model["tel:00010"] < 0.1
    assert len(model) == 32 * len(pii.KINDS) and all(0 <= p <= 1 for p in model.values())


def test_classifier_decides_on_added_kinds(spark):
    rng = random.Random(2)
    tel = lambda first: f"{first}{rng.randint(10, 99)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"please call phone {tel(rng.randint(2, 9))} today") for i in range(200)]
    rows += [(1000 + i, f"item {tel(0).replace('-', ' ', 1)} in stock") for i in range(200)]
    rows += [(5000, "Dear Mr. John Smith, the bank account is iban DE89 3704 0044 0532 0130 00."), (5001, "ssn 123-45-6789")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("tel" in got[i] for i in range(200)) > 190 and sum("tel" in got[1000 + i] for i in range(200)) < 10
    assert {"name", "iban"} <= set(got[5000]) and got[5001] == ["ssn"]


def test_places_in_a_text_of_very_many_matches(spark):
    rng = random.Random(4)
    text = "".join(f"{'é' * rng.randint(0, 3)} u{i}@a{i}.com, 10.0.0.{i % 300} " for i in range(5000))
    names = ["spans", "__text", "__own"]
    rows = [(1, text, 1, 2, 3), (2, None, 1, 2, 3), (3, "x", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = {r["doc_id"]: r for r in pii.candidates(df).collect()}
    assert [len(got[i]["spans"]) for i in (2, 3)] == [0, 0] and got[1]["__text"] == 2 and got[1]["__own"] == 3
    mails = [(s["start"], s["end"]) for s in got[1]["spans"] if s["kind"] == "email"]
    assert mails == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = [(s["start"], s["end"]) for s in got[1]["spans"] if s["kind"] == "ip"]
    assert ips == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text) if int(m[0].split(".")[3]) <= 255]

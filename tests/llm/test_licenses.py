"""Labels that diagonal voting adds, and what must not have any."""

import re

from erspark.llm import license_scan
from erspark.llm.license_texts import LICENSE_TEXTS

FILLER = "some words that stand before and after what is looked for in this text "


def labels(spark, texts, **how):
    rows = [(i, t, "w", i) for i, t in enumerate(texts)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, row string, n_words int"), **how).collect()
    assert len(got) == len(rows) and all(r["row"] == "w" for r in got)
    return [r for r in sorted(got, key=lambda r: r["doc_id"])]


def test_every_template_is_found_and_spoilt_copies_too(spark):
    texts, want = [], []
    for label, text in LICENSE_TEXTS:
        words = text.split()
        texts += [FILLER + text.upper() + " " + FILLER, " ".join([*words[: len(words) // 2], "Copyright (c) the owners", *words[len(words) // 2 :]])]
        want += [label, label]
    got = labels(spark, texts)
    assert all(w in r["labels"].split(",") for w, r in zip(want, got, strict=True)), [(w, r["labels"]) for w, r in zip(want, got, strict=True)]
    assert all(r["score"] >= 0.75 for r in got) and all(r["score"] == 1 for r in got[::2])


def test_prose_and_scattered_words_have_no_label(spark):
    text = dict(LICENSE_TEXTS)["unlicense"]
    scattered = " ".join(w + " " + FILLER for w in text.split())
    half = " ".join(text.split()[: len(text.split()) // 2])
    got = labels(spark, ["this is " * 8, FILLER * 50, scattered, half, "", None, "this is free and unencumbered " * 40])
    assert [r["labels"] for r in got] == [""] * 7 and [r["score"] for r in got] == [0] * 7


def test_words_at_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "CHUNK", 64)
    phrase = "GNU General Public License"
    text = "é" * 100 + " " + (FILLER + phrase + "; ") * 40 + "MIT-license " + "x" * 500 + " cc by"
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    r = labels(spark, [text])[0]
    assert r["n_words"] == len(words) and r["n_base"] == 42 and r["base_labels"] == "cc-by,gpl,mit" and r["last_word"] == len(words) - 2
    assert license_scan.text_words(text.encode()).shape == (2, len(words))


def test_equal_words_have_equal_hashes():
    a = license_scan.text_words("The quick QUICK quick, the".encode())
    assert (a[:, 1] == a[:, 2]).all() and (a[:, 2] == a[:, 3]).all() and (a[:, 0] == a[:, 4]).all() and (a[0] != a[1]).all()

"""Letters and symbols beyond the first 2**16 code points."""

import numpy as np

from erspark.llm import language_id


def test_astral_symbols_are_no_letters():
    assert language_id.presence("12345 \U0001f600") is None and language_id.presence("\U0001f600\U0001f4a9!") is None
    assert np.array_equal(language_id.presence("one\U0001f600two"), language_id.presence("one two"))
    assert language_id.presence("\U00010330\U00010331") is not None  # Gothic letters


def test_und_for_digits_and_emoji(spark):
    model = language_id.fit(["kalo miru tane", "brunst schlag wendt"] * 5, ["xx", "yy"] * 5)
    docs = spark.createDataFrame([(1, "12345 \U0001f600"), (2, "kalo \U0001f600 miru")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert got == {1: "und", 2: "xx"}
    assert [r["doc_id"] for r in language_id.accepted(docs, model).collect()] == [2]

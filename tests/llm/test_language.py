"""The language model: held-out accuracy, a bounded sample, no language left out."""

import random
import zlib

from erspark.llm import language_id

WORDS = {"xx": ["kalo", "miru", "tane", "soki", "lamo"], "yy": ["brunst", "schlag", "wendt", "gruft", "zwang"], "zz": ["queue", "ailleu", "soit", "donque", "voila"]}


def text(rng, lang, n=25):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "a", "en"]) for _ in range(n))


def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := rng.choice(list(WORDS))), lang) for i in range(400)]
    rows += [(1000 + i, text(rng, "xx"), None) for i in range(20)] + [(None, "kalo", "yy")] * 30
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.op2_language_id(spark, str(tmp_path)).collect() if r["doc_id"] is not None}
    held = [(i, lang) for i, _, lang in rows if i is not None and lang and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 60 and all(got[i]["held_out"] and got[i]["lang_pred"] == lang for i, lang in held)
    assert all(got[1000 + i]["lang_pred"] == "xx" and 0 < got[1000 + i]["score"] <= 1 for i in range(20))


def test_sample_is_bounded(spark):
    rng = random.Random(2)
    rows = [("xx", "kalo miru tane")] * 500 + [("xx", text(rng, "xx")) for _ in range(50)] + [("yy", "brunst " * 4000), ("yy", "wendt " * 5000)] + [(f"l{i}", f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    texts, langs = language_id.sample(df, language_id.Bounds(per_language=20, texts=1000, chars=3000, longest=2000))
    assert len(set(zip(texts, langs, strict=True))) == len(texts) and set(langs) == {"xx", "yy"} | {f"l{i}" for i in range(300)}
    assert langs.count("xx") <= 3 and langs.count("yy") == 1 and sum(len(t) for t, g in zip(texts, langs, strict=True) if g == "xx") <= 3000
    assert texts[langs.index("yy")] == "brunst " * 4000  # no shorter one is there


def test_ties_long_texts_and_clashing_columns(spark):
    model = language_id.fit(["kalo miru tane", "kalo miru tane"], ["bb", "aa"])
    docs = spark.createDataFrame([(1, "kalo miru", 7, "c"), (2, "kalo " * 200_000, 8, "d"), (3, "", 9, "e")], "doc_id long, text string, score int, __text string")
    got = {r["doc_id"]: r.asDict() for r in language_id.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["aa", "aa", "und"] and got[2]["__text"] == "d" and got[3]["score"] == 0.0

"""Host verdicts that decide, against the same rule in plain Python."""

import random

from erspark.llm import quality_rules

GOOD = [f"word{i}x" for i in range(60)]


def corpus():
    rng = random.Random(6)
    rows = []
    for host, n, junk in (("fine", 400, 0.05), ("junk", 300, 0.8), ("small", 2, 1.0), (None, 40, 0.1), ("half", 100, 0.45)):
        for i in range(n):
            words = rng.sample(GOOD, 55)
            if i < junk * n:
                words = [w + "#$" * 6 if k % 2 else w for k, w in enumerate(words)]
            rows.append((len(rows), host, " ".join(words)))
    return rows


def verdicts(rows):
    """Documents that stay, by the same prior."""
    soft = {i: sum(c in "#*$%&|<>" for c in t) / len(t.split()) > 0.1 for i, _, t in rows}
    hosts = {}
    for i, h, _ in rows:
        hosts.setdefault(h, []).append(soft[i])
    n = len(rows)
    m = sum(map(sum, hosts.values())) / n
    q = sum(len(x) * (sum(x) / len(x)) ** 2 for x in hosts.values()) / n
    between = max(q - m * m - m * (1 - m) * len(hosts) / n, 0)
    weight = max(m * (1 - m) / between - 1, 1)
    rate = {h: (sum(x) + m * weight) / (len(x) + weight) for h, x in hosts.items()}
    return {i for i, h, _ in rows if not (soft[i] and rate[h] > 0.5)}, rate


def test_host_verdict_decides(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality_rules.op5_quality_rules(spark, str(tmp_path)).collect()
    stay, rate = verdicts(rows)
    assert not any(r["base_failed"] for r in got) and {r["doc_id"] for r in got if r["kept"]} == stay
    gone = {rows[i][1] for i in range(len(rows)) if i not in stay}
    assert "junk" in gone and not gone & {"fine", "half", None}
    by = {rows[r["doc_id"]][1]: r["host_rate"] for r in got}
    assert all(abs(by[h] - x) < 1e-5 for h, x in rate.items())


def test_small_hosts_are_shrunk(spark):
    rows = [(h, n, f, f > 0) for h, n, f in (("a", 1000, 100), ("b", 1000, 120), ("c", 2, 2))]
    df = spark.createDataFrame([(h, 60, 240, 60 if i < f else 0, 1, 0, 0, False) for h, n, f, _ in rows for i in range(n)], "h string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    got = {r["host"]: r for r in quality_rules.judge_hosts(df, "h", quality_rules.HostPolicy()).collect()}
    assert not got["c"]["host_bad"] and 0.1 < got["c"]["host_rate"] < 1 and got["a"]["host_rate"] < got["b"]["host_rate"]


def test_clashing_columns_long_texts_and_ties(spark):
    names = ["words", "ids", "grams", "sorted", "at", "lines", "host", "kept", "n_words", "__own"]
    long_text = "one two three four five " * 20_000
    rows = [(i, "h", t, *(["mine"] * len(names))) for i, t in enumerate([long_text, None, "", " ".join(GOOD), " ".join(GOOD)])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r["doc_id"]: r.asDict() for r in quality_rules.apply_rules(df).collect()}
    assert len(got) == 5 and all(r[n] == "mine" for r in got.values() for n in names if n not in ("kept", "n_words"))
    assert got[0]["n_words"] == 100_000 and got[0]["n_repeat_words"] == 100_000 and got[0]["base_failed"] and got[1]["n_words"] == 0
    assert got[3]["kept"] == got[4]["kept"] and got[3]["kept"] is True
    assert {r["host_docs"] for r in quality_rules.apply_rules(df, host="host").collect()} == {5}

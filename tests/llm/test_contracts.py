"""Every query against a brute-force version, over a corpus of awkward documents."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash

from erspark.llm.registry import QUERIES

SPACE_WORDS = re.compile("[^\x20\x09-\x0d]+")


def rows_of(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def expected(rows, got, make, columns):
    """Row for row, repeated rows too."""
    want = Counter((i, *make(t)) for i, t, *_ in rows)
    have = Counter((r["doc_id"], *(r[c] for c in columns)) for r in got)
    assert have == want


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, nothing, name):
    assert rows_of(spark, name, nothing) == []


def test_secrets(spark, corpus):
    folder, rows = corpus
    kinds = [("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]

    def brute(t):
        spans = [(m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m)]
        c = Counter(s[2] for s in spans)
        return c["assign"], c["access"], c["hex"], sha(joined(spans))

    got = rows_of(spark, "op1_secret_scan", folder)
    expected(rows, got, brute, ["n_assign", "n_access", "n_hex", "base_sha256"])
    assert sum(r["n_assign"] for r in got) >= 3 and sum(r["n_access"] for r in got) == 1


def test_quality(spark, corpus):
    folder, rows = corpus

    def brute(t):
        t = t or ""
        w = SPACE_WORDS.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if SPACE_WORDS.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), failed

    got = rows_of(spark, "op5_quality_rules", folder)
    expected(rows, got, brute, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert all(not r["kept"] for r in got if r["base_failed"]) and any(r["kept"] for r in got)


def simhash(t):
    w = SPACE_WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(spark, corpus):
    folder, rows = corpus
    fps = {i: simhash(t) for i, t, *_ in rows}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    want = Counter((i, f"{fps[i]:016x}", root[i]) for i, *_ in rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op6_simhash_dedup", folder)) == want


def test_licenses(spark, corpus):
    folder, rows = corpus
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))

    got = rows_of(spark, "op7_license_scan", folder)
    expected(rows, got, brute, ["n_words", "n_base", "first_word", "last_word", "base_labels"])
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_substrings(spark, corpus):
    folder, rows = corpus
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))

    def brute(t):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        return len(t), len(t) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()

    expected(rows, rows_of(spark, "op8_substring_dedup", folder), brute, ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_personal_data(spark, corpus):
    folder, rows = corpus

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m[0])
        return {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def brute(t):
        spans = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(k, m)]
        c = Counter(s[2] for s in spans)
        return c["email"], c["ip"], c["card"], c["phone"], sha(joined(spans))

    got = rows_of(spark, "op9_pii", folder)
    expected(rows, got, brute, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    assert sum(r["n_card"] for r in got) == 1


def test_decontamination(spark, corpus):
    folder, rows = corpus
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_decontaminate", folder)}
    assert {i for i, r in got.items() if r["contaminated"]} == {i for i, t, *_ in rows if t and "named here is known" in t.lower()}


def test_language(spark, corpus):
    import zlib

    folder, rows = corpus
    got = rows_of(spark, "op2_language_id", folder)
    texts = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_packing(spark, corpus):
    folder, rows = corpus
    got = rows_of(spark, "op3_best_fit_packing", folder)
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, *_ in rows)
    bins = {}
    for r in got:
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            bins.setdefault(r["bin_id"], []).append(r)
    for items in bins.values():
        items.sort(key=lambda r: r["offset"])
        ends = [r["offset"] + r["n_tokens"] for r in items]
        assert [r["offset"] for r in items] == [0, *ends[:-1]] and ends[-1] <= items[0]["bin_size"]
        assert items[0]["bin_size"] == min(s for s in (512, 1024, 2048, 4096) if s >= ends[-1])

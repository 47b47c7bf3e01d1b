"""The secret ledger over versions of paths and of rules; what it adds; columns, ties and long texts."""

import re

from erspark.llm import common, secret_scan
from erspark.llm.secret_scan import Rule


def kinds(df, rules=secret_scan.RULES):
    return {r["blob_id"]: sorted((f["kind"], f["start"]) for f in r["findings"]) for r in secret_scan.current(df, rules).collect()}


def test_two_rounds_over_versions_and_a_raised_rule(spark):
    schema = "path string, version int, text string"
    secret, plain, hexed = "token = abcdefgh", "nothing here", "x " + "0123456789abcdef" * 2
    first = spark.createDataFrame([("a", 1, secret), ("b", 1, secret), ("c", 1, hexed), ("d", 1, None)], schema)
    ledger = common.materialize(secret_scan.scan_blobs(first, secret_scan.empty_ledger(spark)), "ledger")
    assert ledger.count() == 3  # one blob of two paths, one of one, the empty one
    second = first.unionByName(spark.createDataFrame([("a", 2, plain), ("b", 2, hexed), ("e", 1, secret)], schema))
    fresh = common.materialize(secret_scan.scan_blobs(second, ledger), "fresh")
    assert [r["findings"] for r in fresh.collect()] == [[]]  # the one blob that is new
    both = ledger.unionByName(fresh)
    back = secret_scan.join_back(second, secret_scan.current(both)).collect()
    assert {(r["path"], r["version"]): len(r["findings"]) for r in back} == {("a", 1): 1, ("b", 1): 1, ("c", 1): 1, ("d", 1): 0, ("a", 2): 0, ("b", 2): 1, ("e", 1): 1}
    assert secret_scan.scan_blobs(second, both).count() == 0
    # A stricter version of one rule: blobs are scanned for it alone, and the old version's findings count no more.
    raised = tuple(Rule(r.name, 2, r.pattern, lambda m: m.end() - m.start() >= 40, True) if r.name == "hex" else r for r in secret_scan.RULES)
    again = common.materialize(secret_scan.scan_blobs(second, both, raised), "again")
    assert {tuple(r["rules"]) for r in again.collect()} == {("hex@2",)} and again.count() == 4
    now = kinds(both.unionByName(again), raised)
    assert sorted(map(len, now.values())) == [0, 0, 0, 1] and [("assign", 0)] in now.values()
    assert [("hex", 2)] in kinds(both.unionByName(again)).values()  # by the old rules they do


def test_redaction_uses_the_ledger(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (3, "AKIA" + "B" * 20 + " new"), (4, None)], "doc_id long, text string")
    old = common.materialize(secret_scan.scan_blobs(docs.where("doc_id = 1")), "old")
    want = {1: "<secret>", 2: "<secret>", 3: "<secret> new", 4: None}
    assert {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, old).collect()} == want
    forged = old.withColumn("findings", old["findings"].cast(secret_scan.FINDINGS)).selectExpr("blob_id", "rules", "transform(findings, f -> named_struct('kind', f.kind, 'version', f.version, 'start', f.start, 'end', f.start + 5)) AS findings")
    assert {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, common.materialize(forged, "forged")).collect()} == {**want, 1: "<secret> = abcdefgh", 2: "<secret> = abcdefgh"}


def test_added_kinds_ties_and_clashing_columns(spark):
    added = "-----BEGIN RSA PRIVATE KEY----- https://hooks.example.com/services/" + "T0" * 12 + " eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10
    long_text = "word " * 200_000 + "password: hunter22"
    rows = [(1, added, "mine", 7, "b"), (2, long_text, "mine", 8, "b"), (3, "secret=" + "a1" * 20, "mine", 9, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rules string, __found int, blob string")
    found = secret_scan.join_back(df, secret_scan.current(secret_scan.scan_blobs(df)))
    got = {r["doc_id"]: r.asDict(True) for r in found.collect()}
    assert [f["kind"] for f in sorted(got[1]["findings"], key=lambda f: f["start"])] == ["pem", "hook", "jwt"]
    assert [(f["kind"], f["start"]) for f in got[2]["findings"]] == [("assign", 1_000_000)] and got[3]["rules"] == "mine" and got[3]["__found"] == 9
    assert sorted((f["kind"], f["start"], f["end"]) for f in got[3]["findings"]) == [("assign", 0, 47), ("hex", 7, 47)]
    hidden = {r["doc_id"]: r.asDict() for r in secret_scan.redact(df).collect()}
    assert hidden[3] == {"doc_id": 3, "text": "<secret>", "rules": "mine", "__found": 9, "blob": "b"} and re.fullmatch("<secret> <secret> <secret>", hidden[1]["text"])

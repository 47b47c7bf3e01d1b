"""Operators beyond their queries: ledgers, alignments, refinement, links, pages and the pipeline's stages."""

import random

import numpy as np
import pytest

from erspark.llm import common, components, decontaminate, html_text, language_id, packing, secret_scan, simhash_dedup, substring_dedup


def test_ledger_scans_only_what_is_unseen(spark):
    v = spark.createDataFrame([("a", "token = abcdefgh"), ("b", "token = abcdefgh"), ("c", None)], "path string, text string")
    ledger = common.materialize(secret_scan.scan_blobs(v), "ledger")
    assert ledger.count() == 2
    more = v.unionByName(spark.createDataFrame([("d", "AKIA" + "A" * 20)], v.schema))
    fresh = secret_scan.scan_blobs(more, ledger).collect()
    assert len(fresh) == 1 and fresh[0]["findings"][0]["kind"] == "access"
    raised = tuple(secret_scan.Rule(r.name, 2, r.pattern, r.accept, r.base) if r.name == "hex" else r for r in secret_scan.RULES)
    assert {tuple(r["rules"]) for r in secret_scan.scan_blobs(v, ledger, raised).collect()} == {("hex@2",)}
    back = secret_scan.join_back(v, secret_scan.current(ledger)).collect()
    assert {r["path"]: len(r["findings"]) for r in back} == {"a": 1, "b": 1, "c": 0}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "x token = abcdefgh y", "k"), (2, None, "k"), (3, "clean", "k")], "doc_id long, text string, findings string")
    assert {r["doc_id"]: (r["text"], r["findings"]) for r in secret_scan.redact(df).collect()} == {1: ("x <secret> y", "k"), 2: (None, "k"), 3: ("clean", "k")}


@pytest.mark.parametrize("seed", range(4))
def test_refinement_equals_brute_force(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(12)]
    width = 12
    windows = [p[i : i + width] for p in parts for i in range(len(p) - width + 1)]
    got = substring_dedup.repeated(parts, width)
    for p, runs in zip(parts, got, strict=True):
        want = {i for i in range(len(p) - width + 1) if windows.count(p[i : i + width]) > 1}
        assert {i for a, e in runs for i in range(a, e + 1)} == want


def test_anchors_cut_windows_into_runs():
    text = bytes(random.Random(1).choices(b"abcdefgh", k=3000))
    place, _, first, last = substring_dedup.anchors(text, 200)
    assert first[0] == 0 and last[-1] == 2800 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + 200 - substring_dedup.Q)).all()


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_links_are_whole_whatever_the_segments(spark, segments):
    rng = random.Random(segments)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash_dedup.links_of(df, 4, segments, block=16).collect()
    near = {(a, b) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}
    pairs = {(r["a"] % 2**64, r["b"] % 2**64) for r in got}
    assert pairs <= near

    def groups(links):
        root = {f: f for f in fps}
        for _ in range(len(fps)):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(pairs) == groups(near)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.smallest_reachable(links).collect()}
    assert roots == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert components.smallest_reachable(links.where("a < 0")).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_alignment_equals_edit_distance(seed):
    rng = random.Random(seed)
    item = "".join(rng.choices("abcd ", k=120)).strip()
    index = decontaminate.Index([(9, item)], decontaminate.Budget())
    norm = decontaminate.codes_text(decontaminate.normal(item)[0])
    changed = list(norm)
    for _ in range(decontaminate.Budget().edits(len(norm))):
        at = rng.randrange(len(changed))
        rng.choice([lambda: changed.__setitem__(at, "z"), lambda: changed.pop(at), lambda: changed.insert(at, "q")])()
    text = "".join(rng.choices("efgh ", k=300)) + "x" + "".join(changed) + "x" + "".join(rng.choices("efgh ", k=300))
    hits = index.search(text)
    assert len(hits) == 1 and hits[0]["edits"] <= decontaminate.Budget().edits(len(norm))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    found = decontaminate.codes_text(decontaminate.normal(text[hits[0]["start"] : hits[0]["end"]])[0])
    assert distance(norm, found) == hits[0]["edits"]


def test_benchmark_in_blocks(spark):
    items = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {items[0]} b {items[1]} c"), (2, "nothing of the kind")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench, budget=decontaminate.Budget(block_chars=10)).collect()
    assert {r["doc_id"]: sorted(h["item_id"] for h in r["hits"]) for r in got} == {1: [0, 1], 2: []}


def test_kernel_model_tells_languages():
    rng = random.Random(3)
    words = {"xx": ["kalo", "miru", "tane", "soki"], "yy": ["brunst", "schlag", "wendt", "gruft"]}
    make = lambda g: " ".join(rng.choices(words[g], k=30))
    train = [(make(g), g) for g in ("xx", "yy") * 20]
    model = language_id.fit([t for t, _ in train], [g for _, g in train])
    f = model.scores([language_id.presence(make(g)) for g in ("xx", "yy", "xx")])
    assert [model.languages[k] for k in f.argmax(axis=1)] == ["xx", "yy", "xx"]
    assert language_id.fit([], []) is None and language_id.presence("12 !") is None


def test_best_fit_is_complete_and_shrinks():
    rng = random.Random(2)
    lengths = [rng.randint(1, 4096) for _ in range(500)]
    at, sizes = packing.pack(lengths)
    load = np.bincount(at, weights=lengths, minlength=len(sizes))
    assert (load <= sizes).all() and all(packing.shrunk(int(x), packing.Bins()) == s for x, s in zip(load, sizes, strict=True))
    assert sum(sizes) < 1.1 * sum(lengths)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies.</div><div id="wrap"><div class="post-body"><h1>A title</h1><p>First  paragraph &amp; more<br>text of the article, which is long enough.</p>
<p>Second paragraph with a <a href=y>link</a> in it, and some more words to read.</p></div><div class="comments"><p>A reader says a lot of things here, at length, again and again.</p></div></div>
<aside>side</aside><form><button>Go</button></form><script>if (a < b) { "</p>" }</script><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A title\n\nFirst paragraph & more text of the article, which is long enough.\n\nSecond paragraph with a link in it, and some more words to read."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<p>" * 3000 + "deep").endswith("deep")


def test_pages_query(spark, tmp_path):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = html_text.op10_html_text(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, len(html_text.main_text(PAGE)))] * 2 + [(2, 0), (3, 0)]


def test_pipeline_keeps_and_drops(spark, corpus):
    import corpus_pipeline
    from tests.llm.test_near_copies import groups

    folder, rows = corpus
    extra = {"hits": "x", "findings": "y", "fp": "z", "row": "w", "blob_id": "v"}
    from pyspark.sql import functions as F

    docs = common.read_table(spark, folder, "documents").withColumns({k: F.lit(v) for k, v in extra.items()})
    texts = {i: t for i, t, *_ in rows}
    alive = {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, folder), name)
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "simhash_dedup":
            order = sorted(alive)
            root = groups([texts[i] for i in order])
            alive = {i for n, i in enumerate(order) if root[n] == n}
        if name == "decontaminate":
            alive = {i for i in alive if "named here is known" not in texts[i].lower()}
        assert set(ids) == alive and (name == "language_id" or len(ids) == len(alive)), name
        assert {f"{k}={v}" for k, v in extra.items()} <= {f"{c}={docs.first()[c]}" for c in docs.columns}
    said = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(said[i] == texts[i] or "<secret>" in said[i] for i in alive) and any("<secret>" in t for t in said.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == alive
    assert packed.count() == corpus_pipeline.run(spark, folder).count()

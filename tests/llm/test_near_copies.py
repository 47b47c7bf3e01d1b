"""The pipeline's near copies against brute-force Jaccard similarity."""

import random

from erspark.llm import near_copies

SCHEMA = "doc_id long, text string"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    x, y = grams(a), grams(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def groups(texts):
    root = list(range(len(texts)))
    near = [(a, b) for a in range(len(texts)) for b in range(a) if similar(texts[a], texts[b])]
    for _ in texts:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return root


def variants(seed=4):
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 30, 100, 400]))]
        texts.append(" ".join(base))
        for _ in range(4):
            other = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * rng.randint(1, 5) // 100)):
                other[at] = f"x{rng.randrange(4000)}"
            texts.append(" ".join(other))
    return texts


def test_stage_keeps_one_of_each_group_at_080(spark):
    import corpus_pipeline

    texts = variants()
    root = groups(texts)
    assert 25 < len(set(root)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(root))


def test_groups_hand_on_a_forest_of_all_links(spark, monkeypatch):
    """Nodes of groups, some in one component already, against brute force; whatever the blocks."""
    texts = variants(7)[:60]
    made = [near_copies.sketch(near_copies.shingles(t)) for t in texts]
    sets = [near_copies.shingles(t) for t in texts]
    known = {n: min(n, made[k - k % 5][0]) if k % 5 < 2 else n for k, (n, _, _) in enumerate(made)}  # some pairs are linked already
    rows = [(int(v), band, known[n], n, len(s), sig, bands.tolist(), s.tobytes()) for (n, bands, sig), s in zip(made, sets, strict=True) for band, v in enumerate(bands)]
    df = spark.createDataFrame(rows, "v long, band int, root long, node long, size long, sig binary, bands array<long>, set binary")
    want = {n: n for n, _, _ in made}

    def join(links, root):
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    agree = [(a, b) for a in range(60) for b in range(a) if (made[a][1] == made[b][1]).any()]
    near = [(made[a][0], made[b][0]) for a, b in agree if near_copies.near(sets[a], sets[b])]
    old = [(n, known[n]) for n in known if known[n] != n]
    join(near + old, want)
    assert near and len(set(want.values())) < len(want)
    for block in (2048, 2):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        got = [(r["a"], r["b"]) for r in near_copies.across(df).collect()]
        assert join(got + old, {n: n for n in want}) == want and len(got) < len(near)


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"v{rng.randrange(9000)}" for _ in range(60)) for _ in range(4))
    near = a.replace(a.split()[0], "other", 1)
    rows = [(None, a), (None, a), (None, near), (None, b), (7, c), (7, d), (7, d), (3, d + " tail"), (5, near + " end"), (5, near + " end")]
    got = near_copies.first_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, b), (7, c), (3, d + " tail"), (5, near + " end")])


def test_pipeline_by_jaccard(spark, corpus):
    """All stages over the awkward corpus, with the near copies that brute-force Jaccard similarity finds."""
    import corpus_pipeline
    from erspark.llm import common

    folder, rows = corpus
    texts = {i: t for i, t, *_ in rows}
    alive = sorted(i for i, t in texts.items() if any(c.isalpha() for c in t or ""))
    root = groups([texts[i] for i in alive])
    alive = {i for n, i in enumerate(alive) if root[n] == n}
    docs = common.read_table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, folder), name)
        if name == "decontaminate":
            alive = {i for i in alive if "named here is known" not in texts[i].lower()}
        if name in ("simhash_dedup", "decontaminate", "secret_scan"):
            assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(alive), name
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()} == alive

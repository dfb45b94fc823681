"""The pipeline's near-duplicate stage: likeness from 0.8 against brute force, edges."""

import random

import corpus_pipeline
from ferrule.llm import common, minhash, simhash

from .fixtures import DOCS, widened


def likeness(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5)) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def changed(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicate_stage_catches_replaced_words(spark):
    rng = random.Random(4)
    texts = [r["text"] for r in common.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").limit(300).collect()]
    texts = [t for t in dict.fromkeys(texts) if len(t.split()) > 150]
    rows, near = [], {}
    for i, t in enumerate(texts):
        rows.append((i, t))
        for k, n in enumerate((1, 2, 3, 4, 6)):
            copy = changed(rng, t, n)
            rows.append((10_000 + 10 * i + k, copy))
            if likeness(t, copy) >= 0.8:
                near[10_000 + 10 * i + k] = i
    assert len(near) > 300
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, "unused").collect()}
    assert sum(i not in kept for i in near) >= 0.99 * len(near)


def test_components_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for g in range(25):  # chains of changes: members are alike a few steps apart only
        text = " ".join(f"w{rng.randrange(10**5)}" for _ in range(120))
        for k in range(20):
            rows.append((g * 100 + k, text))
            text = changed(rng, text, rng.choice([0, 1, 2, 3]))
    rng.shuffle(rows)
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  b"), (None, rows[0][1]), rows[0]]
    found = {r["doc_id"]: r["component_id"] for r in minhash.shingle_near_duplicates(widened(spark, rows)).collect()}
    named = [(i, t) for i, t in rows if i is not None]
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in named}
    prints = {i: simhash.fingerprint(t, 5) for i, t in named}
    label, moved = {i: i for i in sets}, True
    links = [(a, b) for a in sets for b in sets if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0 or (prints[a] ^ prints[b]).bit_count() <= 2)]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert found == label
    assert minhash.shingle_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_of_one_id_are_told_apart_by_text(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(10**5)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a, "en", "x", 0), (2, b, "en", "x", 0), (2, a, "en", "x", 0), (3, c, "en", "x", 0), (3, c, "fr", "y", 1), (3, c, "fr", "y", 1), (None, a, "en", "x", 0), (None, a, "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (1, 5):  # whatever the order the rows come in
        kept = corpus_pipeline.simhash_stage(spark, docs.repartition(part), "unused").collect()
        assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], rows[1], rows[3], rows[6], rows[7]], key=repr)


def test_stage_against_brute_force_on_a_whole_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in rows.items()}
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows.items()}
    label = {i: i for i in rows}
    links = [(a, b) for a in rows for b in rows if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0 or (prints[a] ^ prints[b]).bit_count() <= 2)]
    for _ in rows:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.simhash_stage(spark, docs, "unused").collect()}
    assert kept == {i: t for i, t in rows.items() if label[i] == i}


def test_members_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):  # families whose members share keys but not always enough
        text = " ".join(rng.sample(words, 200))
        for k in range(25):
            rows.append((100 * g + k, changed(rng, text, rng.choice([2, 4, 6, 9]))))
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in rows}
    prints = {i: simhash.fingerprint(t, 5) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2)]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r["doc_id"]: r["component_id"] for r in minhash.shingle_near_duplicates(widened(spark, rows)).collect()}
    assert found == label and len(set(label.values())) < len(rows) and {r for r in label.values()} != {0}

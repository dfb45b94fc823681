"""Substring operators, BPE, packing, embeddings and the pipeline: brute force, round trips, edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ferrule.llm import bpe, common, components, embeddings, packing, queries, simhash, substrings, suffixes

from .fixtures import DOCS, hostile_texts, widened

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return hostile_texts()


@pytest.fixture(scope="module")
def reference_tokenizer():
    return Tokenizer.from_file(PATH)


def brute_words(docs, size=50):
    words, first = {i: (t or "").encode().split() for i, t in docs}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][p : p + size]), i)
    out = {}
    for i, w in words.items():
        gone = bytearray(len(w))
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = b"\1" * size
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def brute_bytes(docs, size=100):
    seen, out = set(), {}
    for i, t in sorted(dict(docs).items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if b[p : p + size] in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(b[p : p + size])
        runs = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def test_word_windows_against_brute_force(spark, rows):
    got = substrings.dedup_words(widened(spark, rows)).collect()
    expected = brute_words(dict(rows).items())
    assert len(got) == len(rows) and sum(v[1] for v in expected.values()) > 0
    for r in got:
        assert tuple(r)[1:] == expected[r["doc_id"]], r["doc_id"]


def test_word_windows_edges(spark):
    assert substrings.dedup_words(spark.createDataFrame([], DOCS)).count() == 0
    passage = " ".join(map(str, range(50)))
    rows = [(None, passage), (1, passage), (2, "a  b\n" + passage + "\nend"), (3, passage)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_words(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {None: 0, 1: 0, 2: 50, 3: 50}
    kept = {r["doc_id"]: r["text"] for r in substrings.without_repeats(widened(spark, rows)).collect()}
    assert kept == {None: passage, 1: passage, 2: "a  b\nend"}
    with pytest.raises(ValueError):
        substrings.window_spans(spark.createDataFrame(rows, DOCS), 30)


def test_recompression_names_equal_windows_alike():
    rng = random.Random(1)
    for _ in range(200):
        middle = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(50)]
        keys = set()
        for _ in range(4):
            left = [rng.choice([b"a", b"b", b"z"]) for _ in range(rng.randint(0, 20))]
            right = [rng.choice([b"a", b"c", b"y"]) for _ in range(rng.randint(0, 20))]
            keys.add(int(substrings.window_keys(substrings.hashes_of(left + middle + right))[len(left)]))
        assert len(keys) == 1 and 0 not in keys


@pytest.mark.parametrize("shard_bytes", [suffixes.SHARD_BYTES, 500])
def test_byte_windows_against_brute_force(spark, rows, shard_bytes, monkeypatch):
    whole = suffixes.shard_repeats
    monkeypatch.setattr(suffixes, "shard_repeats", lambda bodies, window: whole(bodies, window, shard_bytes))
    got = suffixes.dedup_bytes(widened(spark, rows)).collect()
    expected = brute_bytes(rows)
    assert len(got) == len(rows) and sum(v[1] for v in expected.values()) > 0
    for r in got:
        assert (*tuple(r)[1:4], bytes(r["kept"])) == expected[r["doc_id"]], r["doc_id"]


def test_byte_windows_edges(spark, monkeypatch):
    assert suffixes.dedup_bytes(spark.createDataFrame([], DOCS)).count() == 0
    monkeypatch.setattr(suffixes, "CHUNK", 64)  # documents longer than a chunk
    rows = [(1, "x" * 1000), (2, "é" * 200 + "abc" * 90), (3, "abc" * 90)]
    got = {r["doc_id"]: (*tuple(r)[1:4], bytes(r["kept"])) for r in suffixes.dedup_bytes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_bytes(rows)


@pytest.mark.parametrize("hot_bytes", [0, 2000])
def test_hot_keys_get_longer_keys(spark, rows, hot_bytes, monkeypatch):
    whole = suffixes.repeated_bytes
    monkeypatch.setattr(suffixes, "repeated_bytes", lambda docs, window: whole(docs, window, hot_bytes))
    got = suffixes.dedup_bytes(widened(spark, rows)).collect()
    expected = brute_bytes(rows)
    for r in got:
        assert (*tuple(r)[1:4], bytes(r["kept"])) == expected[r["doc_id"]], r["doc_id"]


def test_repeated_and_conflicting_ids(spark):
    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = line(170)
    t, u, v = (line(90) + passage + line(90) for _ in range(3))
    rows = [(1, t), (1, t), (2, u), (3, v), (4, line(300)), (4, u), (None, t)]
    got = suffixes.dedup_bytes(widened(spark, rows)).collect()
    alone = brute_bytes([(1, t), (2, u), (3, v)])
    assert alone[1][1] == 0 < alone[2][1]
    assert sorted(r["n_removed"] for r in got if r["doc_id"] in (1, None)) == [0, 0, 0] and len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert (*tuple(r)[1:4], bytes(r["kept"])) == alone[r["doc_id"]]
    # of the two texts of 4 the one with the smallest hash is the document
    hashed = {xxhash.xxh64_intdigest(x, 42) - ((xxhash.xxh64_intdigest(x, 42) >> 63) << 64): x for x in (rows[4][1].encode(), u.encode())}
    assert (hashed[min(hashed)] == u.encode()) == any(r["n_removed"] for r in got if r["doc_id"] == 4)

    words = " ".join(map(str, range(60)))
    rows = [(1, "a " + words), (1, "a " + words), (2, "b " + words + " c"), (2, "other text"), (3, words + " d")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup_words(widened(spark, rows)).collect()))
    chosen = min(("b " + words + " c", "other text"), key=lambda x: (xxhash.xxh64_intdigest(x, 42) + (1 << 63)) % (1 << 64))
    assert got == [(1, 61, 0), (1, 61, 0), (2, 2, 0), (2, 62, 60 if chosen != "other text" else 0), (3, 61, 60)]
    kept = [r["text"] for r in substrings.without_repeats(widened(spark, rows)).collect()]
    assert sorted(kept) == sorted(["a " + words, "a " + words, "other text", "b c" if chosen != "other text" else "b " + words + " c", "d"])


def test_shards_of_one_key_are_merged(spark, monkeypatch):
    rng = random.Random(8)
    body = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line = " this line of text stands in all documents, and in each among others "
    texts = [body(90) + line + body(90) for _ in range(9000)]
    texts += [texts[i][20:-20] + "!" for i in rng.sample(range(9000), 300)]
    rows = list(enumerate(texts))
    parts = []
    whole = suffixes.shard_repeats

    def counted(bodies, window):
        parts.append(bodies.groupBy("key").agg(F.sum(F.length("body")).alias("n")).where(F.col("n") > suffixes.SHARD_BYTES).count())
        return whole(bodies, window)

    monkeypatch.setattr(suffixes, "shard_repeats", counted)
    got = suffixes.dedup_bytes(spark.createDataFrame(rows, DOCS)).collect()
    assert parts[0] > 0
    expected = brute_bytes(rows)
    for r in got:
        assert (*tuple(r)[1:4], bytes(r["kept"])) == expected[r["doc_id"]], r["doc_id"]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for alphabet, n in ((2, 300), (1, 50), (26, 500), (2, 1)):
        data = rng.integers(97, 97 + alphabet, n).astype(np.uint8)
        body = data.tobytes()
        order = suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(n), key=lambda i: body[i:])
        prefix = suffixes.common_prefixes(data, order, 20, lane=16)
        for k in range(1, n):
            a, b = body[order[k - 1] :], body[order[k] :]
            m = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert prefix[k] == min(20, m)


def test_bpe_equals_the_library(spark, rows, reference_tokenizer):
    rng = random.Random(3)
    parts = list("aAbBéÉΣςσ'sStTdD 123½²  ̣́İıſK中文-–—…\x1c\x85🎉𐐀ŦŸﬁ한하") + ["<|endoftext|>", "<|startoftext|>", "the ", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["a" * 500, "=-" * 900, "é" * 300, "0" * 100]
    own = bpe.WordBpe(PATH)
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        expected = reference_tokenizer.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == expected, text
        assert own.decode(ids) == reference_tokenizer.decode(expected, skip_special_tokens=False)
    got = bpe.decode_documents(bpe.encode_documents(widened(spark, rows), PATH), PATH).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        expected = reference_tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected and r["n_tokens"] == len(expected)
    assert bpe.encode_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    changes = {
        "normalizer": lambda s: s["normalizer"]["normalizers"].pop(),
        "pre_tokenizer": lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True),
        "decoder": lambda s: s.update(decoder={"type": "ByteLevel"}),
        "model": lambda s: s["model"].update(ignore_merges=True),
        "added_tokens": lambda s: s["added_tokens"][0].update(lstrip=True),
    }
    for name, change in changes.items():
        other = json.loads(json.dumps({**spec, "model": {**spec["model"], "merges": [], "vocab": {}}}))
        change(other)
        (tmp_path / "t.json").write_text(json.dumps(other))
        with pytest.raises(ValueError, match=name):
            bpe.WordBpe(str(tmp_path / "t.json"))


def test_forced_boundaries_are_in_no_token():
    own = bpe.WordBpe(PATH)
    flat, start, stop, final = own.fragments([b"thing", b"z\xffq"])
    assert final.sum() == 2 and stop[-1] == len(flat)
    for a, b in zip(stop[:-1], start[1:], strict=True):
        assert a == b
    for a in stop[:-1]:
        if not final[np.flatnonzero(stop == a)[0]]:
            assert not own.joined[flat[a - 1], flat[a]]


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_CACHE", 10)
    own, whole = bpe.WordBpe(PATH), bpe.WordBpe(PATH)
    texts = [" ".join(f"w{i * j}" for j in range(8)) for i in range(20)]
    for t in texts:
        assert own.encode(t).tolist() == whole.encode(t).tolist()
        assert len(own.words) <= 10


def check_packing(rows, texts, tokenizer, most=4096):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in texts.items():
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["tier"] <= most and at & (at - 1) == 0
    groups = {}
    for s in by_sequence.values():
        key = s[0]["step_group"]
        groups[key] = groups.get(key, 0) + s[0]["tier"]
    assert max(groups.values()) <= 65_536


def test_packing(spark, rows, reference_tokenizer):
    texts = dict(rows)
    got = packing.pack_documents(widened(spark, list(texts.items())).repartition(3), PATH).collect()
    check_packing(got, texts, reference_tokenizer)
    for r in got[:50]:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    few = packing.pack_documents(widened(spark, list(texts.items())).coalesce(1), PATH, open_windows=2).collect()
    check_packing(few, texts, reference_tokenizer)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0
    twice = packing.pack_documents(spark.createDataFrame([(1, "a"), (1, "a")], DOCS), PATH).collect()
    assert sum(r["length"] for r in twice) == 4


def brute_links(rows, least=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    link = x @ x.T >= least
    np.fill_diagonal(link, False)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(ids)).min(axis=1))
        if (low == label).all():
            break
        label = low
    out = {i: (0, i, True) for i, _ in rows}
    out |= {i: (int(link[k].sum()), ids[label[k]], ids[label[k]] == i) for k, i in enumerate(ids)}
    return out


def test_embeddings_against_brute_force(spark):
    base = [r["embedding"] for r in common.table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").limit(150).collect()]
    rng = np.random.default_rng(0)
    rows = list(enumerate(base)) + [(300 + i, base[7]) for i in range(30)]
    rows += [(400 + i, (np.array(base[9]) + rng.normal(0, 0.005, 64)).tolist()) for i in range(700)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] + [1.0] * 63), (2004, [None] + [1.0] * 63), (2005, [1e38] * 64), (2006, [float("inf")] * 64)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, pivots string")
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.embedding_near_duplicates(df).collect()}
    assert got == brute_links(rows)
    assert embeddings.embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * away
    pivots = embeddings._apart(x[:600], 512, 0.7)
    near = [np.argsort(-(v @ pivots.T), axis=1)[:, :8] for v in (x, y)]
    shared = (near[0][:, :, None] == near[1][:, None, :]).sum(axis=(1, 2))
    assert (shared >= 4).mean() >= 0.9


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}


def test_pipeline_stages_against_brute_force(spark, reference_tokenizer, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    extra = spark.createDataFrame([(9001, "12 34 !!", "en", "x", 8), (9002, None, None, "x", 0), (9003, docs.first()["text"], "en", "x", 1), (9004, "the token = abcdef123456 of and the for", "en", "x", 9)], docs.schema)
    docs = common.cut(docs.unionByName(extra))
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, "unused"))
        found[name] = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect()
    first = found["language"]
    assert 9001 not in first and 9002 not in first and 9003 in first
    prints = {i: simhash.fingerprint(r["text"], 5) for i, r in first.items()}
    sets = {i: set(simhash.shingle_hashes(r["text"], 5)) for i, r in first.items()}
    # the stage's rule: a likeness of 0.8 and more, or two bits at most
    near = {(a, b) for a in prints for b in prints if bin(prints[a] ^ prints[b]).count("1") <= 2 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    kept = {i for i in prints if label[i] == i}
    assert set(found["near_duplicates"]) == kept and 9003 not in kept
    words = brute_words([(i, found["near_duplicates"][i]["text"]) for i in kept])
    third = found["repeated_passages"]
    for i, (n, gone, text) in words.items():
        assert (i in third) == (n == 0 or gone < n)
        if i in third:
            assert " ".join(third[i]["text"].split()) == " ".join(text.split())
            assert third[i]["n_chars"] == len(third[i]["text"])
    assert "<SECRET>" in found["secrets"][9004]["text"] and set(found["secrets"]) == set(third)
    check_packing(found["packing"], {i: r["text"] for i, r in found["secrets"].items()}, reference_tokenizer)


def test_queries_have_their_contracted_columns(spark, sf_dir):
    expected = {
        "op1_quality": ["doc_id", "held_out", "score", "predicted"],
        "op2_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op3_embeddings": ["vec_id", "n_links", "component_id", "kept"],
        "op4_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op5_simhash": ["doc_id", "fingerprint", "component_id"],
        "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op7_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op9_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op11_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
        "op12_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
        "op13_html": ["page_id", "url", "text", "n_chars"],
    }
    assert set(queries.QUERIES) == set(expected)
    for name, columns in expected.items():
        assert queries.QUERIES[name](spark, sf_dir).columns[: len(columns)] == columns


def test_words_are_looked_up_once_and_byte_pairs_in_a_table(reference_tokenizer):
    own = bpe.WordBpe(PATH)
    for a, b in (("t", "h"), ("e", "r"), ("q", "z"), ("\xff", "0")):
        for end in ("", own.end):
            pair = own.chars.index(a) if a in own.chars else 0, own.chars.index(b) + 256 * bool(end)
            assert own.byte_ranks[pair] == own.rank.get((own.chars[pair[0]], b + end), bpe.NO_MERGE)
    text = "the other queen's 12 thé <|endoftext|> the"
    for _ in range(2):  # unknown words are noted by the lookup that finds the known ones
        ids = own.encode_many([text, None, "", "the"])
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference_tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", "", "the")]
    assert not own.words.unknown and own.words.look(["the", "unheard-of"])[1] is None and list(own.words.unknown) == ["unheard-of"]

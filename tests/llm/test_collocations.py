"""Phrases against brute force: cuts, subsumption, slices that cut texts, ties and edges."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, word string, n long, slice string, id string"


def brute_force(rows, least, longest, share, top):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    kept = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in kept.items():
        longer = [f for (m, v), f in kept.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * f >= share * a for f in longer):
            continue
        cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def texts(seed, n=80):
    dice = random.Random(seed)
    words = ["a", "B", "b", "the", "of", "Été", "été", "🎉", "x-1", " ", "aaa"]
    rows = []
    for _ in range(n):
        made = []
        for _ in range(dice.choice([0, 1, 5, 40])):
            made.append(dice.choice(words) if dice.random() < 0.7 else "new york  times")
            made.append(dice.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "?!"]))
        rows.append(("".join(made), dice.choice(["en", "fr", None])))
    return [*rows, (None, "en"), ("", None), (" . ", "de"), rows[3], rows[3], ("a " * 500, "en"), ("a a. " * 300, "fr")]


def found(spark, rows, **more):
    df = spark.createDataFrame([(i % 7, t, lang, "w", 1, "s", "i") for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = C.collocations(df, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("seed", "least", "longest", "share", "top"), [(1, 3, 3, 50, 20), (2, 2, 4, 80, 2000), (3, 2, 2, 50, 7)])
def test_against_brute_force(spark, seed, least, longest, share, top):
    rows = texts(seed)
    want = brute_force(rows, least, longest, share, top)
    assert want
    assert found(spark, rows, least=least, longest=longest, share=share, top=top) == want


@pytest.mark.parametrize("most", [40, 300])
def test_texts_longer_than_a_slice(spark, monkeypatch, most):
    """Slices cut texts everywhere, also inside pieces without any end; counts stay the same."""
    monkeypatch.setattr(C, "SLICE_BYTES", most)
    rows = [*texts(5, n=20), ("one two three four five " * 60, "en"), ("w" * 500 + " x y", "en"), ("no end here " * 9 + ". " + "b c " * 30, None)]
    assert found(spark, rows, least=3, longest=3, share=50, top=500) == brute_force(rows, 3, 3, 50, 500)


def test_no_words_at_all(spark):
    assert found(spark, []) == [] == found(spark, [(None, None), ("", "en"), (" ,. ", "en")])


def test_arithmetic_beyond_64_bits(spark):
    """Counts whose products pass 64 bits keep their exact quotient, as the query's expression computes it."""
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    df = spark.createDataFrame([(a, [left], [right])], "n long, before array<long>, after array<long>")
    wide = "cast(cast({} as decimal(16,0)) * cast({} as decimal(16,0)) as decimal(32,0))"
    score = f"cast({wide.format('n', 'n')} * cast(1000000 as decimal(7,0)) as decimal(38,0)) div {wide.format('before[0]', 'after[0]')}"
    assert df.selectExpr(f"{score} as s").first()["s"] == 10**6 * a * a // (left * right)


def test_numbers_survive_packing():
    dice = np.random.default_rng(1)
    x = np.concatenate([[0, 1, 127, 128, 16383, 16384, (1 << 62) + 5], dice.integers(0, 1 << 40, 1000), np.zeros(5, int)])
    data, size = C.packed(x)
    assert size.sum() == len(data) and (C.unpacked(data.tobytes()) == x).all()
    assert len(C.unpacked(b"")) == 0 == len(C.packed(np.empty(0, int))[0])
    places, sizes = np.array([3, 5, 9, 0, 7, 2]), np.array([3, 2, 1])
    assert (C._places(C._steps(places, np.cumsum(sizes) - sizes), sizes) == places).all()


def test_parts_hold_every_word_once():
    text = ("ab cd. ef  gh\tij" * 40 + " " + "k" * 90 + " l m, n").encode()
    for most in (5, 17, 64, 10_000):
        got = [w for lead, part in C.parts_of(text, most, 2) for w in re.findall(rb"[^ \t.,]+", part)[lead:]]
        assert got == re.findall(rb"[^ \t.,]+", text)

"""Every stage on an empty table, and on rows with nulls, repeats and columns named like those the operators use."""

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from ferrule.llm import bpe, common

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_an_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], KIND), "unused")
        assert out.count() == 0 and (name == "packing" or out.columns == [c.split()[0] for c in KIND.split(", ")])


def test_stages_on_hostile_rows(spark):
    english = "the cat and the dog went to the house of the man with the hat and they sat there for a while "
    rows = [(i, english * (i + 1) + f"number {i}", "en", "x", 5) for i in range(6)]
    rows += [(0, rows[0][1], "en", "x", 5), (None, rows[1][1], "en", "y", 5), (None, None, None, None, None), (7, None, "en", "x", 0), (8, "", "en", "x", 0), (9, " \n ", "en", "x", 0), (10, "password = hunter22x", "en", "x", 0)]
    extra = ", ".join(f"{c} string" for c in ("score", "lang_pred", "fingerprint", "component_id", "kept", "text_hash", "repeated_ranges", "secret_spans", "row", "b"))
    docs = spark.createDataFrame([(*r, *"0123456789") for r in rows], f"{KIND}, {extra}")
    ids = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        if name != "packing":
            assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple("0123456789")}
        found = ids(out)
        if name == "language":
            assert found == [-1, 0, 0, 1, 2, 3, 4, 5, 10]
        elif name == "near_duplicates":
            assert found.count(0) == 1 and found.count(-1) == 2 and 10 in found
        elif name == "repeated_passages":
            assert found.count(0) == 2 and found.count(-1) == 2 and {7, 8, 9, 10} <= set(found)
        elif name == "secrets":
            assert len(found) == len(rows) and [r["text"] for r in out.where("doc_id = 10").collect()] == ["<SECRET>"]
        else:
            assert set(found) == {-1, *range(11)} - {6}


def test_other_operators_drop_the_encoder():
    """A worker that packed holds no tokenizer's tables while it runs another stage, and small slices while it packs."""
    bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    assert list(common.each([])) == [] and bpe.load.cache_info().currsize == 0
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 400] * 2000})
    assert max(sum(map(len, texts)) for (texts,) in common.slices([batch])) <= 1_100_000

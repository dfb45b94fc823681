"""Main text of pages: planted articles, edges, and the tree against exhaustive search."""

import html
import random
import re

import duckdb
import numpy as np
import pytest

from ferrule.llm import pages
from ferrule.llm.common import table
from ferrule.llm.queries import QUERIES

TREE = pages.block_tree()


def _main(page):
    return "\n\n".join(pages.main_blocks(page, TREE))


def test_whole_pages_against_their_articles(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in QUERIES["op13_html"](spark, folder).collect()}
    rows = duckdb.sql(f"select page_id, url, html from '{folder}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for page_id, url, page in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article[1] if article else "")]
        text = "\n\n".join(p for p in parts if p)
        assert (got[page_id]["url"], got[page_id]["text"], got[page_id]["n_chars"]) == (url, text, len(text))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<", "<"),
        ("<article><p>a &lt;b&gt; &amp;amp; caf&eacute; &#233;&nbsp;x\n\t y</p></article>", "a <b> &amp; café é x y"),
        ("<article><p>one<br>two</p><script>if (a<b) '</p>'</script><style>p{}</style><p>three <b>bold</b>er</p></article>", "one two\n\nthree bolder"),
        ('<article><p>kept it is.</p><div class="sidebar"><p>not this one.</p></div><p>kept too.</p></article>', "kept it is.\n\nkept too."),
        ("<article><h1>Head</h1><p>Body text of the page.</p></article><section id='comments'><article><p>A long comment of a reader, with many words in it, as they are.</p></article></section>", "Head\n\nBody text of the page."),
        ('<div class="content has-sidebar"><div class="entry-header"><h1>Some title here</h1></div><p>Text of the entry, long enough to be one.</p></div>', "Some title here\n\nText of the entry, long enough to be one."),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>cut off in a <b", "cut off in a"),
        ('<article><p>quoted <img alt="a > b"> sign</p></article>', "quoted sign"),
        ("<!-- <article><p>no</p></article> --><article><p>yes.</p></article>", "yes."),
        ('<article><p>seen.</p><p hidden>unseen</p><div style="display:none"><p>unseen too</p></div></article>', "seen."),
        ("<form><p>Your name and your address, please.</p></form><article><p>Text.</p></article>", "Text."),
    ],
)
def test_small_pages(page, text):
    assert _main(page) == text


def test_rows_at_the_edges(spark):
    schema = "page_id bigint, url string, html string, text int, n_chars string"
    rows = [(1, "u", None, 1, "x"), (2, None, "", 1, "x"), (None, "u", "<article><p>a b.</p></article>", 1, None), (3, "u", "<article><p>a b.</p></article>", 1, None), (3, "u", "<article><p>a b.</p></article>", 2, None)]
    long = "<article>" + "<p>word " * 200_000 + "</article>"
    got = pages.extract_pages(spark.createDataFrame([*rows, (4, "u", long, 1, None)], schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(got.collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in found] == [(1, "u", 0), (2, None, 0), (3, "u", 4), (3, "u", 4), (4, "u", 200_000 * 6 - 2), (None, "u", 4)]
    assert found[4]["text"].count("word") == 200_000
    assert pages.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_hostile_markup_takes_linear_time():
    for page in ("<a href=\"" * 50_000, "<p " * 100_000, "<!--" * 100_000, "<div>" * 100_000 + "x", "<script>" * 50_000, "&" * 100_000, "</div>" * 100_000):
        pages.main_blocks(page, TREE)


def test_tree_splits_as_exhaustive_search_does():
    dice = np.random.default_rng(3)
    x, y = dice.integers(0, 6, (60, 4)).astype(float), dice.integers(0, 2, 60)
    tree = pages.grow_tree(x, y, depth=1, least=1)

    def impurity(side):
        return len(side) * side.mean() * (1 - side.mean()) if len(side) else np.inf

    costs = {(f, b): impurity(y[x[:, f] <= b]) + impurity(y[x[:, f] > b]) for f in range(4) for b in np.unique(x[:, f])[:-1] + 0.5}
    assert np.isclose(costs[int(tree.feature[0]), float(tree.bound[0])], min(costs.values()))


def test_tree_tells_blocks_of_pages_left_out():
    """Of every page left out in turn, the tree of the others tells nine blocks in ten."""
    right = total = 0
    everything = pages.LABELLED
    for out in random.Random(2).sample(range(len(everything)), 10):
        pages.LABELLED = everything[:out] + everything[out + 1 :]
        tree = pages.grow_tree(*pages.labelled_blocks())
        pages.LABELLED = [everything[out]]
        x, y = pages.labelled_blocks()
        right, total = right + int(((tree.shares(x) >= 0.5) == y).sum()), total + len(y)
        pages.LABELLED = everything
    assert right >= 0.9 * total


def test_a_remote_path_and_the_table_reader_agree(spark):
    assert table(spark, "/root/testdata/sf0.001", "pages").count() == QUERIES["op13_html"](spark, "file:///root/testdata/sf0.001").count()

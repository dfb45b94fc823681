"""Main text of web pages: flat text blocks, told apart by a decision tree.

A page is cut into flat blocks at its block-level tags; a block has its text,
whether its words are links, and what the tags around it say. Of each block the
tree sees the word count and link density of the block and of its two
neighbours, the kind of region it lies in, and the form of its text. The tree
is grown here, on the blocks of LABELLED, a table of pages whose words say
themselves whether they are main text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded_batches, release

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[a-z]+")

# Elements of HTML by what they do to text.
#: What they hold is no text of the page.
SILENT = "head script style noscript template svg math iframe object canvas audio video map datalist".split()
#: Their content is no markup, up to their own end tag.
RAW = "script style textarea title noscript iframe xmp noembed noframes".split()
#: They end a block.
BREAKING = "html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside form fieldset legend label select option button textarea input blockquote pre figure figcaption address hr details summary dialog menu center title".split()
#: They hold blocks, so their names and classes speak of all that is in them.
HOLDING = "body div section article main header footer nav aside form fieldset ul ol dl table figure details dialog menu blockquote select button label textarea".split()
#: Regions without main text, by element.
ASIDE = "nav footer aside form fieldset menu dialog select button label textarea".split()
#: Words of classes, ids and roles that speak against main text.
AGAINST = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "comment comments reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations more widget widgets copyright legal disclaimer pagination pager tags search complementary contentinfo teaser outbrain taboola"
).split()
#: Words of classes, ids and roles that speak for it.
TOWARDS = "article content post entry story text main body page".split()

_SILENT, _RAW, _BREAKING, _HOLDING, _ASIDE, _AGAINST, _TOWARDS = (frozenset(x) for x in (SILENT, RAW, BREAKING, HOLDING, ASIDE, AGAINST, TOWARDS))
_LAYOUT = frozenset({"has", "with", "no", "without"})
_COMPOUND = re.compile("|".join(w for w in AGAINST if len(w) > 6))

#: Features of a block, in order.
FEATURES = [
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "region", "against", "towards", "has_article", "heading", "item", "paragraph", "sentence", "sign",
]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    region: int
    against: int
    towards: int
    tag: str


def _speaks_against(named: set[str]) -> bool:
    """Whether these words of a class, id or role name a part without main text (not one that merely "has-sidebar", nor an "entry-header")."""
    if not named or named & _LAYOUT:
        return False
    return bool(named & _AGAINST - ({"header"} if named & _TOWARDS else set())) or any(_COMPOUND.search(w) for w in named if len(w) > 7)


class _Region:
    """An open element that holds blocks, with what it and those around it say."""

    __slots__ = ("against", "region", "silent", "tag", "towards")

    def __init__(self, tag: str, rest: str, outer: _Region | None):
        self.tag = tag
        named = set(_WORDS.findall(" ".join(a or b or c for a, b, c in _NAMED.findall(rest)).lower())) if rest else set()
        self.silent = (outer.silent if outer else False) or bool(rest and _HIDDEN.search(rest))
        inner, around = outer.region if outer else 0, outer.against if outer else 0
        if tag in ("article", "main"):
            # an article inside an aside or among comments is none of its own
            self.region, self.against = (1, 0) if inner >= 0 and not around else (inner, around)
        elif tag in _ASIDE:
            self.region, self.against = -1, around
        elif tag == "header":
            self.region, self.against = (inner, around) if inner else (-1, around)
        else:
            self.region, self.against = inner, around
        if tag not in ("body", "article", "main") and _speaks_against(named):
            self.against = 1
        self.towards = int((outer.towards if outer else 0) or bool(named & _TOWARDS and not named & _AGAINST))


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page in order; unclosed and stray tags are taken as a browser would."""
    found: list[Block] = []
    stack: list[_Region] = []
    held: list[str] = []
    links: list[str] = []
    tag, in_link, silent, hidden = "", 0, "", False

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                top = stack[-1] if stack else None
                words = len(text.split())
                linked = min(words, len(html.unescape("".join(links)).split())) if links else 0
                if not (hidden or top and top.silent):
                    found.append(Block(text, words, linked, top.region if top else 0, top.against if top else 0, top.towards if top else 0, tag))
            held.clear()
            links.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        start = m.start() if m else n
        if start > at and not silent:
            piece = page[at:start]
            held.append(piece)
            if in_link:
                links.append(piece)
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        closing = bool(m["close"] or m["close2"])
        if silent:
            if closing and name == silent or silent == "head" and name == "body":
                silent = ""
            else:
                continue
        if name in _RAW and not closing:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            if name in ("textarea", "title"):
                end()
            at = stop.start() if stop else n
            continue
        if name in _SILENT:
            if not closing and not (m["rest"] or m["rest2"] or "").endswith("/"):
                end() if name == "head" else None
                silent = name
            continue
        if name == "a":
            if in_link:
                links.append(" ")
            in_link = 0 if closing else 1
            continue
        if name == "br":
            held.append(" ")
            if in_link:
                links.append(" ")
            continue
        if name not in _BREAKING:
            continue
        end()
        if not closing:
            tag, hidden = name, bool(_HIDDEN.search(m["rest"] or m["rest2"] or ""))
        elif tag == name:
            tag, hidden = "", False
        if name in _HOLDING:
            if not closing:
                stack.append(_Region(name, m["rest"] or m["rest2"] or "", stack[-1] if stack else None))
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == name:
                        del stack[i:]
                        break
    end()
    return found


def block_features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of one page."""
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked for b in blocks], float) / words
    x[:, 0], x[:, 1] = words, links
    x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
    x[:, 6] = [b.region for b in blocks]
    x[:, 7] = [b.against for b in blocks]
    x[:, 8] = [b.towards for b in blocks]
    x[:, 9] = (x[:, 6] > 0).any()
    x[:, 10] = [b.tag[:1] == "h" and b.tag[1:].isdigit() for b in blocks]
    x[:, 11] = [b.tag == "li" for b in blocks]
    x[:, 12] = [b.tag in ("p", "blockquote", "pre") for b in blocks]
    x[:, 13] = [b.text[-1] in ".!?:…。！？\"'”»)" for b in blocks]
    x[:, 14] = [any(c in b.text for c in "©®™") for b in blocks]
    return x


# The labelled table: {m9} stands for nine words of main text, {b3} for three others.
LABELLED = [
    '<nav><ul><li><a href="/">{b1}</a></li><li><a href="/">{b2}</a></li><li><a href="/">{b1}</a></li></ul></nav><div class="ad">{b8}.</div><article><h1>{m7}.</h1><p><b>{m7}.<br><p>{m60}.</p><p>{m2}.</p><p>{m25}.</p></article><footer>&copy; {b2} &middot; {b9}.</footer>',
    '<nav><a href="/">{b1}</a> <a href="/">{b1}</a></nav><div class="ad">{b12}. {b6}.</div><article><h1>{m3}</h1><p>{m1}.</p><p>{m1}</p><p>{m80}.</p><p>{m3}.</p></article><footer>&copy; {b3} {b14}.</footer>',
    "<header><h1>{b2}</h1><p>{b6}</p></header><main><h2>{m5}</h2><p>{m30}.</p><ul><li>{m6}</li><li>{m9}.</li><li>{m4}</li></ul><p>{m45} <a href='/'>{m3}</a> {m9}.</p></main><aside><h3>{b2}</h3><p>{b20}.</p><ul><li><a href='/'>{b6}</a></li></ul></aside><footer><p>{b12}.</p></footer>",
    '<div id="header"><div>{b3}</div><ul class="menu"><li><a href="/">{b1}</a></li><li><a href="/">{b1}</a></li></ul></div><div id="content"><h1>{m6}</h1><p>{m50}.</p><p>{m4}.</p><h2>{m3}</h2><p>{m35}.</p></div><div id="sidebar"><h3>{b2}</h3><p>{b15}.</p><p><a href="/">{b5}</a></p></div><div id="footer"><p>{b10}.</p></div>',
    '<div class="cookie-notice"><p>{b24}.</p><button>{b1}</button></div><div class="post"><h1>{m8}</h1><p>{m70}.</p><blockquote>{m22}.</blockquote><p>{m18}.</p></div><div class="comments"><h2>{b1}</h2><div class="comment"><p>{b30}.</p></div><div class="comment"><p>{b5}!</p></div><form><label>{b2}</label><textarea></textarea><button>{b2}</button></form></div>',
    '<article><header><h1>{m9}</h1><p>{m12}.</p></header><p>{m55}.</p><aside><p>{b16}.</p><p><a href="/">{b7}</a></p></aside><h2>{m4}</h2><p>{m6}.</p><figure><figcaption>{m8}.</figcaption></figure><div class="share"><a href="/">{b1}</a> <a href="/">{b1}</a></div><div class="ad">{b11}.</div><p>{m33}.</p><section class="comments"><h2>{b2}</h2><article><p>{b40}.</p></article><article><p>{b7}.</p></article></section></article>',
    "<p><a href='/'>{b1}</a> | <a href='/'>{b1}</a> | <a href='/'>{b2}</a></p><h1>{m6}</h1><p>{m42}.</p><p>{m64}.</p><p>{m28}.</p><p><a href='/'>{b2}</a> - <a href='/'>{b3}</a></p><p>&copy; {b4}</p>",
    "<div>{b2}</div><div><a href='/'>{b2}</a></div><div><a href='/'>{b1}</a></div><div><p>{m44}.</p><p>{m37}.</p><p>{m11}.</p><p>{m52}.</p></div><div><a href='/'>{b6}</a></div><div><a href='/'>{b5}</a></div><div>&copy; {b5}. {b3}.</div>",
    "<table><tr><td><a href='/'>{b1}</a></td><td><a href='/'>{b1}</a></td></tr></table><table><tr><td><p>{m61}.</p><p>{m20}.</p></td></tr></table><p><a href='/'>{b1}</a></p>",
    '<main><div class="breadcrumbs"><a href="/">{b1}</a> &gt; <a href="/">{b1}</a></div><h1>{m4}</h1><div class="notice">{b14}.</div><p>{m3}:</p><ol><li>{m12}.</li><li>{m2}</li></ol><table><tr><th>{m1}</th><th>{m2}</th></tr><tr><td>{m1}</td><td>{m1}</td></tr></table><pre>{m14}</pre><div class="related"><h3>{b2}</h3><ul><li><a href="/">{b8}</a></li><li>{b9}.</li></ul></div><form action="/"><p>{b10}.</p><input><button>{b1}</button></form><p>{m5}.</p></main><footer>{b20}.</footer>',
    '<div role="banner"><p>{b9}.</p></div><div role="navigation"><p>{b3}</p><p><a href="/">{b1}</a></p></div><div role="main"><h1>{m2}</h1><p>{m15}.</p><p>{m1}.</p><p>{m48}.</p></div><div role="complementary"><p>{b26}.</p></div><div role="contentinfo"><p>{b18}. &copy; {b2}</p></div>',
    '<div class="wrapper"><div class="advert"><p>{b32}.</p></div><div class="entry-content"><p>{m27}.</p><p>{m9}.</p><p>{m2}!</p></div><div class="newsletter"><p>{b21}.</p><form><input></form></div><div class="promo">{b4}</div></div>',
    "<h1>{m5}</h1><div>{m38}.</div><div>{m47}.</div><ul><li><a href='/'>{b4}</a></li><li><a href='/'>{b3}</a></li><li><a href='/'>{b5}</a></li></ul>",
    '<aside class="sidebar"><p>{b35}.</p><p>{b6}.</p></aside><article><p>{m10}.</p><p>{m3}</p><p><a href="/">{m4}</a></p><p>{m22}.</p></article><div class="ad">{b3}.</div><div class="ad">{b27}.</div><footer><div>{b8}</div><p>{b16}.</p></footer>',
    '<nav><a href="/">{b1}</a></nav><div class="ad">{b5}.</div><article><h1>{m4}</h1><p>{m17}.</p><p>{m3}',
    '<nav><a href="/">{b1}</a></nav><article><h1>{m2}</h1><p>{m30}',
    "<article><p>{m2}.</p></article>",
    "<article><h1>{m3}</h1></article><footer>{b4}.</footer>",
    "<main><p>{m5}</p><p>{m8}.</p>",
    "<p>{m26}.</p>",
    "<h1>{m4}</h1><p>{m9}.</p><p>{m31}.</p>",
    "<div>{m4}.</div>",
    "<div><p>{m6}.</p><p>{m2}.</p><p>{m13}</p></div>",
    "<p>{m33}.</p><p>{m41}.</p><p>{m3}.</p>",
    "<ul><li><a href='/'>{b1}</a></li><li><a href='/'>{b2}</a></li></ul><p>{m12}.</p><p>{m7}.</p><p>&copy; {b3}.</p>",
    "<p><a href='/'>{b3}</a></p><p>{m19}.</p><p>{m2}</p><p>{m24}.</p><hr><p>&copy; {b2} {b6}</p>",
    "<header><nav><a href='/'>{b1}</a></nav><p>{b18}.</p></header><section><h2>{m4}</h2><p>{m58}.</p></section><section><h2>{m3}</h2><p>{m31}.</p></section><footer>{b6}</footer>",
]


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of all blocks of LABELLED."""
    dice = random.Random(1)

    def words(m: re.Match) -> str:
        return " ".join(m[1] + "".join(dice.choice("aeionrst") for _ in range(dice.randint(2, 8))) for _ in range(int(m[2])))

    pages = [blocks_of(re.sub(r"\{([mb])(\d+)\}", words, page)) for page in LABELLED]
    return np.concatenate([block_features(p) for p in pages]), np.array([sum(w[0] == "m" for w in b.text.split()) > sum(w[0] == "b" for w in b.text.split()) for p in pages for b in p], int)


@dataclass(frozen=True)
class Tree:
    """A decision tree: at node i, rows with feature[i] <= bound[i] go to left[i], others to right[i]; feature -1 is a leaf of that share."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Of each row, the share of main text in its leaf."""
        node = np.zeros(len(x), int)
        while (inner := self.feature[node] >= 0).any():
            f = self.feature[node]
            lower = x[np.arange(len(x)), f] <= self.bound[node]
            node = np.where(inner, np.where(lower, self.left[node], self.right[node]), node)
        return self.share[node]


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """A tree by the largest drop of Gini impurity; ties go to the first feature and the lowest bound. Leaves hold ``least`` rows."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, left: int) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        best = None
        if left and 0 < nodes[here][4] < 1:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(v))
                cut = (v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least)
                if cut.any():
                    a, b = ones[:-1], ones[-1] - ones[:-1]
                    impurity = a * (n - a) / n + b * (len(v) - n - b) / (len(v) - n)
                    impurity = np.where(cut, impurity, np.inf)
                    i = int(impurity.argmin())
                    if best is None or impurity[i] < best[0] - 1e-12:
                        best = (impurity[i], f, (v[i] + v[i + 1]) / 2)
            share = nodes[here][4]
            if best and best[0] < len(rows) * share * (1 - share) - 1e-9:
                low = x[rows, best[1]] <= best[2]
                nodes[here][:2] = best[1:]
                nodes[here][2] = grow(rows[low], left - 1)
                nodes[here][3] = grow(rows[~low], left - 1)
        return here

    grow(np.arange(len(y)), depth)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


@lru_cache(1)
def block_tree() -> Tree:
    """The tree grown on LABELLED."""
    return grow_tree(*labelled_blocks())


def main_blocks(page: str, tree: Tree) -> list[str]:
    """Texts of the blocks of a page that the tree calls main text."""
    blocks = blocks_of(page)
    return [b.text for b, s in zip(blocks, tree.shares(block_features(blocks)), strict=True) if s >= 0.5] if blocks else []


def _each_text(batches, tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            blocks = [blocks_of(p) if p else [] for p in part.column("html").to_pylist()]
            shares = tree.shares(np.concatenate([block_features(b) for b in blocks])) >= 0.5
            texts, done = [], 0
            for own in blocks:
                texts.append("\n\n".join(b.text for b, main in zip(own, shares[done : done + len(own)], strict=True) if main))
                done += len(own)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        batch = part = blocks = None
    release()


def extract_pages(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of ``pages`` (page_id, url, html).

    Blocks are joined in page order by an empty line; character references are
    decoded and white space of any kind inside a block is one space. A null or
    empty page, or one without a main block, has the empty text. Repeated rows
    give repeated results, rows with a null id or url keep it, further columns
    are not looked at and an empty table gives an empty one. A page is held
    whole by a task, with a few times its size for its blocks.
    """
    bounded_batches(pages.sparkSession)
    tree = tree or block_tree()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = StructType([rows.schema["page_id"], rows.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])
    return rows.mapInArrow(lambda batches: _each_text(batches, tree), out)

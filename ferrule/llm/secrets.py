"""Secret scans with DataFrame functions only.

Known shapes are found by pattern. Unknown ones by entropy: over every candidate
string (a long run of key characters) a window slides one character at a time;
the counts of its characters are kept by adding the one that enters and taking
away the one that leaves, and the sum of c*log2(c), hence Shannon's entropy, is
updated from these two changes alone. Each character class has its own alphabet,
window and threshold. An allow-list suppresses candidates that only look random
(words, numbers, identifiers of known form, paths) and, in any candidate, what
stands close to a placeholder. All of it is linear in a text's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text


def _either(word: str) -> str:
    """The word in either case, ASCII letters only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns.
ASSIGN = f"({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

#: Classes of candidate characters: name, alphabet, window, least bits.
CLASSES = (
    ("hexadecimal", "0123456789abcdefABCDEF", 20, 3.3),
    ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-=", 20, 3.95),
)
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are no secrets: no digit at all or no letter at all, a UUID, a path of several words.
ALLOW = (
    "^[^0-9]*$",
    "^[^A-Za-z]*$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^/?[a-z]{2,}(?:/[a-z0-9_-]{2,})+/?$",
)
#: Placeholders, and how many characters of a candidate on either side of one are not looked at.
PLACEHOLDER, REACH = "(?i)example|placeholder|changeme|dummy|0123456789|abcdefghij|xxxxx", 40
#: Matches whose positions are summed at a time.
_BLOCK = 256


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str, empty: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, so it is evaluated once. ``empty`` has the type of the body."""
    return f"aggregate(array({value}), {empty}, (_{name}, {name}) -> {body})"


_NO_SPANS = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)"


def _alternating(text: str, pattern: str, group: int = 0) -> str:
    """SQL: array of the pieces between matches, each with the match after it (null after the last) and one of its groups."""
    p = _lit(pattern)
    return f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"


def _starts(xs: str) -> str:
    """SQL: where the match of every element of _alternating() begins, running sums made in blocks."""
    block = f"""transform(sequence(0, (size({xs}) - 1) div {_BLOCK}), b -> aggregate(slice({xs}, b * {_BLOCK} + 1, {_BLOCK}), named_struct('at', 0L, 'out', cast(array() as array<bigint>)),
      (a, x) -> named_struct('at', a.at + length(x.`0`) + coalesce(length(x.`1`), 0), 'out', concat(a.out, array(a.at + length(x.`0`))))))"""
    return f"""aggregate({block}, named_struct('at', 0L, 'out', cast(array() as array<array<bigint>>)),
      (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(transform(x.out, o -> o + a.at)))), a -> flatten(a.out))"""


def _matches(pattern: str, kind: int, keep: str, value_group: int = 0) -> str:
    """SQL: array<struct<start, kind, end, value>> of kept leftmost matches, code points."""
    found = f"""filter(transform(xs, (x, i) -> named_struct('start', at[i], 'kind', {kind}, 'end', at[i] + length(x.`1`), 'value', x.`2`)), m -> m.value is not null and {keep})"""
    placed = _let("xs", _alternating("text", pattern, value_group), _let("at", _starts("xs"), found, _NO_SPANS), _NO_SPANS)
    return f"if(regexp_like(text, {_lit(pattern)}), {placed}, {_NO_SPANS})"


def _entropy_run(value: str, alphabet: str, window: int, least: float) -> str:
    """SQL: struct<first, last> of the windows (their last characters, from 1; 0 if none) in one string whose entropy is at least ``least``.

    H = log2(w) - sum(c*log2 c)/w, so the test is sum(c*log2 c) <= w*(log2 w - least).
    Entry 1 of the counts stands for no character; the two that change are replaced.
    """
    most = window * (math.log2(window) - least) + 1e-9
    f = "array(" + ",".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 2)) + ")"
    size = len(alphabet) + 1
    enters, leaves = "codes[i - 1]", f"if(i > {window}, codes[i - {window + 1}], 1)"
    count = lambda k: f"a.n[{k} - 1]"
    changed = lambda k: f"({count(k)} + if({k} = {enters}, 1, -1))"
    low, high = f"least({enters}, {leaves})", f"greatest({enters}, {leaves})"
    counts = f"concat(slice(a.n, 1, {low} - 1), array({changed(low)}), slice(a.n, {low} + 1, {high} - {low} - 1), array({changed(high)}), slice(a.n, {high} + 1, {size} - {high}))"
    total = f"a.s + {f}[{count(enters)} + 1] - {f}[{count(enters)}] + if(i > {window}, {f}[greatest({count(leaves)} - 1, 0)] - {f}[greatest({count(leaves)}, 0)], 0D)"
    hot = lambda s: f"i >= {window} and {s} <= {most!r}D"
    state = lambda n, s: f"named_struct('n', {n}, 's', {s}, 'first', if(a.first = 0 and {hot(s)}, i, a.first), 'last', if({hot(s)}, i, a.last))"
    return f"""aggregate(array(transform(split({value}, ''), c -> instr('{alphabet}', c) + 1)), named_struct('first', 0, 'last', 0), (_c, codes) ->
      aggregate(sequence(1, size(codes)), named_struct('n', array_repeat(0, {size}), 's', 0D, 'first', 0, 'last', 0), (a, i) ->
        if({enters} = {leaves}, {state("a.n", "a.s")}, aggregate(array({total}), a, (_s, s) -> {state(counts, "s")})),
        a -> named_struct('first', a.first, 'last', a.last)))"""


def _entropy() -> str:
    """SQL: the spans of high entropy, base spans not yet cut out."""
    allowed = " or ".join(f"regexp_like(m.value, {_lit(p)})" for p in ALLOW)
    window = CLASSES[0][2]
    pieces = f"""if(regexp_like(m.value, {_lit(PLACEHOLDER)}), {_let("ys", _alternating("m.value", PLACEHOLDER), _let("zs", _starts("ys"),
      f"transform(ys, (y, i) -> named_struct('at', zs[i] - length(y.`0`) + if(i = 0, 0, {REACH}), 'value', substr(y.`0`, if(i = 0, 1, {REACH + 1}), greatest(0, length(y.`0`) - if(i = 0, 0, {REACH}) - if(i = size(ys) - 1, 0, {REACH})))))", _NO_PIECES), _NO_PIECES)},
      array(named_struct('at', 0L, 'value', m.value)))"""
    letters = lambda a: f"^[{a.replace('-', '')}{'-' if '-' in a else ''}]+$"
    run = "case " + " ".join(f"when regexp_like(m.value, {_lit(letters(a))}) then {_entropy_run('p.value', a, w, least)}" for _, a, w, least in CLASSES) + " end"
    hot = f"filter(transform(filter({pieces}, p -> length(p.value) >= {window}), p -> named_struct('p', p, 'r', {run})), x -> x.r.last > 0)"
    spans = f"transform({hot}, x -> named_struct('start', m.start + x.p.at + x.r.first - {window}, 'kind', 3, 'end', m.start + x.p.at + x.r.last, 'value', substr(x.p.value, x.r.first - {window - 1}, x.r.last - x.r.first + {window})))"
    return f"flatten(transform({_matches(CANDIDATE, 3, f'not ({allowed})')}, m -> {spans}))"


_NO_PIECES = "cast(array() as array<struct<at:bigint,value:string>>)"


def _uncovered(span: str, base: str) -> str:
    """SQL: what of ``span`` no span of ``base`` (sorted) covers."""
    part = lambda a, z: f"named_struct('start', {a}, 'kind', 3, 'end', {z}, 'value', substr({span}.value, cast({a} - {span}.start + 1 as int), cast({z} - {a} as int)))"
    near = f"filter({base}, b -> b.start < {span}.end and {span}.start < b.end)"
    return f"""aggregate({near}, named_struct('at', {span}.start, 'out', {_NO_SPANS}), (a, b) ->
      named_struct('at', greatest(a.at, b.end), 'out', if(b.start > a.at, concat(a.out, array({part("a.at", "b.start")})), a.out)),
      a -> if(a.at < {span}.end, concat(a.out, array({part("a.at", f"{span}.end")})), a.out))"""


def scan_secrets(docs: DataFrame, column: str = "secret_spans") -> DataFrame:
    """Every row of ``docs`` (all its columns) with ``column`` added or replaced.

    It is array<struct<start, kind, end, value>> by start, then kind;
    positions are code points, end exclusive, kind indexes KINDS, value is the
    matched text (for assign the assigned value). Base spans always stay; what of
    an entropy span lies outside all of them stays too, in one or more spans.
    Null and empty texts have no spans. No shuffle.
    """
    base = f"""array_sort(concat({_matches(ASSIGN, 0, "length(m.value) >= 6", 2)},
      {_matches(ACCESS, 1, "m.end - m.start >= 20")},
      {_matches("[0-9a-f]{24,}", 2, "true")}))"""
    every = f"array_sort(concat(base, flatten(transform({_entropy()}, e -> {_uncovered('e', 'base')}))))"
    spans = _let("text", "coalesce(text, '')", _let("base", base, every, _NO_SPANS), _NO_SPANS)
    return docs.withColumn(column, F.expr(spans))


def spans_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mask: str = "<SECRET>", column: str = "secret_spans") -> DataFrame:
    """The rows of scan_secrets with every span of text, overlapping or touching ones merged, replaced by ``mask``.

    The spans' column goes; text stays null where it was null.
    """
    # of spans in order, how far those before reach; one that begins beyond ends a gap
    steps = f"""aggregate(`{column}`, named_struct('at', 0L, 'out', cast(array() as array<struct<from:bigint,to:bigint>>)), (a, s) -> named_struct('at', greatest(a.at, s.end), 'out',
      if(s.start > a.at or size(a.out) = 0, concat(a.out, array(named_struct('from', a.at, 'to', s.start))), a.out)))"""
    text = f"""if(size(`{column}`) = 0, text, aggregate(array({steps}), '', (_z, g) ->
      concat(array_join(transform(g.out, x -> concat(substr(text, cast(x.from + 1 as int), cast(x.to - x.from as int)), {_lit(mask)})), ''), substr(text, cast(g.at + 1 as int)))))"""
    return scanned.withColumn("text", F.expr(text)).drop(column)


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, secret_spans) for every row."""
    return scan_secrets(id_and_text(docs)).select("doc_id", "secret_spans")

"""Canonical exact digests with DataFrame functions only.

A text's canonical form is: canonical composition (Unicode NFC), lower case, and
every run of white space folded to one space with none at the ends. Case is
folded by lower case alone: sharp s and ss, or the two lower-case sigmas, stay
different. Its digest is two chained XXH64 values, 128 bits. Digests only bucket: texts count as copies
if their canonical bytes are equal inside a bucket.

Spark has no normalisation function, so composition is built from strings that
are derived from Python's Unicode data when the plan is made. Nearly all texts
need none of it (no character in them can change), which one pattern tells. The
rest are cut in clusters that can't join each other, and only those holding such
a character are worked on: characters are taken apart by translation, marks are
sorted by class, and pairs are looked up in one string. All of it is linear.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, id_and_text

#: Hangul is arithmetic, so it is in no table: first consonants, vowels, last consonants, syllables.
_L, _V, _T, _S = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3), range(0xAC00, 0xD7A4)
#: Most shared digests that are sent to every task (32 characters each).
MOST_BROADCAST = 200_000
#: White space of any script that is folded.
SPACE = "[\\t-\\r\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


class Tables(NamedTuple):
    #: Full decompositions (Hangul apart), pairs that are joined, combining classes.
    parts: dict[str, str]
    pairs: dict[str, str]
    classes: dict[str, int]
    #: Characters that begin with a mark, marks of class zero that may join the character before, and those they join.
    marks: set[str]
    seconds: set[str]
    firsts: set[str]
    #: Characters that never stay as they are.
    unstable: set[str]


@cache
def tables() -> Tables:
    parts, pairs, classes = {}, {}, {}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if k := unicodedata.combining(c):
            classes[c] = k
        d = unicodedata.decomposition(c)
        if d and d[0] != "<":
            parts[c] = unicodedata.normalize("NFD", c)
            to = "".join(chr(int(x, 16)) for x in d.split())
            if len(to) == 2 and unicodedata.normalize("NFC", to) == c:
                pairs[to] = c
    marks = set(classes) | {c for c, to in parts.items() if to[0] in classes}
    seconds = {to[1] for to in pairs if to[1] not in marks} | set(map(chr, [*_V, *_T]))
    firsts = {to[0] for to in pairs if to[1] in seconds} | set(map(chr, [*_L, *_S]))
    return Tables(parts, pairs, classes, marks, seconds, firsts, {c for c in parts if unicodedata.normalize("NFC", c) != c})


def _q(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04X}" if ord(c) < 0x10000 else f"\\U{ord(c):08X}" for c in s) + "'"


def _class(chars) -> str:
    """A Java character class of these characters."""
    found: list[list[int]] = []
    for i in sorted(map(ord, chars)):
        if found and found[-1][1] == i - 1:
            found[-1][1] = i
        else:
            found.append([i, i])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in found) + "]"


def canonical_sql(text: str) -> str:
    """SQL of a text's canonical form; a null is an empty text."""
    t = tables()
    # below U+0300 nothing changes, so the long class is only tried on characters from there up
    pattern = ("(?![\\x00-\\x{2FF}])" + _class(t.marks | t.seconds | t.unstable)).replace("\\", "\\\\")
    composed = f"aggregate(array(coalesce({text}, '')), '', (z, x) -> if(regexp_like(x, '{pattern}'), {_compose_sql(pattern)}, x))"
    space = SPACE.replace("\\", "\\\\")
    return f"trim(' ', regexp_replace(lower({composed}), '{space}', ' '))"


def canonical(text: str = "text") -> Column:
    """The canonical form of a column of texts: its first step equals Unicode's NFC. A null is an empty text."""
    return F.expr(canonical_sql(text))


@cache
def _compose_sql(pattern: str) -> str:
    """SQL over x: the NFC form of a text that holds a changing character.

    A cluster is a character and its marks; between them may stand up to two
    others that join it (Hangul has two). In a cluster a mark joins the first
    character unless one of the same or a higher class was kept between them.
    At most a few marks join, so only their places are kept.
    """
    t = tables()
    apart = sorted(t.parts, key=lambda c: -len(t.parts[c]))  # the shortest last: what has no such place is deleted
    nth = [_q("".join(t.parts[c][i] for c in apart if len(t.parts[c]) > i)) for i in range(max(map(len, t.parts.values())))]
    whole = _q("".join(apart))
    first = f"translate(c, {whole}, {nth[0]})"
    rest = ", ".join(f"if({first} = c, '', translate(c, {whole}, {to}))" for to in nth[1:])
    letters = f"filter(flatten(transform(split(k, ''), c -> array({first}, {rest}))), c -> c <> '')"
    marks, order = _q("".join(t.classes)), _q("".join(chr(0x4E00 + k) for k in t.classes.values()))
    ordered = f"array_sort(transform({letters}, (c, i) -> named_struct('o', if(translate(c, {marks}, {order}) = c, '', translate(c, {marks}, {order})), 'i', i, 'c', c)))"
    known = _q("".join(f"|{to}{c}" for to, c in t.pairs.items()))
    letter = lambda code: f"decode(unhex(hex({code})), 'UTF-16BE')"
    pair = f"""case when ascii(a.s) between {_L[0]} and {_L[-1]} and ascii(m.c) between {_V[0]} and {_V[-1]} then {letter(f"{_S[0]} + ((ascii(a.s) - {_L[0]}) * {len(_V)} + ascii(m.c) - {_V[0]}) * {len(_T) + 1}")}
      when ascii(a.s) between {_S[0]} and {_S[-1]} and (ascii(a.s) - {_S[0]}) % {len(_T) + 1} = 0 and ascii(m.c) between {_T[0]} and {_T[-1]} then {letter(f"ascii(a.s) + ascii(m.c) - {_T[0] - 1}")}
      when instr({known}, concat('|', a.s, m.c)) > 0 then substr({known}, instr({known}, concat('|', a.s, m.c)) + 3, 1) else '' end"""
    fold = f"""aggregate(slice(w, 2, size(w)), named_struct('s', w[0].c, 'kept', false, 'o', '', 'taken', cast(array() as array<int>)), (a, m) ->
      if(not a.kept or (a.o <> '' and a.o < m.o), aggregate(array({pair}), a, (b, c) -> if(c <> '',
          named_struct('s', c, 'kept', b.kept, 'o', b.o, 'taken', concat(b.taken, array(m.i))), named_struct('s', b.s, 'kept', true, 'o', m.o, 'taken', b.taken))),
        named_struct('s', a.s, 'kept', true, 'o', m.o, 'taken', a.taken)),
      a -> concat(a.s, array_join(transform(filter(slice(w, 2, size(w)), m -> not array_contains(a.taken, m.i)), m -> m.c), '')))"""
    joined = f"aggregate(array({ordered}), '', (z, w) -> if(w[0].o <> '', array_join(transform(w, m -> m.c), ''), {fold}))"
    low = "[\\x00-\\x{2FF}]+(?![^\\x00-\\x{2FF}])"
    cluster = f"{low}|{_class(t.firsts)}{_class(t.seconds)}{{1,2}}{_class(t.marks)}*|(?s:.){_class(t.marks)}*".replace("\\", "\\\\")
    return f"array_join(transform(regexp_extract_all(x, '{cluster}', 0), k -> if(regexp_like(k, '{pattern}'), {joined}, k)), '')"


def digest_sql(text: str) -> str:
    """SQL of 32 hexadecimal digits of two chained XXH64 values of a canonical text."""
    half = lambda h: f"lpad(lower(hex({h})), 16, '0')"
    return f"concat({half(f'xxhash64({text})')}, {half(f'xxhash64(1L, {text})')})"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical, fingerprint) for every row; no shuffle. A null text counts as empty."""
    return id_and_text(docs).select("doc_id", canonical().alias("canonical")).withColumn("fingerprint", F.expr(digest_sql("canonical")))


def digest_classes(prints: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal canonical bytes among rows (doc_id, canonical, fingerprint).

    ``known`` may hold the same fingerprints written before, so they are counted
    without being made again.

    Digests alone are shuffled first. Only rows whose digest occurs more than
    once bring their texts (such digests go to every task if they are few, else
    they are joined by shuffle), and these are grouped by digest and bytes,
    combined before the shuffle, so a group of copies costs one row a task
    however large it is. Returns (fingerprint, class_id, copies) of the digests shared by
    equal texts, and (fingerprint, proof, class_id, copies) of the digests on
    which different texts collide (as good as always empty).
    """
    counts = (known or prints).groupBy("fingerprint").agg(F.count("*").alias("n"))
    shared = cut(counts.where("n > 1").select("fingerprint"))
    if shared.count() <= MOST_BROADCAST:
        shared = F.broadcast(shared)
    classes = prints.join(shared, "fingerprint").groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    compared = cut(classes.select("fingerprint", F.sha2(F.col("canonical").cast("binary"), 512).alias("proof"), "class_id", "copies"))
    clash = compared.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    plain = compared.join(clash, "fingerprint", "left_anti").select("fingerprint", "class_id", "copies")
    return plain, compared.join(clash, "fingerprint", "left_semi")


def with_classes(prints: DataFrame, plain: DataFrame, clashing: DataFrame) -> DataFrame:
    """Rows with fingerprint (and canonical or its proof) plus class_id and copies; a text that has no copy is its own class."""
    own = prints.drop("canonical", "proof").join(plain, "fingerprint", "left")
    if not clashing.isEmpty():
        apart = clashing.select("fingerprint", "proof", F.col("class_id").alias("c"), F.col("copies").alias("k"))
        proved = prints if "proof" in prints.columns else prints.withColumn("proof", F.sha2(F.col("canonical").cast("binary"), 512))
        own = proved.drop("canonical").join(plain, "fingerprint", "left").join(apart, ["fingerprint", "proof"], "left")
        own = own.withColumns({"class_id": F.coalesce("class_id", "c"), "copies": F.coalesce("copies", "k")}).drop("proof", "c", "k")
    return own.withColumns({"class_id": F.coalesce("class_id", "doc_id"), "copies": F.coalesce("copies", F.lit(1).cast("bigint"))})


def copy_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, class_id, copies) for every row.

    class_id is the smallest doc_id with the same canonical bytes. Null and
    empty texts are one class; rows with a null doc_id form classes like any
    other. An empty table stays empty.
    """
    prints = fingerprints(docs)
    return with_classes(prints, *digest_classes(prints)).select("doc_id", "fingerprint", "class_id", "copies")


def _in_order():
    """Rows of a range of ids by id, its guests last; rows of one id by their text's hash."""
    return W.partitionBy("b.b").orderBy("b.guest", "id", "h")


def _in_ranges(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, b, id, h): rows placed in ranges of doc_id cut at quantiles, the first row of the range after it a guest."""
    rows = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 100 * n).alias("q"), F.min("doc_id").alias("low")).first()
    bounds = sorted(set(cuts["q"] or []) | ({cuts["low"]} if cuts["low"] is not None else set()))
    if not bounds:
        bounds = [0]
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::step]
    lit = lambda xs: "array(" + ",".join(f"{x}L" if x != -(1 << 63) else "cast('-9223372036854775808' as bigint)" for x in xs) + ")"
    at = f"aggregate(array(size(filter({lit(coarse)}, b -> b <= id))), 0, (z, c) -> greatest(c - 1, 0) * {step} + size(filter(slice({lit(bounds)}, greatest(c - 1, 0) * {step} + 1, {step}), b -> b <= id)))"
    low = "cast('-9223372036854775808' as bigint)"
    # bucket b holds bounds[b - 1] <= doc_id < bounds[b]; the rows that equal a bound also go, as guests, to the bucket before
    rows = rows.withColumn("id", F.expr(f"coalesce(doc_id, {low})")).withColumn("h", F.xxhash64("text")).withColumn("bucket", F.expr(at))
    last = F.lit(len(bounds))
    firsts = F.col("doc_id").isNotNull() & F.array_contains(F.expr(lit(bounds)), F.col("id"))
    nulls = rows.where("doc_id is null").limit(1).count() > 0
    first_bucket = 0 if nulls else 1
    guest = (F.col("bucket") == first_bucket) & (F.lit(True) if nulls else firsts)
    before = F.when(guest, last).when(firsts, F.col("bucket") - 1)
    placed = rows.withColumn("b", F.explode(F.when(before.isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest")), F.struct(before.alias("b"), F.lit(1).alias("guest"))))))
    return placed.select("doc_id", "text", "b", "id", "h")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by doc_id, the first after the last.

    Rows with one doc_id follow by their text's hash, all in one range. Ranges
    of doc_id are cut at quantiles, each range also gets the first row of the
    range after it, and the next row is then found inside a range: one shuffle,
    no single task. A null doc_id comes first. Null texts are empty.
    """
    found = _in_ranges(docs, buckets).withColumn("next_text", F.lead("text").over(_in_order()))
    return found.where("b.guest = 0").select("doc_id", "text", "next_text")


def edited_prints(docs: DataFrame, share: int = 4) -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next row (see with_next).

    (doc_id, n_chars, edited_sha256, fingerprint, proof, edited_fingerprint,
    near_edited, near_next). The edited text has its last n_chars div ``share``
    code points replaced by the first as many of the next row. Each text and
    each edited text is made canonical once, and of the next row only the
    digest is looked at. An exact digest has likeness 0 or 1. proof is a digest
    of the canonical bytes for telling colliding texts apart.
    """
    edited = f"concat(substr(text, 1, cast(n_chars - n_chars div {share} as int)), substr(next_text, 1, cast(n_chars div {share} as int)))"
    found = _in_ranges(docs).withColumn("next_text", F.lead("text").over(_in_order())).withColumn("n_chars", F.length("text").cast("bigint"))
    texts = found.select("doc_id", "n_chars", "b", "id", "h", F.expr(f"array(text, {edited})").alias("texts"))
    forms = texts.select("doc_id", "n_chars", "b", "id", "h", F.expr("sha2(cast(texts[1] as binary), 256)").alias("edited_sha256"), F.expr(f"transform(texts, t -> {canonical_sql('t')})").alias("forms"))
    digests = forms.select("doc_id", "n_chars", "edited_sha256", "b", "id", "h", F.expr(f"transform(forms, f -> {digest_sql('f')})").alias("digests"), F.expr("sha2(cast(forms[0] as binary), 512)").alias("proof"), F.expr("cast(forms[0] = forms[1] as double)").alias("near_edited"))
    own = digests.withColumn("fingerprint", F.col("digests")[0])
    near = own.withColumn("near_next", (F.col("fingerprint") == F.lead("fingerprint").over(_in_order())).cast("double"))
    return near.where("b.guest = 0").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "proof", F.col("digests")[1].alias("edited_fingerprint"), "near_edited", "near_next")

"""Substring dedup by hashing text units: lines, paragraphs, or the sentences of lines.

A unit is normalised (lower case, white space runs to one space, outer punctuation off) and digested to 128 bits.
Digests are grouped over all documents; the occurrence with the least rank (doc_id, start) stays, every other
occurrence is removed, and its place in the original text (code points) is kept. Sentences are the finest unit, so that
a passage copied into the middle of another line is caught as well. Shorter sentences than ``min_words`` words recur by
chance, so they count only together with what follows them; whole lines and paragraphs are units of any length beside
them. The spans of units overlap and are removed as one. Scripts without spaces have ``CODE_POINTS`` code points a word.

A digest that occurs everywhere costs one row a task in the grouping (partial aggregation) and is a split-able side of
the join that follows.

Defined results: null and empty texts have no units and stay as they are; repeats within one document are removed too;
of rows with the same doc_id and place all stay, as none ranks before another; a null doc_id ranks last.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bounded, durable, fresh, frugal, table

UNITS = {
    "sentence": re.compile(r"[^\n.!?。！？｡]+[.!?。！？｡]*"),
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"[^\n]+(?:\n(?!\n)[^\n]+)*"),
}
MIN_WORDS = 8
#: What counts as a word where a script has no spaces: Thai, Lao, Burmese, Khmer, Japanese, Chinese.
CODE_POINTS = 2
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_EDGE = " .,;:!?\"'()[]{}-。！？｡、，"


def _length(words: list[str]) -> int:
    """Words, or code points by ``CODE_POINTS`` in scripts without spaces."""
    return sum(max(1, len(_UNSPACED.findall(w)) // CODE_POINTS) for w in words)


def _norm(words: list[str]) -> str:
    whole = " ".join(words).lower()
    return whole.strip(_EDGE) or whole


def units_of(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised unit) in order, without the white space around it.

    A sentence, line or paragraph of fewer than ``min_words`` words is taken together with as many of those after it as
    make up that number; so units begin at every one of them, and a passage has the same units wherever it stands.
    Beside sentences every whole line and paragraph is a unit, beside lines every line, whatever its length.
    """
    length = len if text.isascii() or not _UNSPACED.search(text) else _length

    def parts(kind: str) -> Iterator[tuple[int, int, list[str]]]:
        for m in UNITS[kind].finditer(text):
            raw = m.group()
            if words := raw.split():
                yield m.start() + len(raw) - len(raw.lstrip()), m.end() - (len(raw) - len(raw.rstrip())), words

    own = list(parts(unit))
    units = {}
    for i, (a, b, words) in enumerate(own):
        j, n = i + 1, length(words)
        while n < min_words and j < len(own):
            words = words + own[j][2]
            n += length(own[j][2])
            b = own[j][1]
            j += 1
        if n >= min_words:
            units[a, b] = words
    for kind in {"sentence": ("line", "paragraph"), "line": ("line",), "paragraph": ("paragraph",)}[unit]:
        for a, b, words in own if kind == unit else parts(kind):
            units.setdefault((a, b), words)
    ends: dict[str, int] = {}  # a unit inside one of the same words, but for outer punctuation, is no repeat of it
    kept = []
    for (a, b), words in sorted(units.items(), key=lambda u: (u[0][0], -u[0][1])):
        norm = _norm(words)
        if ends.get(norm, -1) < b:
            ends[norm] = b
            kept.append((a, b, norm))
    yield from sorted(kept)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """(k, h, spans array<struct<a,b>>): what is to be removed, in order; k is the key and h the XXH64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, starts, ends, his, los = [], array("i"), array("i"), array("q"), array("q")
            for t in b.column(1).to_pylist():
                before = len(starts)
                for a, e, norm in units_of(t or "", unit, min_words):
                    d = xxhash.xxh3_128_intdigest(norm.encode("utf-8", "surrogatepass"))
                    starts.append(a)
                    ends.append(e)
                    his.append((d >> 64) - (1 << 63))
                    los.append((d & (2**64 - 1)) - (1 << 63))
                counts.append(len(starts) - before)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            cols = [b.column(0).take(row), b.column(2).take(row), *(pa.array(np.asarray(x)) for x in (starts, ends, his, los))]
            yield pa.RecordBatch.from_arrays(cols, ["k", "h", "a", "b", "hi", "lo"])

    units = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).where("t is not null").mapInArrow(frugal(run), "k long, h long, a int, b int, hi long, lo long")
    rank = F.struct(F.col("k").isNull().alias("late"), F.col("k").alias("k"), F.col("a").alias("a"))
    # a table of its own: Spark splits a hot digest's rows only where both sides of the join come straight from a shuffle
    first = durable(units.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "first"), "repeated")
    gone = units.join(first, ["hi", "lo"]).where(~F.col("first").eqNullSafe(rank))
    return gone.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; a line that is removed as a whole takes its line end along."""
    kept, p = [], 0
    for a, b in spans:
        if b <= p:
            continue
        kept.append(text[p : max(a, p)])
        p = b
        if (a == 0 or text[a - 1] == "\n") and text[b : b + 1] == "\n":
            p = b + 1
    return "".join([*kept, text[p:]])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the kept text in ``text`` and the removed spans in ``removed`` (array<struct<a,b>>, original offsets).

    A column ``removed`` that ``docs`` has already gives way.
    """
    docs = docs.drop("removed")
    bounded(docs.sparkSession)
    k_, h_, spans_, kept_ = fresh(docs, "k", "h", "spans", "kept")
    spans = repeats(docs, key, text, unit, min_words).select(F.col("k").alias(k_), F.col("h").alias(h_), F.col("spans").alias(spans_))
    joined = docs.join(spans, docs[key].cast("long").eqNullSafe(F.col(k_)) & (F.xxhash64(docs[text]) == F.col(h_)), "left")

    def run(batches):  # noqa: ANN001, ANN202
        for texts, spans in batches:
            a, b = (x.to_pylist() for x in spans.flatten().flatten())
            out, p = [], 0
            for t, n in zip(texts.to_pylist(), pc.list_value_length(spans).to_pylist(), strict=True):
                out.append(t if t is None or n is None else cut(t, list(zip(a[p : p + n], b[p : p + n], strict=True))))
                p += n or 0
            yield pa.array(out, pa.string())

    @F.arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from frugal(run)(batches)

    # nondeterministic, or a filter on the kept text would be pushed below and evaluate it again, in one more worker a task
    kept = kept.asNondeterministic()
    none = F.array().cast("array<struct<a:int,b:int>>")
    done = joined.withColumn(kept_, kept(F.col(text), spans_))
    return done.select(*[F.col(kept_).alias(c) if c == text else docs[c] for c in docs.columns], F.coalesce(spans_, none).alias("removed"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = F.aggregate("removed", F.lit(0), lambda n, s: n + s["b"] - s["a"])
    return done.select("doc_id", "text", F.size("removed").alias("n_removed"), chars.alias("removed_chars"), F.to_json("removed").alias("removed_spans"))

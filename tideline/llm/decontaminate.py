"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII bytes. The automaton holds every
word sequence of every item. A document's words stream through it; the current state and length are the longest
sequence of item words that ends here. Where that length reaches the window (10 words), or a whole shorter item ends,
the words covered are hit. Stretches of item vocabulary shorter than any window cannot hit and are skipped.

Items go into automata of at most ``SHARD`` bytes of item text each (a checked bound on what is broadcast); with more
than one, documents pass them one after another and the hits add up.

Defined results: null texts have no words; items with null text or without words match nothing; items with a null id
count as hits but are not listed; repeated items count once by id; repeated documents are rows of their own. ``hits``
returns only the columns that ``keep`` names, ``clean`` all columns of the input, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import durable, table

WINDOW = 10
#: Bytes of item text in an automaton: 2 MB make 344,000 states, for which a Python worker takes 256 MB.
SHARD = 2 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPACE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_SPACE).split()


class Automaton:
    """Suffix automaton over the word ids of all items, with the items whose windows end in each state."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.window, self.ids = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        rows = [(k, [self.ids.setdefault(w, len(self.ids)) for w in words_of(d)]) for k, d in items]
        rows = [r for r in rows if r[1]]
        for _, row in rows:
            last = 0
            for w in row:
                last = self._extend(last, w)
        self.ends: dict[int, list[tuple[int, set]]] = {}  # state: (window length, ids of items)
        for k, row in rows:
            s, n = 0, min(window, len(row))
            for p, w in enumerate(row):
                s = self.next[s][w]
                if p + 1 >= n:
                    t = s
                    while self.length[self.link[t]] >= n:
                        t = self.link[t]
                    for m, names in self.ends.setdefault(t, []):
                        if m == n:
                            names.add(k)
                            break
                    else:
                        self.ends[t].append((n, {k}))
        self.least = min((min(window, len(r)) for _, r in rows), default=0)
        # what ends in a state or in one of its suffixes
        self.hits: list[list[tuple[int, set]] | None] = [None] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = (self.hits[self.link[s]] or []) + self.ends.get(s, [])
            self.hits[s] = own or None

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [from, to) of hit words, and the items with windows in them."""
        spans: list[tuple[int, int]] = []
        names: set = set()
        if not self.least or len(words) < self.least:
            return spans, names
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        nxt, link, length, hits = self.next, self.link, self.length, self.hits
        for a, b in known.reshape(-1, 2):
            if b - a < self.least:
                continue
            s = n = 0
            for p, w in enumerate(ids[a:b].tolist(), int(a) + 1):
                t = nxt[s].get(w)
                while t is None and s:
                    s = link[s]
                    n = length[s]
                    t = nxt[s].get(w)
                if t is None:
                    continue
                s, n = t, n + 1
                if hits[s]:
                    longest = 0
                    for m, k in hits[s]:
                        if m <= n:
                            names |= k
                            longest = max(longest, m)
                    if longest:
                        if spans and spans[-1][1] >= p - longest:
                            i = min(spans[-1][0], p - longest)
                            spans[-1] = (i, p)
                        else:
                            spans.append((p - longest, p))
        return spans, names


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(data: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return data
    at = [m.span() for m in _WORD.finditer(data.lower())]
    kept, p = [], 0
    for s in spans:
        kept.append(data[p : at[s["a"]][0]])
        p = at[s["b"] - 1][1]
    return b"".join([*kept, data[p:]])


def hits(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: int = SHARD, cut_text: bool = False) -> DataFrame:
    """``keep`` columns of docs, n_words, spans (of word numbers, merged) and items (ids as strings, sorted).

    With ``cut_text`` also ``cut``: the text without the spans, made in the same pass.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard))
    names = [*keep, "n_words", "spans", "items"]
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL("n_words long, spans array<struct<a:long,b:long>>, items array<string>").fields])
    done = T.StructType([*schema.fields, *([T.StructField("cut", T.StringType())] if cut_text else [])])
    out = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        shared = spark.sparkContext.broadcast([(r.id, bytes(r.text)) for r in part])
        made: list[Automaton] = []

        def run(batches: Iterator[pa.RecordBatch], shared=shared, made=made, last=k == n - 1) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            if not made:
                made.append(Automaton(shared.value, window))
            for b in batches:
                before = [column.to_pylist() for column in (b.column("spans"), b.column("items"))] if "spans" in b.schema.names else [[[]] * b.num_rows] * 2
                counts, spans, found = [], [], []
                for data, s0, i0 in zip(b.column("_text").to_pylist(), *before, strict=True):
                    words = words_of(data) if data else []
                    s, i = made[0].scan(words)
                    counts.append(len(words))
                    spans.append([{"a": x, "b": y} for x, y in _merge([*((z["a"], z["b"]) for z in s0), *s])] if s or s0 else [])
                    found.append(sorted({*i0, *(x for x in i if x is not None)}))
                new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(found, pa.list_(pa.string()))]
                more = {} if last else {"_text": b.column("_text")}
                if last and cut_text:
                    more["cut"] = pa.array([d if d is None else _without(d, s) for d, s in zip(b.column("_text").to_pylist(), spans, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new, *more.values()], [*names, *more])

        out = out.mapInArrow(run, done if k == n - 1 else T.StructType([*schema.fields, T.StructField("_text", T.BinaryType())]))
        if k < n - 1:
            out = durable(out, "hits")
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", max_coverage: float = 0.5, **how) -> DataFrame:  # noqa: ANN003
    """``docs`` without the hit spans; a document whose hit words pass ``max_coverage`` of its words goes as a whole."""
    # under names of their own, as a document's column may have the name of a result
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in named.items()])
    found = hits(rows, items, keep=tuple(n for c, n in named.items() if c != text), text=named[text], cut_text=True, **how)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    kept = found.where(n_hit <= F.col("n_words") * max_coverage)
    return kept.select(*[F.col("cut" if c == text else n).alias(c) for c, n in named.items()])


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

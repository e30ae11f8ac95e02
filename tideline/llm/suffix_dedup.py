"""Exact substring dedup by a column-wise multi-document suffix construction.

A byte is removed if a string of ``WIDTH`` bytes that covers it also starts in a document with a smaller doc_id. All
strings are judged on the input.

Where to look. Every window of WIDTH bytes has a minimiser, the least hash among its GRAM-byte substrings, so equal
windows have equal minimisers. A stretch of windows with one minimiser is a piece. Documents are dealt to groups of
about ``GROUP`` bytes by hash; each group names its minimisers, dealt to buckets; a bucket tells each group which of
them other documents have too. Only the pieces of those can hold repeats, and each group sends every distinct such
piece once, with the least doc_id that has it there, to the piece's bucket. So a passage that a third of all documents
share costs a bucket one piece a group, not one a document.

What repeats. A bucket builds the sorted suffixes of its pieces column by column: all pieces insert one symbol each
round, from their ends to their beginnings. The list of all suffixes of at most j symbols, read in order with the
symbol before each (the Burrows-Wheeler transform of that round), becomes the list for j + 1 by a stable distribution
by that symbol. Each round is one sequential pass, and a bucket takes its pieces in collections of about ``COLLECTION``
bytes that share no minimiser. When the rounds end, neighbours with a common prefix of WIDTH bytes are one string, and
the least doc_id among them goes back to the groups, which mark and cut their texts.

Of copies of a whole text only the one with the least doc_id is looked into; the others lose all they have.

The text moves between executors once, compressed; what the steps send each other are arrays in binary rows.

Defined results: null text is empty; shorter texts lose nothing; a null doc_id ranks after all others; of rows with
equal doc_id neither removes from the other.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import durable, table

WIDTH = 50
GRAM = 32
GROUP = 16 << 20
COLLECTION = 1 << 17
#: Windows of one piece at most: in text that repeats itself all windows can have one minimiser.
MOST = 64
CHUNK = 1 << 20
_LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def minimisers(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The minimiser of every window of a text, as an evenly spread 64-bit hash."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for p in range(0, n, CHUNK):
        h = np.frombuffer(data, np.uint8, min(CHUNK, n - p) + width - 1, p).astype(np.uint64) + np.uint64(1)
        span = 1
        while span < GRAM:  # hashes of 2, 4, ... GRAM bytes
            h = (h[:-span] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[span:] + (h[span:] >> np.uint64(29)))
            span *= 2
        h = _mix(h)
        wide, span = width - GRAM + 1, 1
        while 2 * span <= wide:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < wide:
            h = np.minimum(h[: len(h) - (wide - span)], h[wide - span :])
        out[p : p + len(h)] = h
    return _mix(out * np.uint64(0xD6E8FEB86659FD93))


def _keys(m: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, 32 bits of the hash in the lower."""
    low = np.uint64(0xFFFFFFFF)
    return ((((m >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32)) | (m & low)


def _runs(data: bytes, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, key) of the pieces of a text."""
    m = minimisers(data, width)
    start = np.flatnonzero(np.concatenate((m[:1] == m[:1], m[1:] != m[:-1])))
    size = np.diff(start, append=len(m))
    if len(size) and size.max() > MOST:
        parts = -(-size // MOST)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = np.repeat(start, parts) + at * MOST, np.repeat(start + size, parts)
        size = np.minimum(MOST, end - start)
    return start, size, _keys(m[start], buckets)


def _pack(x: object) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def _unpack(b: bytes):  # noqa: ANN202
    return pickle.loads(zstd.ZstdDecompressor().decompress(b))  # noqa: S301  written by this job


def _texts(t: pa.Table, notes: pa.Table):  # noqa: ANN202
    """(doc_id, text, whether the text is that of a document with a smaller doc_id)."""
    d = zstd.ZstdDecompressor()
    copies = {x for _, x in _notes(notes, 4)}
    ids = {x[:8] for x in copies}
    for k, z in zip(t.column("doc_id").to_pylist(), t.column("z").to_pylist(), strict=True):
        doc, data = (_LAST if k is None else k), d.decompress(z) if z else b""
        name = doc.to_bytes(8, "big", signed=True)
        yield doc, data, name in ids and name + hashlib.sha256(data).digest() in copies


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "g": pa.array([r[1] for r in rows], pa.int32()), "kind": pa.array([r[2] for r in rows], pa.int32()), "blob": pa.array([r[3] for r in rows], pa.binary())})


MESSAGE = "bucket int, g int, kind int, blob binary"


def _name(buckets: int, width: int):  # noqa: ANN202
    """Of a group of documents: its distinct minimisers by bucket, and whether two of its documents have them."""

    def run(t: pa.Table, notes: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([])
        each = [np.unique(_runs(d, buckets, width)[2]) for _, d, copy in _texts(t, notes) if not copy]
        keys, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0))
        cut = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        g = t.column("g")[0].as_py()
        return _rows([(b, g, 0, pickle.dumps((keys[i:j].astype(np.uint32), np.packbits(n[i:j] > 1)))) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i])  # noqa: B905

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Of a bucket: to each group, which of its minimisers more than one document has."""
    groups = t.column("g").to_pylist()
    got = [pickle.loads(b) for b in t.column("blob").to_pylist()]  # noqa: S301  written by this job
    keys = np.concatenate([k for k, _ in got])
    many = np.concatenate([np.unpackbits(m, count=len(k)) for k, m in got]).astype(bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    dup = np.empty(len(s), bool)
    dup[order] = twice
    dup |= many
    b, at, out = t.column("bucket")[0].as_py(), 0, []
    for g, (k, _) in zip(groups, got, strict=True):
        mine = k[dup[at : at + len(k)]]
        at += len(k)
        if len(mine):
            out.append((b, g, 1, pickle.dumps(mine)))
    return _rows(out)


def _notes(t: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return [(b, x) for b, k, x in zip(t.column("bucket").to_pylist(), t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True) if k == kind]


def _suspects(data: bytes, shared: np.ndarray, buckets: int, width: int):  # noqa: ANN202
    """(start, piece, key) of the pieces whose minimiser other documents have."""
    start, size, key = _runs(data, buckets, width)
    if not len(start) or not len(shared):
        return
    at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
    hit = np.flatnonzero(shared[at] == key)
    for s, n, k in zip(start[hit].tolist(), size[hit].tolist(), key[hit].tolist(), strict=True):
        yield s, data[s : s + n + width - 1], k


def _shared_keys(notes: pa.Table) -> np.ndarray:
    parts = [(np.uint64(b) << np.uint64(32)) | pickle.loads(x).astype(np.uint64) for b, x in _notes(notes, 1)]  # noqa: S301  written by this job
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _send(buckets: int, width: int):  # noqa: ANN202
    """Of a group: every distinct suspect piece once, with the least and the greatest doc_id that has it."""

    def run(t: pa.Table, notes: pa.Table) -> pa.Table:
        if not t.num_rows or not notes.num_rows:
            return _rows([])
        shared = _shared_keys(notes)
        held: dict[bytes, list[int]] = {}
        for doc, data, copy in _texts(t, notes):
            for _, piece, key in () if copy else _suspects(data, shared, buckets, width):
                if (x := held.get(piece)) is None:
                    held[piece] = [key, doc, doc]
                else:
                    x[1], x[2] = min(x[1], doc), max(x[2], doc)
        by: dict[int, list[bytes]] = {}
        for piece, (key, _, _) in held.items():
            by.setdefault(key >> 32, []).append(piece)
        g = t.column("g")[0].as_py()
        return _rows([(b, g, 2, _pack((ps, np.array([held[p] for p in ps], np.int64)))) for b, ps in by.items()])

    return run


def columnwise(pieces: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece number, start) of every suffix of at least ``width`` bytes in sorted order, and whether its first ``width`` bytes are those of the one before."""
    size = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    # a suffix is where it starts in the joined text; an empty one is the byte after its piece
    begin = np.cumsum(size + 1) - size - 1
    empty = (begin + size).astype(np.int32)
    before = np.empty(len(text), np.uint8)
    before[1:] = text[:-1]
    grows = np.ones(len(text), bool)
    grows[begin] = False
    at = empty
    for _ in range(int(size.max())):
        at = at[grows[at]]
        at = np.concatenate((empty, at[np.argsort(before[at], kind="stable")] - np.int32(1)))
    whose = np.repeat(np.arange(len(pieces)), size + 1)[at]
    long = empty[whose] - at >= width
    at, whose = at[long].astype(np.int64), whose[long]
    words = np.zeros((len(text) + 8,), np.uint8)
    words[: len(text)] = text
    same = np.zeros(len(at), bool)
    if len(at):
        alike = np.ones(len(at) - 1, bool)
        for k in [*range(0, width - 7, 8), width - 8]:
            w = np.lib.stride_tricks.sliding_window_view(words, 8)[at + k].copy().view(np.uint64).ravel()
            alike &= w[1:] == w[:-1]
        same[1:] = alike
    return whose, at - begin[whose], same


def _find(width: int):  # noqa: ANN202
    """Of a bucket: to each group, the least doc_id that has each window of its pieces."""

    def run(t: pa.Table) -> pa.Table:
        groups = t.column("g").to_pylist()
        number: dict[bytes, int] = {}
        least: list[int] = []
        low: list[int] = []
        sent = []
        for blob in t.column("blob").to_pylist():
            pieces, facts = _unpack(blob)
            no = np.empty(len(pieces), np.int64)
            for i, (p, k, d) in enumerate(zip(pieces, facts[:, 0].tolist(), facts[:, 1].tolist(), strict=True)):
                if (n := number.setdefault(p, len(number))) == len(least):
                    least.append(d)
                    low.append(k)
                elif d < least[n]:
                    least[n] = d
                no[i] = n
            sent.append((no, facts))
        every, least_ = list(number), np.array(least, np.int64)
        size = np.array([len(p) for p in every], np.int64)
        windows = size - width + 1
        base = np.cumsum(windows) - windows
        best = np.repeat(least_, windows)  # of each window of each piece
        # a minimiser with one piece only has nothing to compare
        keys = np.array(low, np.int64)
        _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.argsort(keys, kind="stable")
        order = order[n[inverse[order]] > 1]
        key = keys[order]
        volume = np.cumsum(size[order])
        i = 0
        while i < len(order):  # collections of whole minimisers
            j = max(int(np.searchsorted(volume, (volume[i - 1] if i else 0) + COLLECTION)), i + 1)
            j = int(np.searchsorted(key, key[j - 1], side="right"))
            some = order[i:j]
            i = j
            whose, at, same = columnwise([every[k] for k in some.tolist()], width)
            heads = np.flatnonzero(~same)
            if len(heads) == len(same):
                continue
            place = base[some[whose]] + at
            m = np.minimum.reduceat(best[place], heads)
            best[place] = np.repeat(m, np.diff(heads, append=len(same)))
        b, out = t.column("bucket")[0].as_py(), []
        for g, (no, facts) in zip(groups, sent, strict=True):
            n = windows[no]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            piece = np.repeat(np.arange(len(no)), n)
            d = best[base[no][piece] + at]
            # a window that no document before the greatest here has removes nothing
            use = d < facts[:, 2][piece]
            edge = use & np.concatenate(([True], (piece[1:] != piece[:-1]) | (d[1:] != d[:-1]) | ~use[:-1]))
            last = use & np.concatenate(((piece[1:] != piece[:-1]) | (d[1:] != d[:-1]) | ~use[1:], [True]))
            if edge.any():
                names = [xxhash.xxh3_128_digest(every[no[p]]) for p in piece[edge]]
                out.append((b, g, 3, _pack((names, at[edge].astype(np.uint8), at[last].astype(np.uint8), d[edge]))))
        return _rows(out)

    return run


def _cut(buckets: int, width: int, keep_text: bool):  # noqa: ANN202
    """Of a group: what is removed of each document."""

    def run(t: pa.Table, notes: pa.Table) -> pa.Table:
        shared = _shared_keys(notes)
        found: dict[bytes, list[tuple[int, int, int]]] = {}
        for _, blob in _notes(notes, 3):
            names, a, b, d = _unpack(blob)
            for x, *y in zip(names, a.tolist(), b.tolist(), d.tolist(), strict=True):
                found.setdefault(x, []).append(tuple(y))
        out: list[tuple] = []
        for doc, data, copy in _texts(t, notes):
            spans: list[list[int]] = [[0, len(data)]] if copy and len(data) >= width else []
            for s, piece, _ in _suspects(data, shared, buckets, width) if found and not copy else ():
                for a, b, d in found.get(xxhash.xxh3_128_digest(piece), ()):
                    if d < doc:
                        if spans and s + a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], s + b + width)
                        else:
                            spans.append([s + a, s + b + width])
            kept, p = [], 0
            for a, b in spans:
                kept.append(data[p:a])
                p = b
            left = b"".join([*kept, data[p:]])
            out.append((None if doc == _LAST else doc, len(data), len(data) - len(left), [{"a": a, "b": b} for a, b in spans], hashlib.sha256(left).hexdigest(), left if keep_text else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, group: int = GROUP, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept): byte spans to remove and the bytes that stay."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // group))

    def squeeze(batches):  # noqa: ANN001, ANN202
        c = zstd.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.compress(x) for x in b.column(2).to_pylist()], pa.binary())], ["g", "doc_id", "z"])

    placed = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    # copies of whole texts: only the first of them is looked into
    small = placed.select("g", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.sha2("text", 256).alias("sha"))
    # a table of its own: Spark splits a hot text's rows only where both sides of the join come straight from a shuffle
    first = durable(small.groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    name = F.concat(F.unhex(F.lpad(F.hex("doc"), 16, "0")), F.unhex("sha"))
    copies = small.join(first, "sha").where("doc > first").select(F.lit(0).alias("bucket"), "g", F.lit(4).alias("kind"), name.alias("blob"))
    dealt = placed.select("g", "doc_id", "text").mapInArrow(squeeze, "g int, doc_id long, z binary").repartition(n, "g")
    named = dealt.groupBy("g").cogroup(copies.groupBy("g")).applyInArrow(_name(n, width), MESSAGE)
    shared = named.groupBy("bucket").applyInArrow(_shared, MESSAGE).unionByName(copies)
    sent = dealt.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_send(n, width), MESSAGE)
    found = sent.groupBy("bucket").applyInArrow(_find(width), MESSAGE)
    cut = dealt.groupBy("g").cogroup(shared.unionByName(found).groupBy("g"))
    return cut.applyInArrow(_cut(n, width, keep_text), "doc_id long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept_sha256 string, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    done = dedup(table(spark, sf_dir, "documents"), keep_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

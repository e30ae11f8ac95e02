"""Token-id files: adaptive context-mixing range coder over independently reset, checksummed blocks.

Ids of documents in ascending doc_id order are cut into segments at document ends and a segment into blocks of
``BLOCK`` ids. A segment's header holds its documents, their lengths, and the shares that its ids have in ``CLASSES``
classes of about equal mass; the header and every block have their own CRC-32. Every block starts from the header
alone and can be decoded without the others.

Model of one id: an order-2 table names the id that last followed the hash of the two ids before, an order-1 table the
one that followed the last id, each with a confidence; order 0 gives every class the share it had so far in the block
(made anew after every ``RENEW`` ids) and an id its share of the class. A block learns how often each confidence was
right, and these rates mix the three: the rate of order 2, the rate of order 1 in what is left, and order 0 in the
rest. One range-coding step codes one id.

All blocks of a segment are coded abreast in numpy, one id of each per step, so Python's cost is shared by some
thousand blocks. Files are Parquet tables with a binary column in the given folder, written and committed by Spark.

Defined results: null and empty texts are the end id alone; rows with equal doc_id follow each other by text; a null
doc_id comes first; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import durable, gathered, table
from tideline.llm.tokens import encoder

BLOCK = 4096
SEGMENT = 8 << 20
PART = 24 << 20
END = 2
MAGIC = b"TIDE4"
CLASSES = 32
RENEW = 64
_SLOTS = 10  # bits of a table's size
_FACTORS = np.uint32(2654435761), np.uint32(40503)
_LAST_SLOT = np.uint32((1 << _SLOTS) - 1)
_STEPS = 8  # that are looked up together when writing
_U = np.uint64
_LEAST = _U(1 << 44)  # of a range


def _slots(before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of order 2 and 1 in a table, of ranks as unsigned 32 bits."""
    last = last * _FACTORS[1]
    return (before * _FACTORS[0] + last) >> 7 & _LAST_SLOT, last >> 4 & _LAST_SLOT


def _turned(rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``out`` as the transpose of ``rows``, some at a time that stay in the cache."""
    for p in range(0, len(rows), 64):
        for q in range(0, len(out), 64):
            out[q : q + 64, p : p + 64] = rows[p : p + 64, q : q + 64].T
    return out


class _Model:
    """State of all blocks of a segment, one lane each; pairs of rows are order 2 and order 1. Ids are their ranks among the
    distinct ids of the segment, of type ``kind``, in which a rank and 2 bits more have room."""

    def __init__(self, lanes: int, kind: type) -> None:
        self.base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes)
        self.tables = np.zeros(2 * lanes << _SLOTS, kind)  # id and 2 bits of confidence
        self.rate = np.full(lanes * 8, 1 << 14, np.int32)  # how often each confidence of either order is right, of 65536
        self.lane = np.arange(lanes, dtype=np.int64) * 8 + np.array([[0], [4]])
        self.count = np.full((CLASSES, lanes), 2, np.int32)  # of each class, in quarters of an id
        self.which = np.arange(lanes, dtype=np.int64)
        self.shares(None)

    def shares(self, places: np.ndarray | None) -> None:
        """Shares of the classes, of 1024, and what is below each, after the ids of which class and lane are ``places``."""
        lanes = len(self.which)
        if places is not None:
            self.count += 4 * np.bincount(places.ravel(), minlength=CLASSES * lanes).astype(np.int32).reshape(CLASSES, lanes)
        share = 1 + (self.count * ((1024 - CLASSES) / self.count.sum(0))).astype(np.int16)
        self.below = np.zeros((CLASSES + 1, lanes), np.int16)
        np.cumsum(share, axis=0, dtype=np.int16, out=self.below[1:])
        self.below[CLASSES] = 1024  # the last class has what is left over
        self.flat = np.diff(self.below, axis=0).astype(np.int32)
        self.flat <<= 16
        self.flat |= self.below[:-1]
        self.flat = self.flat.ravel()

    def look(self, at: np.ndarray) -> np.ndarray:
        """Ids of order 2 and 1, whose rates go to ``q``; ``at``: their places in the tables."""
        self.at, self.e = at, self.tables.take(at)
        self.c = self.e & 3
        self.r = self.lane + self.c
        self.q = self.rate.take(self.r)
        return self.e >> 2

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """hit: whether order 2 and 1 are right, whatever the other is."""
        move = hit.astype(np.int32) << 16
        move -= self.q
        move >>= 5
        move[1] *= ~hit[0]
        move += self.q
        self.rate[self.r] = move
        # a wrong prediction loses its confidence first and its place then
        sure = hit.astype(ids.dtype) * 3
        sure += self.c
        sure -= 2
        sure = np.minimum(np.maximum(sure, 0), 3)
        ids = ids << 2
        self.tables[self.at] = (ids ^ ((ids ^ self.e) & -(self.c >> 1) & -4)) + sure


def _shares(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of 1024 of order 2 and 1 by their rates, rows of which are pairs; at least 15 are left."""
    a = q[..., 0, :] * 1006 >> 16
    b = (1007 - a) * (q[..., 1, :] >> 2) >> 14
    a += 1
    b += 1
    return a, b


def _interval(a: np.ndarray, b: np.ndarray, ab: np.ndarray, k: np.ndarray, two: np.ndarray, part: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of 2 ** 36 and what is below them. ab: a and b as 64 bits; k: which ids are predicted; two: whether by order 2;
    ``part`` and ``below``: the same of 2 ** 26 in order 0. All are flat."""
    rest = (1 << 10) - ab
    part *= rest
    below *= rest
    below += ab << 26
    a = a.take(k)
    part[k] = np.where(two, a, b.take(k)).astype(np.int64) << 26
    below[k] = np.where(two, 0, a).astype(np.int64) << 26
    return part.view(_U), below.view(_U)


def _kind(prior: tuple[np.ndarray, np.ndarray]) -> type:
    return np.int16 if len(prior[0]) <= 1 << 13 else np.int32


def _mapped(by: np.ndarray, places: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``by.take(places)`` in the first places of ``out``, some at a time."""
    for k in range(0, len(places), 1 << 18):
        some = places[k : k + (1 << 18)]
        out[k : k + len(some)] = by.take(some)
    return out


def _prior(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their shares of 65536, at least 1 each."""
    n = sum(np.bincount(ids[k : k + (1 << 20)], minlength=int(ids.max()) + 1) for k in range(0, len(ids), 1 << 20))
    names = np.flatnonzero(n)
    n = n[names]
    share = 1 + (n * (65536 - len(names)) // n.sum())
    share[n.argmax()] += 65536 - share.sum()
    return names, share


def _classes(prior: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct id: its class, its share of 65536 there, and what is below it there."""
    _, share = prior
    order = np.argsort(-share, kind="stable")
    begin = np.cumsum(share[order]) - share[order]
    cls = np.empty(len(share), np.int64)
    cls[order] = begin * CLASSES >> 16
    order = np.lexsort((np.arange(len(share)), cls))
    c, s = cls[order], share[order]
    first = np.flatnonzero(np.diff(c, prepend=-1))
    size = np.diff(first, append=len(c))
    mass = np.repeat(np.add.reduceat(s, first), size)
    mine = 1 + s * (65536 - np.repeat(size, size)) // mass
    mine[first] += 65536 - np.add.reduceat(mine, first)
    below = np.cumsum(mine) - mine
    below -= np.repeat(below[first], size)
    out = np.empty((3, len(share)), np.int64)
    out[:, order] = c, mine, below
    return out[0], out[1], out[2]


def _facts(prior: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each distinct id: 20 bits of its share of 65536 in its class, 20 of what is below it there, its class."""
    cls, share, begin = _classes(prior)
    return share | begin << 20 | cls << 40


def encode_blocks(ids: np.ndarray, prior: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    names, facts, kind = prior[0], _facts(prior), _kind(prior)
    rank = np.zeros(names[-1] + 1, kind)
    rank[names] = np.arange(len(names))
    lanes = -(-len(ids) // BLOCK)
    rows = _mapped(rank, ids, np.zeros(lanes * BLOCK, kind))
    rows = _turned(rows.reshape(lanes, BLOCK), np.empty((BLOCK, lanes), kind))
    model, low, wide = _Model(lanes, kind), np.zeros(lanes, _U), np.full(lanes, 1 << 60, _U)
    out, to = np.zeros((2 * BLOCK + 8) * lanes, np.uint16), np.arange(lanes, dtype=np.int64)  # the first word of each lane, the second, ...

    def put(k: np.ndarray) -> None:
        """The upper 16 of 60 bits of lanes k; a carry goes into what is out already."""
        now, p = low.take(k), to.take(k)
        over = p[now >= _U(1 << 60)] - lanes
        while len(over):
            out[over] += 1
            over = over[out[over] == 0] - lanes
        out[p] = (now >> _U(44)).astype(np.uint16)
        to[k] = p + lanes
        low[k] = (now & _U((1 << 44) - 1)) << _U(16)

    last = np.zeros((2, lanes), np.uint32)
    place = np.empty((RENEW, lanes), np.int64)
    hit, rates = np.empty((_STEPS, 2, lanes), bool), np.empty((_STEPS, 2, lanes), np.int32)
    for p in range(0, BLOCK, _STEPS):
        some = rows[p : p + _STEPS]
        fact = facts.take(some)
        places = place[p % RENEW : p % RENEW + _STEPS]
        np.add((fact >> 40) * lanes, model.which, out=places)
        past = np.concatenate([last, some.astype(np.uint32)])
        at = np.stack(_slots(past[:-2], past[1:-1]), 1) * np.int64(2 * lanes) + model.base
        last = past[-2:]
        for i, now in enumerate(some):
            np.equal(model.look(at[i]), now, out=hit[i])
            rates[i] = model.q
            model.learn(now, hit[i])
        of = model.flat.take(places.ravel()).astype(np.int64)
        size, fact = of >> 16, fact.ravel()
        k = (hit[:, 0] | hit[:, 1]).ravel().nonzero()[0]
        a, b = (x.ravel() for x in _shares(rates))
        part, below = _interval(a, b, (a + b).astype(np.int64), k, hit[:, 0].ravel().take(k), size * (fact & 0xFFFFF), ((of & 0xFFFF) << 16) + size * (fact >> 20 & 0xFFFFF))
        for mine, under in zip(part.reshape(-1, lanes), below.reshape(-1, lanes), strict=True):
            step = wide >> _U(36)
            low += step * under
            wide = step * mine
            k = (wide < _LEAST).nonzero()[0]
            while len(k):
                put(k)
                left = wide.take(k) << _U(16)
                wide[k] = left
                k = k[left < _LEAST]
        if (p + _STEPS) % RENEW == 0:
            model.shares(place)
    for _ in range(4):
        put(np.arange(lanes))
    used = to // lanes
    words = out[: used.max() * lanes].reshape(-1, lanes)
    words = _turned(words, np.empty(words.shape[::-1], "<u2"))
    return [w[:n].tobytes() for w, n in zip(words, used.tolist(), strict=True)]


def decode_blocks(blocks: list[bytes], n: int, prior: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    names, facts, kind = prior[0], _facts(prior), _kind(prior)
    class_of, share = facts >> 40, facts & 0xFFFFF
    order = np.argsort(facts >> 20)  # by class and what is below
    held = np.bincount(class_of, minlength=CLASSES)
    table_ = np.zeros((CLASSES, 65536), kind)  # which distinct id has each place of each class
    table_[held > 0] = np.repeat(order, share[order]).reshape(-1, 65536)
    table_ = table_.ravel()
    facts &= (1 << 40) - 1
    lanes = len(blocks)
    # the first word holds the upper 16 of 60 bits, so that words are needed 4 bits late
    words = np.zeros((lanes, max(len(b) for b in blocks) // 2 + 8), np.uint16)
    for k, b in enumerate(blocks):
        words[k, : len(b) // 2] = np.frombuffer(b, "<u2")
    late = words >> 4
    late[:, 1:] |= words[:, :-1] << 12
    at = np.arange(lanes, dtype=np.int64) * words.shape[1] + 4
    words = late.ravel()
    x = np.zeros(lanes, _U)
    for k in range(4):
        x = (x << _U(16)) | words[at - 4 + k]
    model, wide = _Model(lanes, kind), np.full(lanes, 1 << 60, _U)
    rows = np.empty((BLOCK, lanes), kind)
    slots = np.empty((2, lanes), np.int64)
    hit, above = np.empty((2, lanes), bool), np.empty((CLASSES - 1, lanes), bool)
    before = last = np.zeros(lanes, np.uint32)
    for p, row in enumerate(rows):
        slots[0], slots[1] = _slots(before, last)
        guess = model.look(slots * (2 * lanes) + model.base)
        a, b = _shares(model.q)
        ab = (a + b).astype(np.int64)
        step = wide >> _U(36)
        v = np.minimum(x // step, _U((1 << 36) - 1)).view(np.int64)
        past = ab << 26
        k = (v < past).nonzero()[0]
        two = v.take(k) < a.take(k).astype(np.int64) << 26
        # quotients of numbers below 2 ** 36, which floats give exactly
        u = (np.maximum(v - past, 0) / ((1 << 10) - ab)).astype(np.int64)  # of 1024 * 65536
        np.less_equal(model.below[1:CLASSES], (u >> 16).astype(np.int16), out=above)
        c = np.add.reduce(above.view(np.int8), 0, np.int8).astype(np.int64)
        of = model.flat.take(c * lanes + model.which).astype(np.int64)
        under, size = (of & 0xFFFF) << 16, of >> 16
        inside = np.minimum(((u - under) / size).astype(np.int64), 65535)
        row[:] = table_.take((c << 16) + inside)
        fact = facts.take(row)
        row[k] = np.where(two, guess[0].take(k), guess[1].take(k))
        part, below = _interval(a, b, ab, k, two, size * (fact & 0xFFFFF), under + size * (fact >> 20))
        x -= step * below
        wide = step * part
        one = (wide < _LEAST).astype(_U)
        x <<= one << _U(4)
        x |= words.take(at, mode="clip").astype(_U) * one  # a damaged block can run on
        at += one.view(np.int64)
        wide <<= one << _U(4)
        k = (wide < _LEAST).nonzero()[0]
        for _ in range(2):
            if not len(k):
                break
            now = at.take(k)
            x[k] = (x.take(k) << _U(16)) | words.take(now, mode="clip")
            at[k] = now + 1
            left = wide.take(k) << _U(16)
            wide[k] = left
            k = k[left < _LEAST]
        np.equal(guess, row, out=hit)
        model.learn(row, hit)
        before, last = last, row.astype(np.uint32)
        if p % RENEW == RENEW - 1:
            model.shares(class_of.take(rows[p + 1 - RENEW : p + 1]) * lanes + model.which)
    rows = _turned(rows, np.empty((lanes, BLOCK), kind)).ravel()[:n]
    return _mapped(names.astype(np.int32), rows, np.empty(len(rows), np.int32))


def write_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    prior = _prior(ids)
    blocks = encode_blocks(ids, prior)
    heads = b"".join(struct.pack("<II", len(b), zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4", copy=False))) for k, b in enumerate(blocks))
    has = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [MAGIC, struct.pack("<QQII", len(doc_ids), len(ids), len(prior[0]), len(blocks)), has, docs, lengths.astype("<u8"), prior[0].astype("<u4"), prior[1].astype("<u4"), heads]
    head = b"".join(bytes(p) for p in parts)
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *blocks])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths, ids; a header or block that fails its checksum raises ValueError."""
    if data[: len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + 28:
        raise ValueError("not a token-id segment")
    p = len(MAGIC)
    n_docs, n, n_names, n_blocks = struct.unpack_from("<QQII", data, p)
    p += 24
    end = p + 17 * n_docs + 8 * n_names + 8 * n_blocks
    if end + 4 > len(data) or struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[:end]):
        raise ValueError("the header fails its checksum")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal p
        a = np.frombuffer(data, kind, count, p)
        p += a.nbytes
        return a

    has, docs, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs).astype(np.int64)
    prior = take("<u4", n_names).astype(np.int64), take("<u4", n_names).astype(np.int64)
    heads = take("<u4", 2 * n_blocks).reshape(-1, 2)
    p += 4
    blocks = []
    for size in heads[:, 0].tolist():
        blocks.append(data[p : p + size])
        p += size
    ids = decode_blocks(blocks, n, prior)
    for k, crc in enumerate(heads[:, 1].tolist()):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4", copy=False)) != crc:
            raise ValueError(f"block {k} fails its checksum")
    return [d if h else None for h, d in zip(has.tolist(), docs.tolist(), strict=True)], lengths, ids


def write(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Writes the ids of all documents in ascending ``key`` order; (shard, seq, n_ids, data), reread from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seq = encoder(tokenizer, spaced=False), TaskContext.get().partitionId(), 0
        who: list = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            nonlocal seq, held
            data = write_segment(who, np.concatenate(sizes), np.concatenate(parts))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())})
            seq, held = seq + 1, 0
            who.clear(), sizes.clear(), parts.clear()
            return row

        for b in gathered(batches, "text"):
            flat, at = enc.encode(b.column(1))
            who += b.column(0).to_pylist()
            parts.append(np.insert(flat, at[1:], end))
            sizes.append(np.diff(at) + 1)
            held += len(parts[-1])
            if held >= SEGMENT:
                yield segment()
        if held:
            yield segment()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-total // PART)), "doc_id").sortWithinPartitions("doc_id", "text")
    return durable(dealt.mapInArrow(run, "shard int, seq int, n_ids long, data binary"), "token-ids")


def read(files: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of written files."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("_shard"))
    before = files.select("shard", "seq", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_ids")).alias("_seq"))
    schema = "shard int, seq int, doc_id long, _at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, seq, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                docs, n, got = read_segment(data)
                ends = np.cumsum(n)
                raw = got.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [pa.array([shard] * len(docs), pa.int32()), pa.array([seq] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(ends - n, ends[-1:]), pa.int32()), pa.array(got, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["shard", "seq", "doc_id", "_at", "n_tokens", "ids_crc32", *["ids"] * ids])

    rows = files.select("shard", "seq", "data").mapInArrow(run, schema)
    placed = rows.join(before.join(shards, "shard"), ["shard", "seq"])
    return placed.select("doc_id", (F.col("_shard") + F.col("_seq") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op2_token_file(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    import public_tokenizers

    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), ids=False)

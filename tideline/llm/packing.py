"""Best-fit packing of token sequences by linear grouping.

A document is its ids and an end id; one of more than ``CAP`` tokens is cut into pieces, the first of which takes the
remainder. The pieces of all documents are only counted by length, so the plan is made from at most ``CAP`` numbers,
whatever the size of the corpus:

1. Lengths above ``LARGE`` of ``CAP`` are sorted and cut into ``GROUPS`` groups of equal numbers of pieces; each group
   is rounded up to its longest piece (groups of one longest piece are one).
2. Configurations (which at most ``MOST`` pieces share a sequence) are optimised by linear programming with generated
   columns: a revised simplex prices pairs and triples of group sizes, in ``ROUNDS`` rounds at most; any basis covers
   all pieces. Multiplicities are rounded down.
3. Actual lengths take the places of the rounded ones, longest first, which gives runs of sequences of equal content. A
   sequence in which that leaves a gap above a few tokens (``LOOSE``) is taken apart again.
4. What is left, longest first, goes to the run with the least gap that it fits, and to new sequences if there is none.

Steps 3 and 4 are done for each gap in ``LOOSE``, and the plan with the fewest sequences is taken, with equal numbers the
one with the largest gap, which keeps most of the linear program.

The plan is a table (length, rank from, first sequence, offset) with a few thousand rows (bounded by ``CAP`` and
``GROUPS``), which is broadcast. The rank of a piece among those of its length is counted in salted groups, so a
length that a third of all pieces share is dealt to many tasks.

Defined results: null and empty texts are one piece, the end id; equal rows are packed as often as they occur, and rows
with equal or null doc_id are rows of their own; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import durable, frugal, gathered, table
from tideline.llm.tokens import encoder, release

CAP = 1024
GROUPS = 512
ROUNDS = 1000
#: Pieces longer than this share of a sequence are grouped; ``MOST`` of them fit one sequence.
LARGE = 1 / 4
MOST = 3
#: Gaps that substitution may leave in a sequence that is kept.
LOOSE = (3, 1, 0)
END = 2
SALT_ROWS = 50_000
#: Bytes of text that are encoded at a time.
GATHER = 12 << 20


def cut(batches: Iterator[pa.RecordBatch], tokenizer: str, cap: int = CAP, end: int = END, size: int = GATHER) -> Iterator[pa.RecordBatch]:
    """The pieces of batches (doc_id, text), about ``size`` bytes of text encoded at a time, which takes up to 30 times that in memory."""
    enc = encoder(tokenizer, spaced=True)
    for b in gathered(batches, "text", size):
        flat, at = enc.encode(b.column(1))
        ids = np.insert(flat, at[1:], end).astype("<u4")
        n = np.diff(at) + 1
        begin = np.cumsum(n) - n
        first = (n - 1) % cap + 1
        parts = (n - 1) // cap + 1
        whose = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(whose)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.where(piece == 0, 0, first[whose] + (piece - 1) * cap)
        length = np.where(piece == 0, first[whose], cap)
        raw = memoryview(ids).cast("B")
        crc = [zlib.crc32(raw[4 * s : 4 * (s + l)]) for s, l in zip((begin[whose] + start).tolist(), length.tolist(), strict=True)]
        columns = [b.column(0).take(pa.array(whose)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", cap: int = CAP, end: int = END, reuse: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document.

    ``reuse``: a Python worker keeps its word table for later tasks (about 200 MB); else each task lets it go, starts
    without the free memory of stages before it and encodes less text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(batches, tokenizer, cap, end, GATHER if reuse else GATHER // 4)
        if not reuse:
            release()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run if reuse else frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Pricing:
    """The dearest content of one sequence of at most ``MOST`` pieces of given sizes, for any prices."""

    def __init__(self, sizes: np.ndarray, cap: int) -> None:
        self.sizes, self.cap = sizes, cap
        self.by_size = np.argsort(sizes, kind="stable")
        self.fits = np.searchsorted(sizes[self.by_size], np.arange(cap + 1), side="right")  # how many sizes fit each room
        room = cap - sizes
        self.room = room[:, None] - sizes[None, :]  # of a first and a second piece

    def best(self, price: np.ndarray) -> np.ndarray:
        sorted_ = price[self.by_size]
        top = np.concatenate(([0.0], np.maximum.accumulate(sorted_)))
        third = np.where(self.room >= 0, top[self.fits[np.maximum(self.room, 0)]], -np.inf)  # 0: no third piece
        value = price[:, None] + price[None, :] + third
        k = int(value.argmax())
        i, j = divmod(k, len(price))
        alone = price * (self.cap // self.sizes)
        made = np.zeros(len(price))
        if not np.isfinite(value[i, j]) or alone.max() >= value[i, j]:
            made[int(alone.argmax())] = self.cap // self.sizes[int(alone.argmax())]
            return made
        made[i] += 1
        made[j] += 1
        n = self.fits[self.room[i, j]]
        if n and sorted_[:n].max() > 0:
            made[self.by_size[int(sorted_[:n].argmax())]] += 1
        return made


def configurations(sizes: np.ndarray, demand: np.ndarray, cap: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """(config, multiplicity, rounded down) of a basis of the linear program, optimal if ``rounds`` suffice.

    Every basis on the way covers the demand, so one that is not optimal costs sequences but loses nothing.
    """
    pricing = _Pricing(sizes, cap)
    basis = np.diag((cap // sizes).astype(float))
    x, inverse = demand / np.diag(basis), np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        price = inverse.sum(0)
        new = pricing.best(price)
        has = np.flatnonzero(new)
        if (new[has] * price[has]).sum() <= 1 + 1e-7:
            break
        move = (inverse[:, has] * new[has]).sum(1)
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        basis[:, out] = new
        row = inverse[out] / move[out]
        move[out] -= 1
        inverse -= move[:, None] * row[None, :]
    return [(np.rint(basis[:, k]).astype(int), int(np.floor(x[k] + 1e-9))) for k in np.argsort(-x)]


def plan(counts: dict[int, int], cap: int = CAP, groups: int = GROUPS, large: float = LARGE, loose: tuple[int, ...] = LOOSE) -> tuple[np.ndarray, int]:
    """Rows (length, rank from, count, first sequence, offset), sorted, and the number of sequences."""
    above = max(large * cap, cap // (MOST + 1))
    lengths = sorted((l for l, c in counts.items() if c and above < l < cap), reverse=True)
    total = sum(counts[l] for l in lengths)
    share, room = -(-total // groups) if total else 0, 0
    by_size: dict[int, list[tuple[int, int]]] = {}  # of each group: (length, count), longest first
    size = 0
    for l in lengths:
        c = counts[l]
        while c:
            if not room:
                size, room = l, share  # groups of one longest length are one
            n = min(c, room)
            by_size.setdefault(size, []).append((l, n))
            c, room = c - n, room - n
    sizes = np.array(list(by_size), int)
    made = configurations(sizes, np.array([float(sum(c for _, c in p)) for p in by_size.values()]), cap) if len(sizes) else []
    return min((_fill(counts, by_size, made, cap, gap) for gap in loose), key=lambda p: p[1])


def _fill(counts: dict[int, int], by_size: dict[int, list[tuple[int, int]]], made: list[tuple[np.ndarray, int]], cap: int, loose: int) -> tuple[np.ndarray, int]:
    """Actual lengths in the places of the configurations, and the rest by best fit."""
    left = {l: c for l, c in counts.items() if c}
    runs: list[tuple[int, list[int]]] = []  # (number of sequences, their lengths)
    if full := left.pop(cap, 0):
        runs.append((full, [cap]))
    pools = {size: [[l, c] for l, c in p] for size, p in by_size.items()}
    for config, times in made:
        slots = []
        for size, n in zip(pools, config, strict=True):
            pool = pools[size]
            for _ in range(int(n)):
                need, slot = times, []
                while need and pool:
                    take = min(need, pool[0][1])
                    slot.append((pool[0][0], take))
                    left[pool[0][0]] -= take
                    need -= take
                    pool[0][1] -= take
                    if not pool[0][1]:
                        pool.pop(0)
                slots.append(slot)
        where = [np.cumsum([c for _, c in s]) for s in slots]
        edges = sorted({0, times, *(int(e) for w in where for e in w)})
        for a, b in zip(edges, edges[1:]):  # noqa: B905
            held = [s[k][0] for s, w in zip(slots, where, strict=True) if (k := int(np.searchsorted(w, a, side="right"))) < len(s)]
            if held and cap - sum(held) <= loose:
                runs.append((b - a, held))
            else:
                for l in held:
                    left[l] += b - a
    gaps: list[list[tuple[int, list[int]]]] = [[] for _ in range(cap + 1)]
    for n, held in runs:
        gaps[cap - sum(held)].append((n, held))
    for l in sorted(left, reverse=True):
        c = left[l]
        while c:
            gap = next((g for g in range(l, cap + 1) if gaps[g]), None)
            if gap is None:
                fit = cap // l
                if c >= fit:
                    gaps[cap - fit * l].append((c // fit, [l] * fit))
                    c %= fit
                else:
                    gaps[cap - c * l].append((1, [l] * c))
                    c = 0
                continue
            n, held = gaps[gap].pop()
            take = min(n, c)
            if take < n:
                gaps[gap].append((n - take, held))
            gaps[gap - l].append((take, [*held, l]))
            c -= take
    rows, first, ranks = [], 0, dict.fromkeys(counts, 0)
    for g in gaps:
        for n, held in g:
            offset = 0
            for l in held:
                rows.append((l, ranks[l], n, first, offset))
                ranks[l] += n
                offset += l
            first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), first


def pack(parts: DataFrame, cap: int = CAP) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32; a durable table) with sequence_id and offset."""
    spark = parts.sparkSession
    total = parts.count()
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(64, total // SALT_ROWS))))
    per = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made, _ = plan(counts, cap)
    shared = spark.sparkContext.broadcast(made)
    before = per.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_rank", rank - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = shared.value
        wide = np.int64(1) << 42
        k = np.searchsorted(rows[:, 0] * wide + rows[:, 1], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": rows[k, 3] + rank.to_numpy() - rows[k, 1], "offset": rows[k, 4]})

    return ranked.withColumn("_at", place("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    import public_tokenizers

    return pack(durable(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "pieces"))

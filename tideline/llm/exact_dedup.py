"""Exact dedup: an extendible-hash index over whole normalised texts in shared files.

Texts are equal when they are identical after every run of white space (space, tab to carriage return) is one space. A
text's key is its 64-bit XXH3. The index has two tables in the shared folder:

* **pages**: each task files the texts of a bounded buffer under their keys; texts of one key are chained and compared
  byte by byte, so copies within a buffer are one entry with the ids of all of them.
* **directory**: slots by the leading bits of the key, each with its bucket. It starts as one bucket and doubles as long
  as a bucket holds more than ``capacity`` bytes of texts: such a bucket is split by the next bit, others keep their
  depth and so own several slots. Every doubling reads counts a key prefix, never the texts. A bucket that no bit can
  split (one key, or ``DEPTH`` bits used) overflows into several pages instead.

Owner tasks take buckets, which are ranges of keys, sorted by key: they chain entries of one key, compare bytes, and
hold only the texts of one key. Where a bucket overflows, the first texts of its pages meet in a second round. So a
group of copies of any size reaches its owner as one entry a buffer, and its ids never have to be in one place.

Defined results: null is empty; a null doc_id ranks last and stays only where a group has no other, one row of it;
of rows of one doc_id and equal texts, one is kept; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bounded, durable, fresh, gathered, table

#: Bytes of texts a bucket holds, unless that made more than ``BUCKETS`` of them.
CAPACITY = 8 << 20
BUCKETS = 1 << 16
#: Bits of the key that the directory looks at: 2 ** DEPTH slots of 16 bytes at most.
DEPTH = 20
#: Bytes of texts that are filed together before the shuffle.
BUFFER = 8 << 20


def normal(text: Column) -> Column:
    """Null as empty; runs of white space as one space. A single space is left where it is."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]{2,}|[\t-\r]", " ")


class Chains:
    """Entries by key; those of one key are told apart by their bytes."""

    def __init__(self) -> None:
        self.by_key: dict[object, list[tuple[bytes, int]]] = {}

    def place(self, key: object, text: bytes, entry: int) -> int:
        """The entry that has the text: an earlier one, or else this."""
        chain = self.by_key.setdefault(key, [])
        for known, at in chain:
            if known == text:
                return at
        chain.append((text, entry))
        return entry


def pages(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(row, key, size, digest, text, ids): one row per different text of a buffer. ``bits`` of the hash make the key."""
    bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = 64 - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, "text", BUFFER):
            ids, chains = b.column(0).to_pylist(), Chains()
            texts: list[bytes] = []
            keys: list[int] = []
            members: list[list] = []
            for i, t in zip(ids, b.column(1).to_pylist(), strict=True):
                key = (xxhash.xxh3_64_intdigest(t) >> cut << cut) - (1 << 63)
                at = chains.place(key, t, len(texts))
                if at == len(texts):
                    texts.append(t)
                    keys.append(key)
                    members.append([])
                members[at].append(i)
            for m in members:
                m.sort(key=lambda i: (i is None, 0 if i is None else i))
            cols = [pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()), pa.array(members, pa.list_(b.column(0).type))]
            whole = pa.RecordBatch.from_arrays(cols, ["key", "size", "digest", "text", "ids"])
            for p in range(0, whole.num_rows, 1024):
                yield whole.slice(p, 1024)

    filed = docs.select("doc_id", normal(F.col("text")).cast("binary").alias("text")).mapInArrow(run, f"key long, size long, digest string, text binary, ids array<{kind}>")
    return durable(filed.select(F.monotonically_increasing_id().alias("row"), "*"), "pages")


def slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key, in the order of keys."""
    return (F.shiftright(key, 64 - depth) + F.lit(1 << (depth - 1))).cast("int") if depth else F.lit(0)


def directory(filed: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int, bool]:
    """(slot, bucket, pages) of every slot, the depth of the directory, and whether any bucket overflows.

    What comes to the driver is one row a bucket, of which there are at most a few times ``BUCKETS``.
    """
    spark = filed.sparkSession
    by_cell = filed.groupBy(slot(F.col("key"), DEPTH).alias("cell")).agg(F.sum(F.col("size") + 64).alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
    cells = durable(by_cell, "cells")
    whole = cells.agg(F.sum("size")).first()[0] or 0
    most = max(capacity, -(-whole // BUCKETS))
    closed: list[tuple[int, int, int]] = []
    full, depth = [0] if whole > most else [], 0
    if not full:
        closed.append((0, 0, 1))
    while full:
        depth += 1
        at = F.shiftright("cell", DEPTH - depth)
        parents = spark.createDataFrame([(p,) for p in full], "parent int")
        halves = cells.withColumn("at", at).join(F.broadcast(parents), F.shiftright("at", 1) == F.col("parent")).groupBy("at").agg(F.sum("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
        full_, seen = [], set()
        for h in halves.collect():
            seen.add(h["at"])
            if h["size"] <= most:
                closed.append((h["at"], depth, 1))
            elif h["low"] == h["high"] or depth == DEPTH:
                closed.append((h["at"], depth, -(-h["size"] // most)))
            else:
                full_.append(h["at"])
        closed += [(h, depth, 1) for p in full for h in (2 * p, 2 * p + 1) if h not in seen]  # empty halves
        full = full_
    closed.sort(key=lambda b: b[0] << (DEPTH - b[1]))
    rows = [(b << (depth - d), (b + 1 << (depth - d)) - 1, n, p) for n, (b, d, p) in enumerate(closed)]
    buckets = spark.createDataFrame(rows, "first int, last int, bucket int, pages int")
    slots = durable(buckets.select(F.explode(F.sequence("first", "last")).alias("slot"), "bucket", "pages"), "directory")
    return slots, depth, any(p > 1 for *_, p in closed)


def _chained(entries: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """``columns`` of each entry with ``head``, the first entry of its key and page with the same bytes, and ``first``, the
    text of a head whose bucket has several pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, chains = None, Chains()
        for b in batches:
            at = lambda name, b=b: b.column(b.schema.get_field_index(name))
            rows, heads, firsts = at("row").to_pylist(), [], []
            for row, key, page, many, t in zip(rows, at("key").to_pylist(), at("page").to_pylist(), at("pages").to_pylist(), at("text").to_pylist(), strict=True):
                if here != (key, page):
                    here, chains = (key, page), Chains()
                head = chains.place(key, t, row)
                heads.append(head)
                firsts.append(t if many > 1 and head == row else None)
            yield pa.RecordBatch.from_arrays([at(c) for c in columns] + [pa.array(heads, pa.int64()), pa.array(firsts, pa.binary())], [*columns, "head", "first"])

    return entries.sortWithinPartitions("key", "page").mapInArrow(run, schema + ", head long, first binary")


def members(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    filed = pages(docs, bits)
    slots, depth, overflows = directory(filed.select("key", "size"), capacity)
    placed = filed.withColumn("slot", slot(F.col("key"), depth)).join(F.broadcast(slots), "slot")
    placed = placed.withColumn("page", F.pmod(F.xxhash64("row"), F.col("pages")).cast("int"))
    keep = ["row", "key", "digest", "ids"]
    owned = placed.repartition("bucket", "page").select(*keep, "page", "pages", "text")
    found = durable(_chained(owned, keep, f"row long, key long, digest string, ids array<{kind}>"), "chained")
    if overflows:
        heads = found.where(F.col("first").isNotNull()).select("row", "key", F.lit(0).alias("page"), F.lit(1).alias("pages"), F.col("first").alias("text"))
        tops = _chained(heads.repartition("key"), ["row"], "row long").select(F.col("row").alias("head"), F.col("head").alias("top"))
        found = found.join(tops, "head", "left").withColumn("head", F.coalesce("top", "head"))
    least = F.col("ids")[0]
    groups = found.groupBy("head").agg(F.min(F.struct(least.isNull().alias("none"), least.alias("id"), F.col("row").alias("row"))).alias("keep"), F.sum(F.size("ids").cast("long")).alias("group_size"))
    both = found.select("head", "row", "digest", "ids").join(groups, "head")
    each = both.select("row", "digest", "keep", "group_size", F.posexplode("ids").alias("pos", "doc_id"))
    return each.select("doc_id", F.col("keep.id").alias("keep_id"), "group_size", ((F.col("row") == F.col("keep.row")) & (F.col("pos") == 0)).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    d, i = fresh(docs, "digest", "kept_id")
    stay = members(docs).where("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(d))
    own = docs.withColumn(d + "own", F.sha2(normal(F.col("text")).cast("binary"), 256))
    return own.join(stay, own["doc_id"].eqNullSafe(stay[i]) & (own[d + "own"] == stay[d]), "left_semi").dropDuplicates(["doc_id", d + "own"]).select(*docs.columns)


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return members(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""

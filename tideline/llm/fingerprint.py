"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A text's words (runs of anything but white space, lower-cased) are hashed; every ``SHINGLE`` consecutive word hashes
make a shingle hash (a text of fewer words is one shingle of all its words). The sketch keeps each distinct shingle
hash below 1/``SCALE`` of the hash range. The cut is the same for every document, so the intersection and union of two
sketches are the sketches of the intersection and union, whatever the two sizes: sketches can be merged, and
likeness (shared / joint hashes) and containment (shared / own hashes) are estimated from them without bias.

Nothing else decides what is kept, so the sketch of a short text can be empty (one of 5 shingles with a chance of a
quarter). Two empty sketches say nothing of their texts: those are alike with 1 if they have the same shingles, which
``same_shingles`` tells, and with 0 if not.

The text that follows another in descending doc_id is found in ranges of doc_id: each range is one sorted window, and
the first row of a range is also dealt to the range above it as its last.

Defined results: null and blank texts have the empty fingerprint, and are alike with 1 among each other and with 0 else; a null doc_id comes last; rows with equal doc_id follow each other by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import fresh, table

SHINGLE = 5
SCALE = 4
RANGE_ROWS = 2000
MOST_RANGES = 1 << 16
_TOP = (1 << 63) - 1


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` over a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The hashes (0 to 2^63 - 1) of all shingles, repeats included."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(h: Column) -> Column:
        n = F.size(h)
        window = F.transform(F.slice(h, 1, n - (size - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
        return F.when(n >= size, window).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(_let(F.transform(words, lambda w: F.xxhash64(w)), of), lambda x: x.bitwiseAND(F.lit(_TOP)))


def sketch(text: Column, size: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below 1/``scale`` of the range."""
    return F.array_sort(F.array_distinct(F.filter(shingle_hashes(text, size), lambda x: x < F.lit(_TOP // scale))))


def merged(a: Column, b: Column) -> Column:
    """The sketch of all shingles of two texts."""
    return F.array_sort(F.array_union(a, b))


def same_shingles(a: Column, b: Column, size: int = SHINGLE) -> Column:
    """Whether two texts have the same distinct shingles."""
    of = lambda text: F.array_sort(F.array_distinct(shingle_hashes(text, size)))
    return (a == b) | (of(a) == of(b))


def likeness(a: Column, b: Column, containment: bool = False, same: Column | None = None) -> Column:
    """Estimated share of the joint shingles (or with ``containment`` of those of ``a``) that both texts have, 0 to 1.

    ``same`` is looked at only where both sketches are empty; without it the estimate is 0 there.
    """
    both = F.size(F.array_intersect(a, b))

    def of(n: Column) -> Column:
        all_ = F.size(a) + (F.lit(0) if containment else F.size(b) - n)
        return F.when(all_ > 0, n / all_).otherwise(F.lit(0.0))

    empty = F.when(F.coalesce(same, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0)) if same is not None else F.lit(0.0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), empty).when(a == b, F.lit(1.0)).otherwise(_let(both, of))


def as_string(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with a struct ``next`` of the columns of the next row in descending order of ``key``; after the last comes the first.

    A given column ``next`` gives way.
    """
    k_, coarse_, range_, above_, in_ = fresh(docs, "k", "coarse", "range", "above", "in")
    k = F.col(k_)
    docs = docs.drop("next").withColumn(k_, F.coalesce(F.col(key), F.lit(-(1 << 63))))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = sorted(set(docs.agg(F.percentile_approx(k_, [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 4 * ranges))).first()[0] or []))
    # which range: first among every step-th cut, then among the cuts up to the next of those
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda cs: F.size(F.filter(cs, lambda c: c <= k))
    fixed = lambda cs: F.array(*map(F.lit, cs)) if cs else F.array().cast("array<bigint>")
    placed = docs.withColumn(coarse_, below(fixed(cuts[step - 1 :: step])))
    placed = placed.withColumn(range_, F.col(coarse_) * step + below(F.slice(fixed(cuts), F.col(coarse_) * step + 1, step)))
    heads = [(r[0], r[1]) for r in placed.groupBy(range_).agg(F.max(k_).alias("k")).orderBy(range_).collect()]
    guard = docs.sparkSession.createDataFrame([(k, heads[(i + 1) % len(heads)][0]) for i, (_, k) in enumerate(heads)], f"{k_} long, {above_} int")
    own = F.struct(F.col(range_).alias("r"), F.lit(False).alias("g"))
    both = F.array(own, F.struct(F.col(above_).alias("r"), F.lit(True).alias("g")))
    dealt = placed.join(F.broadcast(guard), k_, "left").select("*", F.explode(F.when(F.col(above_).isNull(), F.array(own)).otherwise(both)).alias(in_))
    order = Window.partitionBy(f"{in_}.r").orderBy(F.col(f"{in_}.g"), k.desc(), *columns)
    followed = dealt.withColumn("next", F.lead(F.struct(*columns)).over(order))
    return followed.where(~F.col(f"{in_}.g")).drop(k_, coarse_, range_, above_, in_)


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(F.col("next.text"), F.lit(1), F.floor(n / 2).cast("int")))
    both = with_next(docs, "doc_id", ["text"]).withColumn("edited", edited)
    own = both.withColumns({"sketch": sketch(F.col("text")), "edited_sketch": sketch(F.col("edited")), "next_sketch": sketch(F.col("next.text"))})
    return own.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), same=same_shingles(F.col("text"), F.col("edited"))).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), same=same_shingles(F.col("text"), F.col("next.text"))).alias("near_next"),
    )

"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows as Parquet into the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, language_id, near_duplicates as near, packing, substring_dedup
from tideline.llm.common import durable, fresh, held_out, table

#: A language prediction below this score is no language the model knows.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents whose text has letters and is surely in one of the learnt languages."""
    model = language_id.train(docs.where(~held_out(F.col("doc_id")) | F.col("doc_id").isNull()))
    pred, score = fresh(docs, "pred", "score")
    named = language_id.predict(docs, model, pred=pred, score=score)
    return named.where((F.col(pred) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The first document by doc_id of each group of near-duplicates: links of an exact five-word similarity of 0.8 or more.

    Rows of one doc_id and text are one document, and one of them stays.
    """
    h = fresh(docs, "h")[0]
    later = near.cluster(docs).where("not kept").select(F.col("doc_id").alias("id"), F.col("h").alias("later")).distinct()
    rows = docs.withColumn(h, F.xxhash64("text"))
    kept = rows.join(later, rows["doc_id"].cast("long").eqNullSafe(later["id"]) & (rows[h] == later["later"]), "left_anti")
    return kept.dropDuplicates(["doc_id", h]).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Texts without the units that an earlier document has; a document of which nothing is left goes.

    A given column ``removed`` is kept: it has another name while the operator's own ``removed`` is there.
    """
    own = [c for c in docs.columns if c.lower() == "removed"]
    held = dict(zip(own, fresh(docs, *(f"given_{c}" for c in own)), strict=True))
    done = substring_dedup.dedup(docs.withColumnsRenamed(held))
    kept = done.where((F.size("removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    kept = kept.withColumn("n_chars", F.length("text").cast("long")).drop("removed")
    return kept.withColumnsRenamed({h: c for c, h in held.items()}).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that is mostly such passages goes."""
    done = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One row per piece with its training sequence and its place there."""
    import public_tokenizers

    return packing.pack(durable(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), reuse=False), "pieces"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", benchmarks),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 code points of the lower-cased texts into ``buckets`` per language, in numpy inside
each task; Spark sums the partial counts. The log-probability matrix (buckets x languages, so bounded by the number of
languages and not by the corpus) is broadcast, and documents are scored in numpy batches by summing matrix rows.

Defined results: null text or a text without any letter is ``und`` with score 0; a null language is not learnt from;
without any learnt language every document is ``und``; equal evidence goes to the first language by name; repeated rows
count as often as they occur, in learning too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bounded, column, fresh, held_out, slices, table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: N-grams that evidence of longer texts is scaled to: neighbouring n-grams overlap, so their sum is too sure. One factor
#: scales all languages of a text, prior included, so the predicted language is the best one of the score as well.
EVIDENCE = 64
CHARS = 1 << 18
UNDETERMINED = "und"


def _grams(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, where each text's n-grams start and end, buckets of each order at each code point).

    Long texts come in several pieces; each looks ahead by two code points, so no n-gram is lost or counted twice.
    """
    look = max(ORDERS) - 1
    pieces = [(k, t[p : p + CHARS + look], min(CHARS, len(t) - p)) for k, t in enumerate(texts) for p in range(0, len(t), CHARS)]
    for i, j in slices([p[1] for p in pieces], CHARS):
        part = pieces[i:j]
        buf = np.frombuffer("".join(t + "\0" * (n + look - len(t)) for _, t, n in part).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([n for _, _, n in part])
        starts = np.concatenate(([0], np.cumsum(sizes + look)[:-1]))
        wide = len(buf) - look
        h = np.zeros(wide, np.uint32)
        out = np.empty((len(ORDERS), wide), np.uint32)
        for n in range(max(ORDERS)):
            h = (h + buf[n : n + wide] + np.uint32(n + 1)) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
            if n + 1 in ORDERS:
                out[ORDERS.index(n + 1)] = h & np.uint32(buckets - 1)
        yield np.array([k for k, _, _ in part]), np.stack([starts, starts + sizes], 1), out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, log priors, log probabilities (buckets x languages)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, l in zip(column(batch, "text"), column(batch, "lang"), strict=True):
                by.setdefault(l, []).append(t.lower())
            for l, texts in by.items():
                docs_of[l] = docs_of.get(l, 0) + len(texts)
                total = sums.setdefault(l, np.zeros(buckets, np.int64))
                for _, bounds, grams in _grams(texts, buckets):
                    inside = np.zeros(grams.shape[1] + 1, np.int8)
                    np.add.at(inside, bounds[:, 0], 1)
                    np.add.at(inside, bounds[:, 1], -1)
                    for row in grams[:, np.cumsum(inside[:-1]) > 0]:
                        total += np.bincount(row, minlength=buckets)
        for l, total in sums.items():
            b = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [l] * (len(b) + 1), "bucket": np.append(b, -1), "n": np.append(total[b], docs_of[l])})

    bounded(docs.sparkSession)
    rows = (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .where("text is not null and lang is not null")
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((buckets + 1, len(langs)))
    counts[rows["bucket"].to_numpy(int), rows["lang"].map({l: k for k, l in enumerate(langs)}).to_numpy(int)] = rows["n"]
    prior, grams = counts[-1], counts[:-1] + alpha
    return langs, np.log(prior / max(prior.sum(), 1)), np.log(grams / grams.sum(0)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score of 0 to 1; columns of those names give way."""
    langs, prior, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, prior, logp))
    schema = "_lang string, _score double"
    bounded(docs.sparkSession)

    @F.pandas_udf(schema)
    def scored(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        langs, prior, logp = shared.value
        raw = texts.tolist()
        names, scores = [UNDETERMINED] * len(raw), np.zeros(len(raw))
        at = [k for k, t in enumerate(raw) if t and any(map(str.isalpha, t))]
        if langs and at:
            low = [raw[k].lower() for k in at]
            sums, n = np.zeros((len(at), len(langs))), np.zeros(len(at))
            for k, bounds, grams in _grams(low, len(logp)):
                total = logp[grams[0]]
                for row in grams[1:]:
                    total = total + logp[row]
                total = np.concatenate([total, np.zeros((1, len(langs)), np.float32)])
                np.add.at(sums, k, np.add.reduceat(total, bounds.ravel(), axis=0, dtype=np.float64)[::2])
                np.add.at(n, k, (bounds[:, 1] - bounds[:, 0]) * len(ORDERS))
            best = (prior + sums).argmax(1)
            z = (prior + sums) * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, k in enumerate(at):
                names[k], scores[k] = langs[best[i]], p[i, best[i]]
        return pd.DataFrame({"_lang": names, "_score": scores})

    p = fresh(docs, "p")[0]
    return docs.withColumn(p, scored(F.col(text))).withColumns({pred: F.col(f"{p}._lang"), score: F.col(f"{p}._score")}).drop(p)


def op4_language_id(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")

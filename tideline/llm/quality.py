"""Quality classifier by compression: one zstandard dictionary of good labelled text, one of bad.

A text is cut into blocks of ``BLOCK`` bytes (whole text, so a long document weighs as a short one), each block is
compressed with both dictionaries, and (bytes with the bad one - bytes with the good one) / bytes of text is the
evidence. A logistic curve fitted on labelled rows that neither dictionary has seen turns it into a probability.

The fit uses at most ``rows`` labelled documents a class (a documented bound; they are picked by the hash of their id,
half for the dictionaries and half for the curve), so dictionaries and driver memory do not grow with the corpus.

Defined results: null and empty texts have no evidence and get the share of good labels as score; null labels are not
learnt from; with labels of one class only, every score is that share as well; of rows with one doc_id the first by text
is learnt from, and of a text longer than ``TEXT_CHARS`` code points blocks at even steps.
"""

from __future__ import annotations

import numpy as np
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import held_out, table

BLOCK = 2048
ROWS = 3000
#: Code points of a labelled text that are learnt from at most, so that the driver holds 2 * ROWS * TEXT_CHARS of them.
TEXT_CHARS = 32_768
DICT_BYTES = 112_640
LEVEL = 3


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def compressor(raw: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def evidence(texts: list[str | None], good: zstd.ZstdCompressor, bad: zstd.ZstdCompressor) -> np.ndarray:
    """(bad - good) / bytes of each text, 0 for an empty one."""
    out = np.zeros(len(texts))
    for k, t in enumerate(texts):
        if t:
            data = t.encode("utf-8", "replace")
            out[k] = sum(len(bad.compress(b)) - len(good.compress(b)) for b in _blocks(data)) / len(data)
    return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a slight pull of the slope to 0."""
    w, a = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + np.array([0, 1e-3]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-9, 1e-3])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> dict:
    """Dictionaries and curve from documents (doc_id, text) and labels (doc_id, quality)."""
    label = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality in (0, 1)")
    counts = {r.quality: r.n for r in label.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / (sum(counts.values()) or 2) or (0.0 if counts else 0.5)
    # ids first, so that only the picked texts leave their files: about twice as many by hash, then exactly so many
    roll = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    picked: list = []
    for q, n in counts.items():
        some = label.where((F.col("quality") == q) & (roll < int(min(1, 2 * rows / n + 1e-4) * 1_000_000)))
        picked += some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    few = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in picked], "doc_id long, quality int")
    step = F.ceil(F.length("text") / TEXT_CHARS).cast("int")
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / BLOCK).cast("int"), step), lambda i: F.substring("text", i * BLOCK + 1, F.lit(BLOCK))), "")
    short = F.when(F.length("text") > TEXT_CHARS, spread).otherwise(F.col("text"))
    rows_ = docs.where("text <> ''").select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", short.alias("text"), "quality")
    found = rows_.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    texts: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(found, key=lambda r: (r.doc_id, r.text)):
        texts[r.quality].append(r.text)
    if min(map(len, texts.values())) < 2:
        return {"share": share, "dicts": None}
    dicts, feats = {}, {}
    for q, t in texts.items():
        half = [b for x in t[::2] for b in _blocks(x.encode("utf-8", "replace"))]
        try:
            dicts[q] = zstd.train_dictionary(DICT_BYTES, half, level=LEVEL, k=256, d=8).as_bytes()
        except zstd.ZstdError:  # too few samples to train on: their text itself is the dictionary
            dicts[q] = b"".join(half)[-DICT_BYTES:]
    good, bad = compressor(dicts[1]), compressor(dicts[0])
    for q, t in texts.items():
        feats[q] = evidence(t[1::2], good, bad)
    x, y = np.concatenate([feats[0], feats[1]]), np.repeat([0.0, 1.0], [len(feats[0]), len(feats[1])])
    a, b = logistic(x, y)
    # the classes were sampled apart: the intercept is moved to their share among all labels
    a += np.log(share / (1 - share)) - np.log(len(feats[1]) / len(feats[0]))
    return {"share": share, "dicts": dicts, "curve": (a, b)}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a quality score of 0 to 1 (higher: good is likelier); a column of that name gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list = []

    @F.pandas_udf("double")
    def scored(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        m = shared.value
        raw = texts.tolist()
        if m["dicts"] is None:
            return pd.Series(np.full(len(raw), m["share"]))
        if not made:
            made.extend([compressor(m["dicts"][1]), compressor(m["dicts"][0])])
        a, b = m["curve"]
        p = 1 / (1 + np.exp(-np.clip(a + b * evidence(raw, *made), -30, 30)))
        return pd.Series(np.where([bool(t) for t in raw], p, m["share"]))

    return docs.withColumn(out, scored(F.col(text)))


def op1_quality(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"))
    model = train(docs.where(~out), labels.where(~out))
    scored = score(docs.select("doc_id", "text", out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

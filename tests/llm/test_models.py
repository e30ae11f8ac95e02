import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, AWKWARD_IDS, docs
from tideline.llm import language_id, quality
from tideline.llm.common import held_out, table


def test_language_id_learns_and_holds_out(spark, sf):
    d = table(spark, sf, "documents")
    model = language_id.train(d.where(~held_out(F.col("doc_id"))))
    got = language_id.predict(d, model).where(held_out(F.col("doc_id"))).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_id_sums_are_those_of_one_pass():
    texts = ["abc", "", "x", "é" * 50]
    got = {}
    for k, bounds, grams in language_id._grams(texts, 1 << 15):
        for t, (a, b) in zip(k, bounds, strict=True):
            got.setdefault(int(t), []).append(grams[:, a:b])
    whole = {k: np.concatenate(v, 1) for k, v in got.items()}
    old, language_id.CHARS = language_id.CHARS, 7
    try:
        parts = {}
        for k, bounds, grams in language_id._grams(texts, 1 << 15):
            for t, (a, b) in zip(k, bounds, strict=True):
                parts.setdefault(int(t), []).append(grams[:, a:b])
    finally:
        language_id.CHARS = old
    assert whole.keys() == parts.keys() == {0, 2, 3}
    for k, v in parts.items():
        assert (np.concatenate(v, 1) == whole[k]).all()


def test_language_id_awkward(spark):
    d = docs(spark, AWKWARD, AWKWARD_IDS)
    got = {(r.doc_id, r.text): r for r in language_id.predict(d, language_id.train(d)).collect()}
    assert len(got) == len(set(zip(AWKWARD_IDS, AWKWARD, strict=True)))
    for t, i in ((None, None), ("", 1), ("   \n\t ", 2), ("123 456 !!!", 7)):
        assert (got[i, t].lang_pred, got[i, t].score) == ("und", 0.0)
    assert got[4, AWKWARD[4]].lang_pred in ("de", "en")
    none = language_id.predict(d, language_id.train(d.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.predict(d.limit(0), language_id.train(d)).count() == 0


def test_language_id_brute_force(spark, sf):
    """Naive Bayes with exact counts of hashed n-grams, one text and n-gram at a time."""
    from collections import Counter

    rows = table(spark, sf, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("out")).collect()
    buckets = 1 << 15

    def grams(text):
        n = Counter()
        for _, bounds, g in language_id._grams([text.lower()], buckets):
            for a, b in bounds:
                for row in g[:, a:b]:
                    n.update(row.tolist())
        return n

    counts, docs_of = {}, Counter()
    for r in rows:
        if r.text is not None and r.lang is not None and not r.out:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
            docs_of[r.lang] += 1
    langs = sorted(counts)
    totals = {l: sum(counts[l].values()) + 0.5 * buckets for l in langs}
    got = {r.doc_id: r for r in language_id.op4_language_id(spark, sf).collect()}
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        n = grams(r.text)
        z = [np.log(docs_of[l] / sum(docs_of.values())) + sum(c * np.float64(np.float32(np.log((counts[l][g] + 0.5) / totals[l]))) for g, c in n.items()) for l in langs]
        top = sorted(z)[-2:]
        assert got[r.doc_id].score >= 1 / len(langs) - 1e-9  # the score is that of its own distribution's best
        if top[1] - top[0] > 1e-3:
            assert got[r.doc_id].lang_pred == langs[int(np.argmax(z))] and got[r.doc_id].held_out == r.out


def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = held_out(F.col("doc_id"))
    model = quality.train(d.where(~out), labels.where(~out))
    got = quality.score(d, model).join(labels, "doc_id").where(out).toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_quality_brute_force(spark, sf):
    """Every row of op1_quality again, one block and text at a time, with compressors made for it."""
    import zlib

    import zstandard as zstd

    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = held_out(F.col("doc_id"))
    model = quality.train(d.where(~out), labels.where(~out))
    a, b = model["curve"]
    made = []
    for q in (0, 1):
        raw = zstd.ZstdCompressionDict(model["dicts"][q])
        raw.precompute_compress(level=3)
        made.append(zstd.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
    bad, good = made
    got = {r.doc_id: r for r in quality.op1_quality(spark, sf).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    assert got.keys() == texts.keys()
    for i, data in texts.items():
        more = 0
        for p in range(0, len(data), 2048):
            block = data[p : p + 2048]
            more += len(bad.compress(block)) - len(good.compress(block))
        want = 1 / (1 + np.exp(-np.clip(a + b * more / len(data), -30, 30))) if data else model["share"]
        assert abs(got[i].score - want) < 1e-9, i
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_awkward(spark):
    d = docs(spark, AWKWARD, AWKWARD_IDS)
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, None), (4, 0), (5, 0), (6, 1), (None, 0), (99, 1)], "doc_id long, quality int")
    got = quality.score(d, quality.train(d, labels)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    one = quality.train(d, labels.where("quality = 1"))
    assert {r.score for r in quality.score(d, one).collect()} == {1.0}
    empty = quality.train(d, labels.limit(0))
    assert {r.score for r in quality.score(d, empty).collect()} == {0.5}


def test_quality_whole_text_counts():
    good, bad = quality.compressor(b"plain words of prose " * 50), quality.compressor(b"$$$ &&& %%% " * 50)
    x, y = quality.evidence(["plain words " * 5000 + "$$$ &&& %%% " * 5000, "plain words " * 10_000], good, bad)
    assert x < y


@pytest.mark.parametrize("seed", [0, 1])
def test_logistic_recovers_curve(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    a, b = quality.logistic(x, y)
    assert abs(a - 0.5) < 0.15 and abs(b - 2) < 0.15

"""op11, op12 and op13 against brute force on awkward rows, hot groups, forced splits and collisions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, AWKWARD_IDS, docs
from tideline.llm import divergence, exact_dedup, hard_negatives

RNG = random.Random(7)


# exact dedup
def brute_dedup(texts, ids):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = defaultdict(list)
    for t, i in zip(norm, ids, strict=True):
        groups[t].append(i)
    out = []
    for t, members in groups.items():
        members.sort(key=lambda i: (i is None, i or 0))
        out += [(i, members[0], len(members), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(members)]
    return sorted(out, key=repr)


def got_dedup(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize(("capacity", "bits"), [(exact_dedup.CAPACITY, 64), (400, 64), (400, 3), (64, 1)])
def test_exact_dedup_brute_force(spark, capacity, bits):
    """A third of the rows are copies; small buckets split and overflow, short keys collide and chain."""
    texts = [*AWKWARD[:5], *AWKWARD[6:], *[f"text number {RNG.randrange(60)} of  many" for _ in range(150)], *["the  same\ttext"] * 40, *["the same text"] * 40, "one two", "one  two ", " one two", "one\x0btwo"]
    ids = [*AWKWARD_IDS[:5], *AWKWARD_IDS[6:], *RNG.sample(range(100, 1000), len(texts) - 8)]
    d = docs(spark, texts, ids)
    assert got_dedup(exact_dedup.members(d, capacity, bits)) == brute_dedup(texts, ids)


def test_exact_dedup_splits_and_doubles(spark):
    rows = [(int(k), 100) for k in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)] + [(1, 100)] * 300
    slots, depth, overflows = exact_dedup.directory(spark.createDataFrame(rows, "key long, size long"), 164 * 20)
    got = slots.orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(2**depth)) and overflows
    sizes = Counter(got[(k + 2**63) >> (64 - depth)].bucket for k, _ in rows)
    assert max(n for b, n in sizes.items() if {r.pages for r in got if r.bucket == b} == {1}) <= 20
    assert len({r.bucket for r in got}) < len(got)  # buckets of less depth own several slots
    one, depth, over = exact_dedup.directory(spark.createDataFrame([], "key long, size long"))
    assert (one.count(), depth, over) == (1, 0, False)


def test_exact_dedup_keeps_rows(spark):
    d = docs(spark, ["a  b", "a b", None, "", "x", "x"], [5, 3, 9, 8, 4, 4])
    kept = exact_dedup.dedup(d)
    assert kept.columns == d.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "a b"), (4, "x"), (8, "")]
    assert exact_dedup.members(d.limit(0)).count() == 0 and exact_dedup.dedup(d.limit(0)).count() == 0


# hard negatives
def brute_negatives(rows, k=5):
    ok = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for r in ok:
        if r[0] % 100 == 0 and (r[0] not in anchors or r[1:] < anchors[r[0]][1:]):
            anchors[r[0]] = r
    out = []
    for a, lab, v in anchors.values():
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, other, w in ok]
        pos = sorted((s, i) for s, i, other in score if other == lab and i != a)[:5]
        for s, p in pos:
            neg = sorted((t, i) for t, i, other in score if other != lab and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(neg)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, id string, c string, block int, slice int, nth int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", 1, 2, 3) for i, lab, v in rows], VECTORS).repartition(3)


def near_rows(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    return [(i, int(rng.integers(4)), [float(x) for x in np.float32(centres[i % 4] + spread * rng.normal(size=dims))]) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 16, 70])
def test_hard_negatives_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 100)  # several slices
    rows = near_rows(700, dims, dims)
    rows += [(300, 2, rows[4][2]), (300, 1, rows[4][2]), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]  # repeated ids and rows
    rows += [(1000, None, rows[0][2]), (1100, 1, None), (1200, 1, [None] * dims), (1300, 1, [float("nan")] * dims), (1400, 2, [float("inf")] + [0.0] * (dims - 1)), (None, 1, rows[0][2]), (1500, 1, []), (1600, 2, [0.0] * dims), (1700, 1, rows[9][2][: dims // 2])]
    got = hard_negatives.mine(vectors(spark, rows), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_copies_and_empty(spark, monkeypatch):
    """A third of the rows are one vector: ties by id; anchors without a positive or a negative give nothing."""
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 64)
    rows = near_rows(150, 8, 3) + [(1000 + i, i % 2, [0.5] * 8) for i in range(80)] + [(5000, 99, [1.0] * 8)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert hard_negatives.mine(vectors(spark, []), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.mine(vectors(spark, [(1, 1, [1.0])]), F.col("id") % 100 == 0).count() == 0


def test_bit_planes_give_products_and_drop():
    rng = np.random.default_rng(0)
    a, r = rng.integers(-300, 300, (5, 64)), rng.integers(-300, 300, (40, 64))
    planes = hard_negatives.Planes(r)
    assert (sum(w * b.astype(int) for w, b in zip(planes.weights, planes.bits, strict=True)) == r).all()
    exact = a @ r.T
    asked = []

    def qualify(low, high, alive):
        assert (low <= exact).all() and (exact <= high).all()
        asked.append(int(alive.sum()))
        return alive & (high >= hard_negatives.kth(low, 1, -(10**9))[:, None])

    i, j, s = hard_negatives.scored(a, planes, slice(0, 40), np.ones((5, 40), bool), qualify)
    assert (s == exact[i, j]).all() and asked[-1] < asked[0] == 200
    assert set(zip(range(5), exact.argmax(1).tolist(), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))


# divergence
def brute_divergence(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(low))
        groups[lang].add(source)
        n[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        every = Counter()
        for s in sources:
            every.update(n[lang, s])
        q, p = shares(every), {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", terms)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def divergence_rows():
    rng = random.Random(11)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Ärger", "É", "漢字", "Z"]
    rows = [(" ".join(rng.choices(words, [1 / (k + 1 + (s * 7) % 40) for k in range(len(words))], k=rng.randrange(40))), lang, f"s{s}") for lang in ("en", "de") for s in range(6) for _ in range(12)]
    return rows + [(None, None, None), ("", "en", "silent"), ("1 2 3", "xx", "a"), ("only few", "xx", "b"), (None, "xx", "ä"), *[("again AGAIN again", "en", "s1")] * 12, *[("again", None, None)] * 11]


@pytest.mark.parametrize("batch", [divergence.BATCH_ROWS, 8])
def test_divergence_brute_force(spark, batch, monkeypatch):
    monkeypatch.setattr(divergence, "BATCH_ROWS", batch)
    rows = divergence_rows()
    d = spark.createDataFrame([(t, lang, s, "x", 1, 2, "y") for t, lang, s in rows], "text string, lang string, source string, term string, n long, h long, part string").repartition(3)
    assert sorted(map(tuple, divergence.audit(d).collect())) == brute_divergence(rows)
    assert divergence.audit(d.limit(0)).count() == 0


def test_batches_hold_whole_terms():
    h = sorted(RNG.choices(range(-20, 20), k=500))
    batches = [pa.record_batch({"h": pa.array(h[i : i + 7], pa.int64())}) for i in range(0, 500, 7)]
    for rows, pairs in ((16, 0), (1000, 0), (64, 100), (64, 10**9)):
        got = [t["h"].to_pylist() for t in divergence.whole_terms(iter(batches), rows, pairs)]
        assert sum(got, []) == h and all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))

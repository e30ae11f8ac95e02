import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import AWKWARD, AWKWARD_IDS, LONG, docs
from tideline.llm import fingerprint, simhash, substring_dedup, suffix_dedup
from tideline.llm.graph import components
from pyspark.sql import functions as F


def brute_fp(t):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, ids, distance=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(fps))]
    least = {r: min((ids[i] for i in range(len(fps)) if roots[i] == r and ids[i] is not None), default=None) for r in roots}
    return [least[r] for r in roots]


def test_simhash_awkward_and_spark_hash(spark):
    d = docs(spark, AWKWARD, AWKWARD_IDS)
    got = simhash.cluster(d).collect()
    assert len(got) == len(AWKWARD)
    want = [brute_fp(t) for t in AWKWARD]
    comp = brute_components(want, AWKWARD_IDS)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(zip(AWKWARD_IDS, want, comp, strict=True), key=key)
    assert spark.sql("select xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert simhash.cluster(d.limit(0)).count() == 0


@pytest.mark.parametrize(("group", "distance"), [(50_000, 4), (60, 4), (50_000, 6), (500, 6), (50_000, 2)])
def test_links_find_all_pairs(spark, group, distance):
    """Random fingerprints, dense clusters and chains; a small group bound takes the way of split groups."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for base in list(fps[:12]):
        x = base
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(1, distance + 1)):
                x ^= 1 << b
            fps.append(x)
    centre = fps[20]
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5) if a != b]
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(frame, group, distance)
    ids = {f: i for i, f in enumerate(signed)}
    rows = edges.collect()
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= distance for r in rows)
    root = {r.node: r.root for r in components(edges).collect()}
    got = [root.get(f, f) for f in signed]
    want = brute_components(fps, list(range(len(fps))), distance)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want, strict=True))) == len(set(want)) and len(ids) == len(fps)


def test_components_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {500: 500, 501: 500}


def test_substring_brute_force(spark):
    rng = random.Random(3)
    common = ["This is the very same sentence that many documents have in them.", "Another passage with well over eight words that comes back again."]
    texts = []
    for k in range(60):
        own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) + "." for _ in range(4)]
        if k % 2:
            own.insert(rng.randrange(4), common[k % 4 // 2].upper() if k % 3 else "  " + common[k % 4 // 2])
        texts.append(rng.choice([" ", "\n"]).join(own))
    texts += [common[0] + " " + common[0], "short. short. short.", None, ""]
    got = {r.doc_id: r for r in substring_dedup.dedup(docs(spark, texts)).collect()}
    seen = set()
    for k, t in enumerate(texts):
        spans = []
        for a, b, norm in substring_dedup.units_of(t or "", "sentence", 8):
            if norm in seen:
                spans.append((a, b))
            seen.add(norm)
        assert [(s.a, s.b) for s in got[k].removed] == spans
        assert got[k].text == (substring_dedup.cut(t, spans) if t is not None else None)
    assert sum(len(r.removed) for r in got.values()) == 30
    assert list(got[0].asDict()) == [*(c for c in docs(spark, ["x"]).columns if c != "removed"), "removed"]


def test_substring_units_and_cut():
    t = "a b c d e f g h. i j k l m n o p\n\nq r s t u v w x"
    assert [t[a:b] for a, b, _ in substring_dedup.units_of(t, "line", 8)] == ["a b c d e f g h. i j k l m n o p", "q r s t u v w x"]
    assert [x for _, _, x in substring_dedup.units_of("a b\nc d\n\ne f", "paragraph", 1)] == ["a b c d", "e f"]
    assert substring_dedup.cut("ab\ncd\nef", [(3, 5)]) == "ab\nef"


def test_substring_awkward(spark):
    got = substring_dedup.dedup(docs(spark, AWKWARD, AWKWARD_IDS)).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id != 7}
    assert by[6].text == AWKWARD[6] and by[5].text == LONG and by[None].text is None
    assert sorted(r.text for r in got if r.doc_id == 7) == ["", "123 456 !!!"]
    assert substring_dedup.dedup(docs(spark, AWKWARD).limit(0)).count() == 0


def brute_suffix(texts, ids, width=50):
    rows = []
    big = 1 << 62
    order = [(i if i is not None else big, (t or "").encode()) for i, t in zip(ids, texts, strict=True)]
    where = {}
    for i, b in order:
        for p in range(len(b) - width + 1):
            x = b[p : p + width]
            where[x] = min(i, where.get(x, big + 1))
    for i, b in order:
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if where[b[p : p + width]] < i:
                mask[p : p + width] = True
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        rows.append((None if i == big else i, len(b), int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return rows


@pytest.mark.parametrize("group", [16 << 20, 3000])
def test_suffix_brute_force(spark, group):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(80):
        t = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        if rng.random() < 0.7:
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            t += [s[a : a + rng.randint(30, 150)], word()]
        texts.append("".join(t))
    texts += ["a" * 500, "a" * 49, "a" * 300 + "b" + "a" * 60, "ab" * 200, "ba" * 100, None, "", "x" * 49 + "y", texts[3], texts[3]]
    ids = list(range(len(texts) - 2)) + [3, None]
    got = suffix_dedup.dedup(docs(spark, texts, ids), group=group).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, bytes(r.kept)) for r in got), key=key) == sorted(brute_suffix(texts, ids), key=key)


def test_suffix_awkward(spark):
    got = suffix_dedup.dedup(docs(spark, AWKWARD, AWKWARD_IDS)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, bytes(r.kept)) for r in got), key=key) == sorted(brute_suffix(AWKWARD, AWKWARD_IDS), key=key)
    assert suffix_dedup.dedup(docs(spark, AWKWARD).limit(0)).count() == 0


def test_columnwise_order():
    pieces = [b"banana banana banana", b"ananas banana", b"nab", b"banana banana banana"[:15]]
    who, at, same = suffix_dedup.columnwise(pieces, 8)
    found = [pieces[w][a:] for w, a in zip(who, at, strict=True)]
    assert found == sorted(found) and len(found) == sum(max(0, len(p) - 7) for p in pieces)
    assert [bool(s) for s in same[1:]] == [x[:8] == y[:8] for x, y in zip(found, found[1:])]  # noqa: B905


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprint_contract(spark, sf):
    rows = {r.doc_id: r for r in fingerprint_query(spark, sf)}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    errors, exact = [], []
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        m = len(t) // 2
        edited = t[: len(t) - m] + nxt[:m]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(t), shingles(edited), shingles(nxt)
        errors.append(rows[i].near_edited - len(a & b) / len(a | b))
        exact.append(rows[i].near_next - (len(a & c) / len(a | c)))
        # the estimates are exactly those of the two fingerprints
        x, y, z = (set(zip(*[iter(f)] * 16)) for f in (rows[i].fingerprint, rows[i].edited_fingerprint, rows[order[(k + 1) % len(order)]].fingerprint))
        # of two empty ones only the same shingles are alike
        assert rows[i].near_edited == (len(x & y) / len(x | y) if x | y else a == b)
        assert rows[i].near_next == (len(x & z) / len(x | z) if x | z else a == c)
        assert all("".join(w) < f"{(2**63 - 1) // fingerprint.SCALE:016x}" for w in x | y)
    assert np.mean(np.abs(errors)) < 0.06 and abs(np.mean(errors)) < 0.02 and np.mean(np.abs(exact)) < 0.02
    same = {}
    for i, t in texts.items():
        assert same.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def fingerprint_query(spark, sf):
    return fingerprint.op6_fingerprint(spark, sf).collect()


@pytest.mark.parametrize("rows", [2000, 2])
def test_fingerprint_next_over_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", rows)
    ids = [None, *random.Random(1).sample(range(10**12), 40), 5, 5, -(1 << 62)]
    d = docs(spark, [f"t{k}" for k in range(len(ids))], ids).withColumn("next", F.lit("given"))
    got = {r.text: r.next.text for r in fingerprint.with_next(d, "doc_id", ["text"]).collect()}
    low = -(1 << 63)
    order = sorted(((i if i is not None else low, f"t{k}") for k, i in enumerate(ids)), key=lambda x: (-x[0], x[1]))
    assert got == {order[k][1]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    assert fingerprint.with_next(d.limit(0), "doc_id", ["text"]).count() == 0


def test_fingerprint_merges(spark):
    words = [f"w{k}" for k in range(300)]
    d = spark.createDataFrame([(" ".join(words[:150]), " ".join(words[100:]), " ".join(words))], "x string, y string, whole string")
    # with four words of overlap at least, the shingles of the whole are those of its parts
    r = d.select(fingerprint.merged(fingerprint.sketch(F.col("x")), fingerprint.sketch(F.col("y"))), fingerprint.sketch(F.col("whole"))).first()
    assert r[0] == r[1] and len(r[0]) > 30


def test_fingerprint_awkward(spark):
    d = docs(spark, AWKWARD, AWKWARD_IDS).withColumn("s", fingerprint.sketch(F.coalesce("text", F.lit(""))))
    got = {r.text: r.s for r in d.collect()}
    assert got[None] == got[""] == got["   \n\t "] == [] and len(got["One."]) <= 1
    pair = spark.createDataFrame([(AWKWARD[6], AWKWARD[6]), ("", ""), ("", " ".join(f"a{k}" for k in range(200))), (LONG, LONG + " and more of it"), ("a b c d e f g", "a b c d e f h")], "x string, y string")
    same = fingerprint.same_shingles(F.col("x"), F.col("y"))
    near = [r[0] for r in pair.select(fingerprint.likeness(fingerprint.sketch(F.col("x")), fingerprint.sketch(F.col("y")), same=same)).collect()]
    assert near[:3] == [1.0, 1.0, 0.0] and near[3] > 0.95 and 0 <= near[4] <= 1
    # short texts, many of them without a kept hash: unlike ones are never alike
    few = spark.createDataFrame([(f"a{k}", f"b{k} c", f"A{k} ") for k in range(60)], "x string, y string, z string")
    of = lambda o: fingerprint.likeness(fingerprint.sketch(F.col("x")), fingerprint.sketch(F.col(o)), same=fingerprint.same_shingles(F.col("x"), F.col(o)))
    got = few.select(of("y"), of("z"), F.size(fingerprint.sketch(F.col("x")))).collect()
    assert {r[0] for r in got} == {0.0} and {r[1] for r in got} == {1.0} and {r[2] for r in got} == {0, 1}
    part = pair.limit(4).select(fingerprint.likeness(fingerprint.sketch(F.lit(LONG[:100_000])), fingerprint.sketch(F.lit(LONG)), containment=True)).first()[0]
    assert part > 0.95

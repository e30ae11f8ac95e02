import random

import pytest

import corpus_pipeline
from tests.llm.helpers import docs
from tests.llm.test_duplicates import shingles
from tideline.llm import near_duplicates


def jaccard(x, y):
    a, b = shingles(x), shingles(y)
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts):
    """Least index of each component of all pairs of 0.8 or more."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    words = list(words)
    for p in rng.sample(range(len(words)), n):
        words[p] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [near_duplicates.SMALL, 2])
def test_pipeline_keeps_all_but_near_duplicates(spark, small, monkeypatch):
    """Pairs from 0.7 to 0.95, chains and a dense group; a small bound takes the way of large buckets and blocks."""
    monkeypatch.setattr(near_duplicates, "SMALL", small)
    monkeypatch.setattr(near_duplicates, "BLOCK_NODES", 15 if small == 2 else 1000)
    rng = random.Random(4)
    texts = ["", None, "   ", "a b c", "A  b c", "a b d"]
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(words), edited(rng, words, 1 + k % 8)]
    chain = [f"c{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(40):
        texts.append(edited(rng, chain, 1))
    for _ in range(6):
        chain = edited(rng, chain, 3).split()
        texts.append(" ".join(chain))
    want = groups(["" if t is None else t for t in texts])
    got = corpus_pipeline.near_duplicates(spark, docs(spark, texts), None).collect()
    assert {r.doc_id for r in got} == {k for k, g in enumerate(want) if k == g}

import random

import numpy as np
import pytest

import corpus_pipeline
from strandwise.llm import nearcopies

SCHEMA = "doc_id long, text string, set string, key int"


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def corpus(seed):
    """Copies with changed words, a long chain of changes, and a group in which a member is near to some only."""
    rng = random.Random(seed)
    prose = lambda n: [f"W{rng.randrange(5000)}é" for _ in range(n)]
    texts = [None, "", " \n ", "one two", "One  two", "one three", "a b c d e", "x " * 3000]
    for _ in range(60):
        base = prose(rng.randint(5, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 40)):
                near[rng.randrange(len(near))] = "changed"
            texts.append("\t".join(near))
    chain = prose(200)
    for i in range(30):
        chain[rng.randrange(200)] = f"step{i}"
        chain[rng.randrange(200)] = f"stride{i}"
        texts.append(" ".join(chain))
    line = prose(12)
    texts += [" ".join(line + prose(rng.randint(1, 60))) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "many"), [(1, nearcopies.MANY), (2, 3)])
def test_one_is_kept_of_each_group_by_brute_force(spark, monkeypatch, seed, many):
    """Also with buckets of more than three sets dealt in shares."""
    monkeypatch.setattr(nearcopies, "MANY", many)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    assert {r.doc_id for r in nearcopies.keep_one(docs).collect()} == brute_kept(rows)


def test_stage_drops_what_is_similar_but_more_than_four_bits_apart(spark):
    rng = random.Random(5)
    rows = []
    for g in range(20):
        base = [f"w{rng.randrange(9000)}" for _ in range(100)]
        near = list(base)
        near[50] = near[20] = "changed"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.STAGES[1][1](spark, docs, "").collect()
    assert {r.doc_id for r in got} == brute_kept(rows) == set(range(0, 40, 2))


def test_bitmaps_bound_the_index_from_above():
    rng = np.random.default_rng(3)
    for n in (1, 5, 100, 3000, 20_000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.unique(np.concatenate((a[: int(share * len(a))], rng.integers(0, 1 << 64, n // 5 + 1, np.uint64))))
            bound = nearcopies.most_similar(nearcopies.bitmap(a), len(a), nearcopies.bitmap(b)[None], np.array([len(b)]))[0]
            assert bound >= nearcopies.jaccard(a, b)

import math
import random
import zlib

import numpy as np
import pytest


from strandwise.llm import quality

SCHEMA = "doc_id long, text string, score double, label int"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))]
        text = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "%%%", " |"]) for w in words)
        docs.append((i, text, 1.0, 0))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = quality.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97


def test_fit_is_the_textbook_discriminant(spark):
    rng = np.random.default_rng(2)
    d = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (60, d)), rng.normal(1, 2, (90, d))])
    y = np.repeat([0, 1], [60, 90])
    frame = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], [*quality.FEATURES, "y"])
    model = quality.fit(frame, "y", shrink=0.2, ridge=0.1)
    own = [np.cov(x[y == k].T) for k in (0, 1)]
    pooled = (own[0] * 59 + own[1] * 89) / 148
    want = np.log(90 / 60)
    for k, sign in ((1, 1), (0, -1)):
        cov = 0.9 * (0.8 * own[k] + 0.2 * pooled) + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        gap = x - x[y == k].mean(0)
        want = want - sign * 0.5 * ((gap @ np.linalg.inv(cov) * gap).sum(1) + np.linalg.slogdet(cov)[1])
    assert np.allclose(model.log_odds(x), want)


@pytest.mark.parametrize("text", [None, "", " \n\t", "x", "|" * 5000, "a " * 300_000])
def test_statistics_are_defined(text):
    assert all(map(math.isfinite, quality.statistics((text or "").encode())))


def test_chunks_do_not_change_statistics():
    text = ("the cat the cat sat | on \n" * 40_000).encode()
    short = quality.statistics(text[: 26 * 1000])
    assert np.allclose(quality.statistics(text)[8:10], short[8:10], atol=0.05)
    assert quality.statistics(b"b b " * 100_000)[8] == pytest.approx(math.asin(math.sqrt(199_999 / 200_000)))


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1), (1, None), (None, 0)], 1.0), ([(1, 0)], 0.0)])
def test_without_both_classes(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b", 0.0, 1), (None, None, 0.0, 1), (1, "a b", 0.0, 1)], SCHEMA)
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert [r.score for r in got] == [score] * 3
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.classify(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []


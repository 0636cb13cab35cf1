import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandwise.llm import suffixtree as st

SCHEMA = "doc_id long, text string, c int, ids string, base double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], SCHEMA)


def trains(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


class Brute:
    """The model, straight from its definition."""

    def __init__(self, rows, depth=5, least=2, divergence=0.2, alpha=8.0):
        self.depth, self.alpha = depth, alpha
        self.after = {(): Counter()}
        for i, t in rows:
            if trains(i):
                for s, w in self.steps(t):
                    for k in range(min(depth, len(s)) + 1):
                        self.after.setdefault(s[len(s) - k :], Counter())[w] += 1
        self.n = {s: sum(c.values()) for s, c in self.after.items()}
        self.total, self.z = self.n[()], self.n[()] + 0.1 * (len(self.after[()]) + 1)
        self.states = set()
        for s, c in self.after.items():
            if s:
                share = lambda t, w: self.after[t][w] / self.n[t]
                if sum(share(s, w) * math.log(share(s, w) / share(s[1:], w)) for w in c if c[w] >= least) >= divergence:
                    self.states.add(s)

    @staticmethod
    def steps(text):
        words = ["<begin>", *((text or "").encode().lower().split()), "<end>"]
        return [(tuple(words[max(0, j - 8) : j]), words[j]) for j in range(1, len(words))]

    def p(self, s, w):
        p = (self.after[()][w] + 0.1) / self.z
        for k in range(1, min(self.depth, len(s)) + 1):
            t = s[len(s) - k :]
            if t in self.states:
                p = (self.after[t][w] + self.alpha * p) / (self.n[t] + self.alpha)
        return p

    def row(self, i, text):
        steps = self.steps(text)
        held = i is not None and not trains(i)
        base = sum(math.log10((self.after[()][w] + 0.1) / self.z) for _, w in steps) if self.total else 0.0
        score = sum(math.log10(self.p(s, w)) for s, w in steps) if self.total else 0.0
        return i, held, len(steps), sum(w in self.after[()] for _, w in steps), self.total, round(base, 5), round(score, 5)


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    follow = {w: [rng.randrange(60) for _ in range(3)] for w in range(60)}
    rows = []
    for i in range(n):
        w, words = rng.randrange(60), []
        for _ in range(rng.randint(0, 120)):
            words.append(f"W{w}é" if rng.random() < 0.9 else f"rare{rng.randrange(9000)}")
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.randrange(60)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(n + i, rows[i * 7][1]) for i in range(9)] + [(n + 20 + i, "one two one two " * i) for i in range(12)]


ODD = [(None, "w1é alone"), (1000, None), (1001, ""), (1002, " \x0b\x0c\n"), (1003, "İ ÀB c  d"), (1004, "dup dup"), (1004, "dup dup"), (1005, "x " * 30_000)]


def scored(spark, rows, **options):
    got = st.score(frame(spark, rows), **options).collect()
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got), key=str)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=3e-5)


@pytest.mark.parametrize("options", [{}, {"depth": 1}, {"depth": 3, "divergence": 0.05, "alpha": 1.0}, {"least": 4}, {"depth": 0}])
def test_scores_are_those_of_the_definition(spark, options):
    rows = corpus() + ODD
    brute = Brute(rows, **options)
    same(scored(spark, rows, **options), sorted((brute.row(*r) for r in rows), key=str))


def test_longer_contexts_are_states(spark):
    brute = Brute(corpus())
    lengths = Counter(map(len, brute.states))
    assert all(lengths[k] for k in (1, 2, 3))


@pytest.mark.parametrize("change", [{"SLICE": 50}, {"PIECE": 16}, {"BUCKET": 4}, {"LEAST_HEAVY": 8, "HEAVY_PARTS": 60}, {"SLICE": 30, "PIECE": 9, "LEAST_HEAVY": 3, "HEAVY_PARTS": 60}])
def test_layout_does_not_change_scores(spark, monkeypatch, change):
    """Small slices, pieces of texts, many buckets, heavy contexts."""
    rows = corpus(80) + ODD[:-1] + [(1005, "x y " * 60)]
    for name, value in change.items():
        monkeypatch.setattr(st, name, value)
    brute = Brute(rows, depth=3)
    same(scored(spark, rows, depth=3), sorted((brute.row(*r) for r in rows), key=str))


def test_documents_that_occur_twice_stand_out(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(200)]
    rows += [(500 + i, rows[i][1]) for i in range(20)]
    gain = {r[0]: (r[6] - r[5]) / r[2] for r in scored(spark, rows)}
    again = [gain[500 + i] for i in range(20) if trains(500 + i) and trains(i)]
    assert min(again) > 0.5 + max(gain[i] for i in range(20, 200))


def test_held_out_text_is_likelier_than_under_the_base(spark):
    got = [r for r in scored(spark, corpus(1200)) if r[1] and r[2] > 20]
    assert sum(r[6] for r in got) > 0.8 * sum(r[5] for r in got) and len(got) > 50


def test_distributions_add_up_to_one():
    brute = Brute(corpus())
    words = [*brute.after[()], "<unseen>"]
    for s in random.Random(1).sample(sorted(brute.states, key=str), 40):
        assert sum(brute.p(("<other>", *s), w) for w in words) == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("rows", [[], [(10, None)], [(i, "a b") for i in range(300) if not trains(i)][:3]])
def test_nothing_to_learn_from(spark, rows):
    got = st.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    if len(rows) == 3:
        assert all(r.score == r.base_score == r.train_tokens == 0 for r in got)


def test_bad_parameters_are_refused(spark):
    for options in ({"least": 1}, {"divergence": 0.0}):
        with pytest.raises(ValueError):
            st.score(frame(spark, [(1, "a")]), **options)


def test_words_are_split_as_bytes_are():
    texts = [None, "", " a  B\tc\x0b\x0cd\r\ne ", "É x y", "\x1cz\x85w"]
    words, owner = st.split_words(pa.array(texts))
    want = [(i, w.decode()) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    assert list(zip(owner.tolist(), words.to_pylist())) == want
    words, owner = st.split_words(pa.array(["skipped words", *texts, "more"]).slice(1, len(texts)))
    assert list(zip(owner.tolist(), words.to_pylist())) == want


def test_arrays_of_a_bucket_are_freed_before_the_next(monkeypatch):
    """A kernel that is asked for the next bucket holds nothing of the one before."""
    import gc
    import weakref

    held, real = [], st._unpack

    class Part(list):
        pass

    def unpack(data):
        gc.collect()
        assert all(r() is None or r().bucket == data[0] for r in held)
        part = Part(real(data[1]))
        part.bucket = data[0]
        held.append(weakref.ref(part))
        return part

    monkeypatch.setattr(st, "_unpack", unpack)
    words = st._pack(st.np.array([3, 4], "u8"), st.np.array([1, 2]))
    monkeypatch.setattr(st, "_by_key", lambda batches, column: ((b, [(s, b, (b, words)) for s in range(3)]) for b in range(4)))
    found = list(st._lean(st._words_kernel(2))(iter([])))
    assert len(found) == 4 and len(held) == 12 and [b.column(3)[0].as_py() for b in found] == [9.0] * 4


def test_packed_integers_come_back_at_every_width():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, st._RUN - 1, st._RUN, 2 * st._RUN + 3):
        columns = [rng.integers(0, 1 << 8 * w, n, dtype=np.uint64) if w < 8 else rng.integers(0, 2**64 - 1, n, dtype=np.uint64) for w in range(1, 9)]
        got = st._unpack(st._pack(*columns))
        assert len(got) == 8 and all(np.array_equal(a, b) for a, b in zip(got, columns, strict=True))
    planes = np.frombuffer(bytes(range(1, 25)), np.uint8).reshape(3, 8)
    assert st._joined(planes).tolist() == [(i + 1) + (i + 9 << 8) + (i + 17 << 16) for i in range(8)]

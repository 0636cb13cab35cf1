import hashlib
import random

import numpy as np
import pytest

from strandwise.llm import suffixdedup as sd

SCHEMA = "doc_id long, text string, kind int, h string, spans int"


def brute(rows):
    """Directly from the definition, with a set of all strings of 100 bytes seen so far."""
    seen, out = set(), []
    for i, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        raw, gone = (text or "").encode(), np.zeros(len((text or "").encode()), bool)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        rest = bytes(np.frombuffer(raw, np.uint8)[~gone]) if raw else b""
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def run(spark, rows, **options):
    rng = random.Random(1)
    rows = list(rows)
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(frame, **options).collect())


def texts(seed, alphabet="abcdefgh", n=60):
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [fresh(rng.randint(30, 260)) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts.append(rng.choice([fresh(rng.randint(0, 90)), p, p[cut:], p[: len(p) - cut], p + p[:40]]))
        out.append("".join(parts))
    return out


EDGES = [None, "", "a" * 99, "a" * 100, "a" * 101, "b" * 350, "ab" * 200, "abc" * 90 + "d" + "abc" * 90, "é" * 120, "😀" * 60, "x" + "é" * 120]


@pytest.mark.parametrize("seed", range(3))
def test_against_the_definition(spark, seed):
    rows = list(enumerate(texts(seed) + EDGES + texts(seed)[:3]))
    assert run(spark, rows) == brute(rows)


def test_few_letters_repeat_a_lot(spark):
    rows = list(enumerate(texts(7, "ab", 25)))
    assert run(spark, rows) == brute(rows)


def test_small_slices_and_heavy_anchors(spark, monkeypatch):
    rows = list(enumerate(texts(4, n=40) + EDGES))
    want = brute(rows)
    monkeypatch.setattr(sd, "SLICE", 1 << 9)
    monkeypatch.setattr(sd, "_LOW", np.uint64((1 << 9) - 1))
    assert run(spark, rows) == want
    real = sd.runs_of
    grams = set()

    def spy(data, ends, poly, heavy):
        out = real(data, ends, poly, heavy)
        grams.update(out[0].tolist())
        return out

    for t in rows:
        raw = np.frombuffer((t[1] or "").encode(), np.uint8)
        if len(raw) >= 100 and len(raw) < 1 << 9:
            spy(raw, np.array([len(raw)]), sd.Polynomial(), None)
    heavy = sd.Heavy(np.array(sorted(grams)[::2], np.uint64))
    monkeypatch.setattr(sd, "runs_of", lambda data, ends, poly, _: real(data, ends, poly, heavy))
    assert run(spark, rows) == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(200))
    rows = [(5, t), (5, t), (9, "zz" + t)]
    got = run(spark, rows)
    assert got[0] == got[1] and got[0][2] == 0 and got[2][2] == len(t) and len(got) == 3
    assert run(spark, []) == []


def test_rows_without_an_id_are_left_alone(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(200))
    frame = spark.createDataFrame([(None, t, 1, "x", 2), (None, t + t, 1, "x", 2), (None, None, 1, "x", 2), (3, t, 1, "x", 2)], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.kept_sha256) for r in sd.remove_repeats(frame).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    n = len(t)
    assert got == sorted([(-1, 0, 0, sha("")), (-1, n, 0, sha(t)), (-1, 2 * n, 0, sha(t + t)), (3, n, 0, sha(t))])


def test_different_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    one, two, three = ("".join(rng.choice("abcdefgh") for _ in range(600)) for _ in range(3))
    rows = [(1, one), (2, one), (2, two), (2, two), (2, three + two), (3, three)]
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((r.doc_id, bytes(r.kept).decode()) for r in sd.remove_repeats(frame, with_text=True).collect())
    # which of the texts with id 2 comes first is up to their hashes
    assert got in (sorted([(1, one), (2, ""), (2, two), (2, two), (2, three), (3, "")]), sorted([(1, one), (2, ""), (2, ""), (2, ""), (2, three + two), (3, "")]))


@pytest.mark.parametrize("chunk", [1 << 14, 4])
def test_equal_hashes_of_different_strings_remove_nothing(spark, monkeypatch, chunk):
    """Hashes of three values only: nearly all runs meet, and nearly all comparisons collide."""
    rows = list(enumerate(texts(3, n=12) + EDGES))
    want = brute(rows)
    real = sd.Polynomial.spans
    monkeypatch.setattr(sd.Polynomial, "spans", lambda self, prefixes, start, size: real(self, prefixes, start, size) % np.uint64(3))
    monkeypatch.setattr(sd, "_mix", lambda x: x % np.uint64(5) * np.uint64(0x3333333333333333))
    monkeypatch.setattr(sd, "CHUNK", chunk)
    assert run(spark, rows) == want


def test_kept_text(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(200))
    frame = spark.createDataFrame([(1, t, 0, "", 0), (2, "<" + t + ">", 0, "", 0)], SCHEMA)
    got = {r.doc_id: bytes(r.kept).decode() for r in sd.remove_repeats(frame, with_text=True).collect()}
    assert got == {1: t, 2: "<>"}


def test_suffix_sort_orders_by_content():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    suffix = rng.integers(0, 3900, 1500)
    group = np.sort(rng.integers(0, 5, 1500))
    order = sd.SuffixSorter(data).sort(suffix, group)
    keys = [(int(group[i]), data[suffix[i] : suffix[i] + 100].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(1500))


def test_hash_collisions_are_verified(monkeypatch):
    data = np.frombuffer(b"".join(bytes([c]) * 100 for c in b"abcabc"), np.uint8)
    sorter = sd.SuffixSorter(data)
    monkeypatch.setattr(sorter.poly, "spans", lambda prefixes, start, size: np.zeros(len(start), np.uint64))
    suffix = np.arange(6) * 100
    order, label = sorter.classes(suffix, np.zeros(6, np.int64))
    classes = {}
    for i, c in zip(order.tolist(), label.tolist()):
        classes.setdefault(c, set()).add(i)
    assert sorted(map(sorted, classes.values())) == [[0, 3], [1, 4], [2, 5]]

import random
import re

import numpy as np
import pytest
import xxhash

from strandwise.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and bin(a ^ b).count("1") <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(40)] + ["Ünï", "İx", "A B"]
    texts = [None, "", " \n ", "One two", "one  TWO", "a b c d"]
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append("\t".join(near))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fp string, cell int, component_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = {i: brute_print(t) for i, t in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(list(prints.items()))
    assert len(got) == len(rows)


def test_cells_find_every_pair_within_four_bits():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        b = a.copy()
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        pair = np.concatenate([a, b]).view(np.int64)
        cells, owners = simhash.cells_of(pair)
        assert set(cells[owners == 0]) & set(cells[owners == 1])


def test_link_cells_keeps_chains_apart_and_together():
    prints = np.array([0, 0b1111, 0b11111111, (1 << 40) - 1], np.int64)
    cells = np.zeros(4, np.int64)
    a, b = simhash.link_cells(cells, prints, 4)
    assert set(zip(a.tolist(), b.tolist())) == {(15, 0), (255, 0)}


@pytest.mark.parametrize("lags", [1, 7, 256])
def test_large_cells_against_all_pairs(lags):
    rng = np.random.default_rng(lags)
    copies = np.zeros(400, np.uint64)
    for _ in range(3):
        copies ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    strays = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([copies, strays, strays[:20] ^ np.uint64(5)])).view(np.int64)
    rng.shuffle(prints)
    half = len(prints) // 2
    cells = np.repeat([3, 9], [half, len(prints) - half])
    a, b = simhash.link_cells(cells, prints, 4, lags)
    for part in (prints[:half], prints[half:]):
        want = brute_components([(int(p), int(p) % (1 << 64)) for p in sorted(part.tolist())])
        inside = set(part.tolist())
        got = {p: {p} for p in inside}
        for x, y in zip(a.tolist(), b.tolist()):
            if x in inside:
                got[x] |= got[y]
                for z in got[x]:
                    got[z] = got[x]
        assert {frozenset(g) for g in got.values()} == {frozenset(p for p in inside if want[p] == r) for r in set(want.values())}


@pytest.mark.parametrize("large,chunk", [(8192, 1 << 19), (3, 1 << 19), (3, 10), (9, 64)])
def test_cells_that_are_dealt_again_link_the_same(large, chunk):
    """Through both passes of the kernel, in batches of any size."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = [base]
    for _ in range(30):
        near = base.copy()
        for _ in range(rng.integers(1, 4)):
            near ^= np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)
        prints.append(near)
    prints = np.unique(np.concatenate(prints)).view(np.int64)

    def through(kernel, cells, values):
        order = np.lexsort((values, cells))
        batches = [pa.RecordBatch.from_arrays([pa.array(cells[order[i : i + 7]]), pa.array(values[order[i : i + 7]])], ["cell", "fp"]) for i in range(0, len(order), 7)]
        out = [np.zeros((3, 0), np.int64), *(np.array([c.to_numpy(zero_copy_only=False) for c in b.columns], np.int64) for b in kernel(iter(batches)))]
        return np.concatenate(out, axis=1)

    cells, owners = simhash.cells_of(prints)
    met = through(simhash._link_kernel(4, large, chunk), cells, prints[owners])
    passed = met[1:, met[0] == 1]
    assert passed.size or large == 8192
    again = through(simhash._link_kernel(4, None, chunk), *passed) if passed.size else np.zeros((3, 0), np.int64)
    links = np.concatenate([met[1:, met[0] == 0], again[1:]], axis=1)
    root = {int(p): int(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links.T.tolist():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = brute_components([(int(p), int(p) % (1 << 64)) for p in prints.tolist()])
    groups = lambda of: {frozenset(p for p in root if of(p) == r) for r in {of(p) for p in root}}
    assert groups(find) == groups(want.get)


def test_hubs_are_joined_apart(spark):
    from strandwise.llm.components import components

    rng = random.Random(4)
    edges = [(7, i) for i in range(100, 1300)] + [(i, 5000) for i in range(2000, 2700)] + [(rng.randrange(8000, 9000), rng.randrange(8000, 9000)) for _ in range(900)] + [(5000, 1299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b) if find(n) != n}


def test_long_text_in_chunks():
    text = " ".join("word%d" % (i % 977) for i in range(60_000))
    assert simhash.simhash(text.encode()) == brute_print(text)


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")]])
def test_empty_null_and_repeated_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all(r.component_id == 7 for r in got)

import itertools
import random
import re

import pytest

from strandwise.llm import decontamination as dec

DOCS, ITEMS = "doc_id long, text string, item_id string, seed int, words int", "item_id long, text string, at int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [w for w in ("".join(c for c in x if c.isalnum()) for x in WORD.findall((text or "").lower())) if w]


def brute(docs, items):
    """The most equal words in any 13 aligned positions, over all alignments."""
    found = {}
    for (i, a), (k, b) in itertools.product(docs, items):
        if i is None or k is None:
            continue
        a_, b_ = words(a), words(b)
        for shift in range(-len(a_), len(b_)):
            same = [0 <= p + shift < len(b_) and w == b_[p + shift] for p, w in enumerate(a_)]
            same = [False] * 12 + same + [False] * 12
            best = max((sum(same[p : p + 13]) for p in range(len(same) - 12)), default=0)
            if best >= 11:
                found[i, k] = max(best, found.get((i, k), 0))
    return found


def short(docs, items):
    """Items of five to ten words that occur whole."""
    found = {}
    for (i, a), (k, b) in itertools.product(docs, items):
        a_, b_ = words(a), words(b)
        at = [p for p in range(len(a_)) if a_[p : p + len(b_)] == b_]
        if i is not None and k is not None and 5 <= len(b_) <= 10 and at:
            found[i, k] = (len(b_), min(at[0], found.get((i, k), (0, 1 << 30))[1]))
    return found


def cases():
    rng = random.Random(11)
    vocab = ["wé%d" % i for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(11, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "a b c"), (None, "x y"), (3, "")]
    docs = [(0, None), (1, ""), (2, " \n"), (None, items[0][1]), (3, items[1][1]), (3, items[1][1])]
    for i in range(40):
        passage = words(items[rng.randrange(12)][1])
        passage = passage[rng.randint(0, 3) : len(passage) - rng.randint(0, 3)]
        for _ in range(rng.randint(0, 4)):
            passage[rng.randrange(len(passage))] = "changed"
        passage = [w + rng.choice(["", "", ",", "!!", " |"]) for w in passage]
        docs.append((10 + i, " ".join(text(rng.randint(0, 30)) + passage + text(rng.randint(0, 30))).upper()))
    return docs, items


def test_against_all_alignments(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    got = {(r.doc_id, r.item_id): r.matched for r in dec.overlaps(*frame).collect()}
    assert got == brute(docs, items) and len(got) > 20
    cut = {(r.doc_id, r.item_id): r.matched for r in dec.overlaps(*frame, piece=7, broadcast_rows=0).collect()}
    assert cut == got
    kept = dec.decontaminate(*frame).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in docs if i not in {d for d, _ in got})


def test_masks_are_lossless():
    for lost in itertools.combinations(range(13), 2):
        assert any(not {o + m for m in mask} & set(lost) for mask in dec.MASKS for o in range(13 - mask[-1]))


@pytest.mark.parametrize("side", [0, 1])
def test_empty_tables(spark, side):
    docs, items = cases()
    frame = [spark.createDataFrame([(1, docs[3][1], "x", 1, 2)][side == 0 :], DOCS), spark.createDataFrame([(1, items[0][1], 3)][side == 1 :], ITEMS)]
    assert dec.overlaps(*frame).collect() == []


def test_main_path_is_native(spark):
    frame = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    plan = dec.decontaminate(*frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_items_must_occur_whole(spark):
    items = [(1, "What is the capital of France?"), (2, "one two three four"), (3, "a b c d e"), (4, "w " * 10), (4, "q w e r t y"), (5, "one Two, three! four five six seven eight nine ten")]
    docs = [(1, "so: what is the capital of france"), (2, "what is the capital in france"), (3, "one two three four five six seven eight nine ten eleven"), (4, "x a b c d e a b c d e"), (5, None), (6, "w " * 40)]
    docs += [(7, "z " * 30 + "q w e r t y"), (None, "a b c d e"), (8, "what is the capital of"), (8, "of france what is the capital of france what")]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    for options in ({}, {"piece": 3}, {"piece": 7, "broadcast_rows": 0}):
        got = {(r.doc_id, r.item_id): (r.matched, r.first_word) for r in dec.overlaps(*frame, **options).collect()}
        assert got == short(docs, items) and (1, 1) in got and (6, 4) in got, options


def test_repeated_words_meet_once_a_diagonal(spark):
    docs, items = [(1, "the " * 3000), (2, "of " * 50 + "the " * 10)], [(1, "the " * 100), (2, "of " * 9 + "the " * 9)]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    assert {(r.doc_id, r.item_id): r.matched for r in dec.overlaps(*frame).collect()} == {(1, 1): 13, (2, 2): 13}

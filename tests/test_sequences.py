import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.functions import classes as C
from strandwise.functions import sequences as S


def brute_local(a, b):
    """Best local score by the plain recurrences."""
    ninf = float("-inf")
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[ninf] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[ninf] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i - 1][j] - 1, e[i - 1][j] - 0.5)
            f[i][j] = max(h[i][j - 1] - 1, f[i][j - 1] - 0.5)
            h[i][j] = max(0.0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("ACGT", max_size=14), st.text("ACGT", max_size=14))
def test_local_alignment(a, b):
    score, identity, cover_a, cover_b = S.align_local(a, b)
    assert score == brute_local(a, b)
    assert 0 <= identity <= 100 and 0 <= cover_a <= 100 and 0 <= cover_b <= 100


def test_alignment_figures():
    assert S.align_local("TTACGTACGTTT", "ACGTACG") == (14.0, 100.0, 58.33, 100.0)
    assert S.align_local("", "A") == (0.0, 0.0, 0.0, 0.0)


def brute_orfs(seq, least):
    out = []
    comp = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
    for sign, text in (("+", seq), ("-", "".join(comp[c] for c in reversed(seq)))):
        for frame in range(3):
            codons = [text[i : i + 3] for i in range(frame, len(text) - 2, 3)]
            run = 0
            for k, codon in enumerate([*codons, "TAA"]):
                if codon in ("TAA", "TAG", "TGA"):
                    if run * 3 >= least and run:
                        s = frame + (k - run) * 3
                        out.append((s + 1, s + run * 3, "+") if sign == "+" else (len(text) - s, len(text) - s - run * 3 + 1, "-"))
                    run = 0
                else:
                    run += 1
    return sorted(out)


@settings(max_examples=100, deadline=None)
@given(st.text("ACGTN", max_size=80))
def test_orfs(seq):
    assert sorted(S.find_orfs(seq, 9)) == brute_orfs(seq, 9)


TAILS = [
    ("C" * 40 + "A" * 12, ("A",), 10, 51), ("C" * 40 + "A" * 12 + "GG", ("A",), 10, 51), ("C" * 40 + "A" * 5 + "G" + "A" * 5, ("A",), 10, 50),
    ("C" * 40 + "A" * 5 + "G" + "A" * 3, ("A",), 10, None), ("A" * 12 + "C" * 60, ("A",), 10, None), ("C" * 60 + "TA" * 10, ("TA",), 10, 62),
    ("C" * 60 + "TA" * 12, ("TA",), 10, 66), ("C" * 60 + "T" * 11 + "A" * 11, ("T", "A"), 10, 70), ("A" * 60, ("A",), 10, None), ("", ("A",), 10, None), (None, ("A",), 10, None),
]


def test_poly_tail(spark):
    for patterns, least in {(p, n) for _, p, n, _ in TAILS}:
        mine = [(s, w) for s, p, n, w in TAILS if (p, n) == (patterns, least)]
        rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(mine)], "i int, s string")
        got = {r.i: r.t for r in rows.select("i", S.poly_tail(F.col("s"), patterns, least).alias("t")).collect()}
        assert got == {i: w for i, (_, w) in enumerate(mine)}


def runs_of_a(seq, least):
    """The nearest run to the end, by trying every place."""
    front = len(seq) - int(len(seq) // 2.5)
    for last in range(len(seq) - 1, front - 1, -1):
        if seq[last] != "A":
            continue
        for first in range(last, front, -1):
            run, other = seq[first : last + 1], [k for k, c in enumerate(reversed(seq[first : last + 1])) if c != "A"]
            whole = not other or len(other) == 1 and 5 <= other[0] < least
            if whole and len(run) >= least and seq[first - 1] != "A":
                return last
    return None


def test_poly_tail_against_every_place(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choices("ACG", (14, 1, 1), k=rng.randint(0, 70))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(seqs)), "i int, s string")
    got = {r.i: r.t for r in rows.select("i", S.poly_tail(F.col("s"), ("A",), 10).alias("t")).collect()}
    assert got == {i: runs_of_a(s, 10) for i, s in enumerate(seqs)} and sum(t is not None for t in got.values()) > 30


def test_long_sequences_align_in_little_memory():
    import tracemalloc

    rng = random.Random(3)
    a = "".join(rng.choice("ACGT") for _ in range(3000))
    b = a[500:1500] + a[1510:2600]
    tracemalloc.start()
    score, identity, left, right = S.align_local(a, b)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert right == 100.0 and identity > 99 and score == 2 * len(b) - 1 - 9 * 0.5


def test_columns(spark):
    rows = spark.createDataFrame([("ACGTNry", "acgt"), ("", "aa"), (None, None)], "a string, b string")
    got = rows.select(S.reverse_complement(F.col("a")).alias("r"), S.kmers(F.col("b"), 3).alias("k"), S.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert got[0].r == "ryNACGT" and got[0].k == ["acg", "cgt"] and got[0].j == pytest.approx(3 / 6)
    assert got[1].r == "" and got[1].k == [] and got[1].j == 0.0 and got[2].r is None


def test_reverse_complement_is_an_involution(spark):
    rng = random.Random(0)
    rows = spark.createDataFrame([("".join(rng.choice(S.LETTERS) for _ in range(50)),) for _ in range(20)], "s string")
    twice = S.reverse_complement(S.reverse_complement(F.col("s")))
    assert rows.where(twice != F.col("s")).count() == 0


def test_motifs(spark):
    seqs = ["xxxxxTGxxxx", "xxxTGxxxxxx", "xxxxxCAxxxx", "xxxTGCAxxxx", "xxxxxxxxxxx"]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = [tuple(r[0]) for r in rows.select(S.start_motif(F.col("s"), F.lit(5), ["TG", "CA"])).collect()]
    assert got == [("TG", True, 5), ("TG", True, 3), ("CA", False, 5), ("TG", True, 3), ("False", False, 5)]
    got = [tuple(r[0]) for r in rows.select(S.end_motif(F.col("s"), F.lit(7), ["TG"])).collect()]
    assert got == [("TG", True, 7), ("TG", True, 5), ("False", False, 7), ("TG", True, 5), ("False", False, 7)]
    helitron = spark.createDataFrame([("xxATCxxxCTAATx",)], "s string")
    got = helitron.select(S.start_motif(F.col("s"), F.lit(4), ["ATC"], helitron=True).alias("a"), S.end_motif(F.col("s"), F.lit(11), ["CTAAT"], helitron=True).alias("b")).first()
    assert (got.a.position, got.b.position) == (3, 12)
    assert rows.select(S.wrapped(F.lit("aaa bbb ccc"), 7)).first()[0] == "aaa bbb\nccc"


def test_classes_and_presets(spark):
    rows = spark.createDataFrame([("LTR/Gypsy",), ("DNA/unheard",), ("Retroposon",), ("",), (None,), ("RC/Helitron",)], "c string")
    assert [r[0] for r in rows.select(C.category(F.col("c"))).collect()] == ["LTR", "DNA-TIR", "Unknown", "Unknown", "Unknown", "Helitron"]
    assert [r[0] for r in rows.select(C.category(F.col("c"), True)).collect()][2] == "Non-LTR"
    own = C.PRESETS["divergent"].with_user(cons_thr=0.9, ext_step=None, min_seq_num=4)
    assert (own.cons_thr, own.ext_step, own.min_seq_num) == (0.9, 1500, 4)


def test_final_class_and_numbers(spark):
    rows = spark.createDataFrame([("LTR", "DNA", "(12)"), (None, "DNA", "7"), ("Unknown", "DNA", "x"), ("NaN", "DNA", "")], "n string, i string, p string")
    got = rows.select(S.final_class(F.col("n"), F.col("i")).alias("c"), S.plain_int(F.col("p")).alias("p")).collect()
    assert [(r.c, r.p) for r in got] == [("LTR", 12), ("DNA", 7), ("DNA", None), ("DNA", None)]


def test_local_alignments_together_are_as_alone():
    """Pairs of unlike lengths that advance together, empty ones among them."""
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choice("ACGT-") for _ in range(rng.choice([0, 1, 5, 30, 64]))) for _ in range(2)) for _ in range(120)]
    assert S.align_local_all(pairs, cells=300) == [S.align_local(a, b) for a, b in pairs]

"""Two-sided extension against planted boundaries; progressive alignment against what it must keep and beat."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import alignment as A
from strandwise.operators import extension as E
from strandwise.operators import progressive as P
from strandwise.operators.intervals import fetch
from strandwise.operators.scratch import written
from strandwise.operators.search import centre_star
from strandwise.plans import homology_queries as Q
from strandwise.plans import views

from .test_oracle import SF

tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SCHEMA = "query int, hit_id int, chrom string, start long, end long, strand string"


def dna(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def family(rng, n, size=150, rate=0.1, gaps=2):
    base, out = dna(rng, size), []
    for _ in range(n):
        s = "".join(rng.choice("acgt") if rng.random() < rate else c for c in base)
        for _ in range(gaps):
            i, k = rng.randrange(len(s)), rng.randint(1, 8)
            s = s[:i] + s[i + k :] if rng.random() < 0.5 else s[:i] + dna(rng, k) + s[i:]
        out.append(s)
    return out


def test_profiles_align_as_full_dynamic_programming():
    """Single sequences as profiles: the score of the alignment is the best of all."""
    rng = random.Random(1)
    code = lambda s: P._CODE[np.frombuffer(s.encode(), np.uint8)][None, :]
    for _ in range(40):
        a = dna(rng, rng.randint(1, 14))
        b = dna(rng, rng.randint(1, 14)) if rng.random() < 0.5 else a[rng.randint(0, len(a) - 1) :]
        left, right = P.align_profiles(code(a), code(b))
        assert [x for x in left if x >= 0] == list(range(len(a))) and [x for x in right if x >= 0] == list(range(len(b)))
        n, m = len(a), len(b)
        best = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(n + 1):
            for j in range(m + 1):
                if i or j:
                    down = best[i - 1][j] - (1.5 if j in (0, m) else 3.0) if i else -1e9
                    over = best[i][j - 1] - (1.5 if i in (0, n) else 3.0) if j else -1e9
                    pair = best[i - 1][j - 1] + (2.0 if a[i - 1] == b[j - 1] else -1.5) if i and j else -1e9
                    best[i][j] = max(down, over, pair)
        score, i, j = 0.0, 0, 0
        for x, y in zip(left, right):
            if x >= 0 and y >= 0:
                score += 2.0 if a[x] == b[y] else -1.5
                i, j = i + 1, j + 1
            elif x >= 0:
                score -= 1.5 if j in (0, m) else 3.0
                i += 1
            else:
                score -= 1.5 if i in (0, n) else 3.0
                j += 1
        assert score == pytest.approx(best[n][m])


def test_progressive_beats_the_star_on_families_with_gaps():
    rng = random.Random(2)
    for n in (2, 6, 20):
        seqs = family(rng, n)
        rows = P.align_progressive(seqs)
        assert [r.replace("-", "") for r in rows] == seqs and len({len(r) for r in rows}) == 1
        assert P.column_score(rows) > P.column_score(centre_star(seqs)) or n == 2
    assert P.align_progressive([]) == [] and P.align_progressive(["acgt"]) == ["acgt"] and P.align_progressive(["a", "a"]) == ["a", "a"]


def test_groups_aligned_together_are_as_alone():
    """In narrow bands, which are widened where they could miss the best alignment, and with many pairs at once."""
    rng = random.Random(8)
    code = lambda s: P._CODE[np.frombuffer(s.encode(), np.uint8)][None, :]
    pairs = []
    for _ in range(60):
        a = dna(rng, rng.randint(1, 60))
        k = rng.randint(0, len(a))
        pairs.append((code(a), code(dna(rng, rng.randint(1, 60)) if rng.random() < 0.4 else a[k:] + dna(rng, 20) + a[:k])))
    whole = [P.align_all_profiles([p], band=100)[0] for p in pairs]
    for (left, right), (x, y) in zip(P.align_all_profiles(pairs, band=1), whole, strict=True):
        assert left.tolist() == x.tolist() and right.tolist() == y.tolist()
    groups = [family(rng, rng.randint(1, 9), size=rng.randint(20, 90)) for _ in range(30)]
    assert P.align_many(groups) == [P.align_progressive(g) for g in groups]


def test_alignments_are_judged_as_by_the_operators(spark):
    """What is worked out over the letters of an alignment, against the operators over its cells."""
    rng = random.Random(9)
    limits = E.Limits(crop_window=20, window=20, buffer=15, columns=25)
    rows = []
    for g in range(40):
        aligned = P.align_progressive(family(rng, rng.randint(4, 12), size=rng.randint(15, 120), rate=rng.choice([0.05, 0.2, 0.6]))) if g else ["acgtn" * 30] * 6
        rows += [(f"m{g:02d}", i, "-" * (k := rng.choice([0, 0, len(s) // 3, len(s) - 2])) + s[k:]) for i, s in enumerate(aligned)]
    msa = spark.createDataFrame(rows, "msa_id string, seq_id int, seq string").cache()
    parts = A.cells(msa)
    masked = A.mask_rare(parts, A.column_counts(parts), limits.rare)
    kept = A.gap_filter(A.column_counts(masked), limits.gap, limits.check, limits.similarity, limits.least)
    kept = kept.join(A.usable(kept, limits.columns).where("usable").select("msa_id"), "msa_id")
    cells = A.keep_columns(masked, kept)
    crop = A.crop_gaps(cells, limits.crop_gap, limits.crop_window)
    bounds = A.consensus_boundary(A.column_counts(A.apply_crop(cells, crop)), limits.window, limits.ambiguous, limits.threshold, limits.least, limits.buffer)
    old = {}
    for r in kept.collect():
        old.setdefault(r.msa_id, {})[r.new_col] = r.old_col
    seqs = {(m, i): s for m, i, s in rows}
    around, want = {r.msa_id: r for r in bounds.collect()}, {}
    for r in crop.collect():
        b, size = around[r.msa_id], len(old[r.msa_id])
        low, high = (0, 0) if b.stop else (old[r.msa_id][b.start], old[r.msa_id][b.end - 1] + 1)
        letters = [sum(c != "-" for c in seqs[r.msa_id, r.seq_id][:k]) for k in (low, high)]
        want[r.msa_id, r.seq_id] = (size - (r.end - r.start) <= limits.large * size, b.extend_left, b.extend_right, b.stop, 0 if b.stop else b.end - b.start, *letters)
    got = {(r[0], r[1]): tuple(r[2:]) for r in E._judged(msa, limits, limits.window, limits.ambiguous, limits.buffer).collect()}
    assert got == want and 5 < len(around) < 40 and {x[3] for x in want.values()} == {x[0] for x in want.values()} == {True, False}


def test_guide_tree_joins_the_nearest_first():
    d = np.array([[0, 5, 1, 5], [5, 0, 5, 2], [1, 5, 0, 5], [5, 2, 5, 0]], float)
    assert P.guide_tree(d) == [(0, 2), (1, 3), (4, 5)]


def test_align_groups(spark):
    rows = [("m", 1, "ACGTACGTAA"), ("m", 2, "ACGTCGTAA"), ("n", 1, "AA"), ("n", 2, None), ("n", 3, ""), (None, 1, "ACGN")]
    got = {(r.msa_id, r.seq_id): r.seq for r in P.align(spark.createDataFrame(rows, "msa_id string, seq_id int, seq string")).collect()}
    assert got == {("m", 1): "acgtacgtaa", ("m", 2): "acgt-cgtaa", ("n", 1): "aa", (None, 1): "acgn"}


@tables
def test_boundaries_are_the_planted_ones(spark):
    """Inner parts of copies with substitutions, a deletion and an insertion, some with foreign left ends."""
    copies = {r.copy: r for r in views.planted_copies(spark, SF, foreign=9).collect()}
    got = Q.extended_elements(spark, SF).collect()
    left, right = {}, {}
    for r in got:
        c = copies[r.hit_id]
        ends = (r.start - c.start, r.end - c.end) if c.strand == "+" else (c.end - r.end, c.start - r.start)
        left[r.hit_id], right[r.hit_id] = ends
    own = [k for k in left if k % 9]
    assert len(own) >= 0.95 * sum(k % 9 > 0 for k in copies)
    assert np.mean([abs(left[k]) <= 10 for k in own]) >= 0.9 and np.mean([abs(right[k]) <= 10 for k in own]) >= 0.9
    assert {r.rounds for r in got} <= {2, 3}


def test_state_and_limits(spark):
    """Chromosome ends, elements without enough hits, a chromosome that the genome lacks, a side that never ends."""
    rng = random.Random(4)
    core = dna(rng, 2000).upper()
    genome = [(f"c{i}", "".join(rng.choice("ACGT") if rng.random() < 0.05 else x for x in core)) for i in range(8)]
    hits = [(1, i, f"c{i}", 900, 1000, "-" if i % 2 else "+") for i in range(8) if i % 2 == 0] + [(1, i, f"c{i}", 900, 1000, "+") for i in range(8) if i % 2]
    hits += [(2, i, f"c{i}", 40, 140, "+") for i in range(8)] + [(3, i, f"c{i}", 10, 90, "+") for i in range(3)] + [(4, 0, "absent", 1, 50, "+"), (None, 1, "c1", 1, 5, "+")]
    limits = E.Limits(step=100, longest=350, crop_window=40, window=40, buffer=15, columns=30)
    spans, sides = E.extend_ends(spark.createDataFrame(hits, SCHEMA), spark.createDataFrame(genome, "chrom string, seq string"), limits)
    at = {(r["query"], r.side): r for r in sides.collect()}
    reach = {(r["query"], r.hit_id): (r.start, r.end) for r in spans.collect()}
    assert set(q for q, _ in at) == {1, 2, 3} and all(at[3, s].rounds == 0 and not at[3, s].to_longest for s in ("left", "right"))
    assert all(at[1, s].rounds == 4 and at[1, s].to_longest and at[1, s].extension == 360 for s in ("left", "right"))
    assert all(reach[1, i] == (540, 1360) for i in range(8)) and all(reach[3, i] == (10, 90) for i in range(3))
    assert at[2, "left"].rounds <= 2 and all(reach[2, i][0] == 0 and reach[2, i][1] == 500 for i in range(8))
    assert spans.count() == 19


def test_windows_follow_strand_and_round(spark):
    limits = E.Limits(step=100)
    rows = spark.createDataFrame([("left", "+"), ("left", "-"), ("right", "+"), ("right", "-")], "side string, strand string")
    one = E.next_window(F.col("side"), F.col("strand"), F.lit(500), F.lit(600), limits, 1)
    got = {(r.side, r.strand): (r.a, r.b) for r in rows.select("side", "strand", one[0].alias("a"), one[1].alias("b")).collect()}
    assert got == {("left", "+"): (410, 521), ("right", "-"): (410, 521), ("left", "-"): (579, 690), ("right", "+"): (579, 690)}


def test_windows_are_cut_before_they_are_grouped(spark):
    """Whole tiles are not sorted with the windows of them, one for each window."""
    places = spark.createDataFrame([("c", 1, 5, "+")], "chrom string, start long, end long, strand string")
    plan = fetch(places, spark.createDataFrame([("c", "ACGTACGT")], "chrom string, seq string"))._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "collect_list" in line]
    assert grouped and not any("_part" in line for line in grouped)


def test_shuffle_files_go_with_the_write(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    written(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
    assert files.getAllFiles().size() <= before

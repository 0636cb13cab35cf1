import random

import pytest
from pyspark.sql import functions as F

from strandwise.operators import search as S
from strandwise.plans import workflows as W

COMP = str.maketrans("ACGT", "TGCA")


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_search_finds_both_strands(spark):
    rng = random.Random(1)
    q = dna(rng, 120)
    near = list(q)
    near[60] = "A" if near[60] != "A" else "C"
    subject = dna(rng, 50) + "".join(near) + dna(rng, 40) + q.translate(COMP)[::-1] + dna(rng, 30)
    rows = S.search_approximate(spark.createDataFrame([("q", q)], "name string, seq string"), spark.createDataFrame([("c", subject)], "chrom string, seq string")).collect()
    got = {(r.sstrand, r.qstart, r.qend, r.sstart, r.send, r.length) for r in rows}
    assert got == {("plus", 1, 120, 51, 170, 120), ("minus", 1, 120, 330, 211, 120)}
    assert {r.sstrand: r.pident for r in rows} == {"plus": pytest.approx(99.167), "minus": 100.0}


def test_self_search(spark):
    rng = random.Random(2)
    unit = dna(rng, 200)
    rows = S.self_search_approximate(spark.createDataFrame([("x", unit + dna(rng, 100) + unit)], "name string, seq string")).collect()
    assert [(r["query"], r.qstart, r.qend, r.sstart, r.send, r.ordinal) for r in rows] == [("x", 1, 200, 301, 500, 1)]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_frequent_seeds_lose_nothing(spark, monkeypatch, hot):
    """A unit that the subjects hold many times, with its k-mers dealt in salted shares."""
    real = S._seeds
    monkeypatch.setattr(S, "_seeds", lambda q, s, own: real(q, s, own, hot))
    rng = random.Random(9)
    unit = dna(rng, 80)
    subjects = [(f"c{i}", dna(rng, 20) + unit + dna(rng, 20) + unit) for i in range(6)]
    rows = S.search_approximate(spark.createDataFrame([("u", unit)], "name string, seq string"), spark.createDataFrame(subjects, "chrom string, seq string"), least=80)
    assert {(r.sseqid, r.sstart, r.send, r.pident) for r in rows.collect()} >= {(f"c{i}", a, a + 79, 100.0) for i in range(6) for a in (21, 121)}
    few = S.search_approximate(spark.createDataFrame([("u", unit)], "name string, seq string"), spark.createDataFrame(subjects, "chrom string, seq string"), least=80, frequent=3)
    assert few.collect() == []


def test_centre_star_keeps_sequences():
    rng = random.Random(3)
    base = dna(rng, 60).lower()
    seqs = [base, base[:20] + base[25:], base[:30] + "ttt" + base[30:], base[5:50]]
    out = S.centre_star(seqs)
    assert [s.replace("-", "") for s in out] == seqs and len({len(s) for s in out}) == 1
    same = sum(len(set(col) - {"-"}) == 1 for col in zip(*out))
    assert same >= 55


def test_align_approximate(spark):
    rows = [("m", 1, "ACGTACGT"), ("m", 2, "ACGACGT"), ("n", 1, "AA")]
    got = {(r.msa_id, r.seq_id): r.seq for r in S.align_approximate(spark.createDataFrame(rows, "msa_id string, seq_id int, seq string")).collect()}
    assert got["n", 1] == "aa" and got["m", 1] == "acgtacgt" and got["m", 2].replace("-", "") == "acgacgt" and len(got["m", 2]) == 8


def test_benchmark(spark):
    t = "chrom string, start long, end long, type string"
    q = spark.createDataFrame([("c", 0, 100, "LTR"), ("c", 90, 140, "DNA"), ("c", 200, 250, "LTR")], t)
    r = spark.createDataFrame([("c", 0, 140, "LTR"), ("c", 300, 310, "DNA")], t)
    out = W.benchmark_annotations(q, r, spark.createDataFrame([("c", 400)], "chrom string, length long"))
    lengths = {(x["query"], x.reference): x.length for x in out["lengths"].collect()}
    assert lengths["LTR", "LTR"] == 100 and lengths["DNA", "LTR"] == 39 and lengths["LTR", "Not-TE"] == 50
    metrics = {x["class"]: x for x in out["metrics"].collect()}
    assert set(metrics) == {"LTR", "DNA", "All-TE"}
    assert (metrics["LTR"].tp, metrics["LTR"].fp, metrics["LTR"].fn) == (100, 50, 40) and metrics["DNA"].fdr == 1


def test_cluster_alignment(spark):
    rng = random.Random(4)
    a, b = dna(rng, 120).lower(), dna(rng, 120).lower()
    rows = [(1, i, a if i < 20 else b) for i in range(24)] + [(2, i, a) for i in range(4)]
    got = {(r.msa_id, r.seq_id): r.label for r in W.cluster_alignment(spark.createDataFrame(rows, "msa_id int, seq_id int, seq string")).collect()}
    assert len({got[1, i] for i in range(20)}) == 1 and len({got[1, i] for i in range(20, 24)}) == 1 and got[1, 0] != got[1, 23]
    assert {got[2, i] for i in range(4)} == {0}


def test_clean_alignment(spark):
    rng = random.Random(6)
    core = dna(rng, 150).lower()
    rows = [(1, i, dna(rng, 30).lower() + core + "-" + dna(rng, 30).lower()) for i in range(12)]
    out, mapping = W.clean_alignment(spark.createDataFrame(rows, "msa_id int, seq_id int, seq string"), window=20)
    seqs = [r.seq for r in out.collect()]
    assert len(seqs) == 12 and all(core[25:125] in s for s in seqs)
    assert mapping.agg(F.max("new_col")).first()[0] == len(seqs[0])


def test_library_and_folders(spark):
    cols = "cluster int, name int, evaluation string, length long, te_class string, low_copy boolean"
    rows = [(1, 1, "Good", 5, "LTR", False), (1, 2, "Perfect", 3, "LTR", False), (2, 3, "Need_check", 9, "DNA", False), (2, 4, "Need_ext", 7, "DNA", False)]
    members = spark.createDataFrame(rows, cols)
    second = spark.createDataFrame([(3, 77), (4, 77)], "name int, cluster int")
    assert {r.name for r in W.merge_library(members, second).collect()} == {2, 3}
    got = {r.cluster: (r["rank"], r.folder) for r in W.curation_clusters(members, F.col("length") / 100).collect()}
    assert got == {2: (1, "Cluster1_Need_check_DNA_9.00%"), 1: (2, "Cluster2_Perfect_LTR_5.00%")}


def test_one_island_of_many_intervals_is_resolved(spark, monkeypatch):
    """An island over many bins against the rule worked out in order."""
    rng = random.Random(12)
    monkeypatch.setattr(W.I, "BIN", 64)
    rows = [(s, s + rng.randint(2, 30), rng.choice("ABC")) for s in (rng.randrange(4000) for _ in range(1500))] + [(9000, 9010, "A"), (9005, 9020, "A"), (9500, 9510, None)]
    got = sorted((r.start, r.end, r.type) for r in W.resolved(spark.createDataFrame([("c", *r) for r in rows], "chrom string, start long, end long, type string")).collect() if r.type)
    islands, want = [], [(9000, 9020, "A")]
    for r in sorted(r for r in rows if r[2]):
        if islands and r[0] <= max(x[1] for x in islands[-1]):
            islands[-1].append(r)
        else:
            islands.append([r])
    for island in (i for i in islands if i[0][0] < 9000):
        if len({t for _, _, t in island}) == 1:
            want.append((island[0][0], max(x[1] for x in island), island[0][2]))
            continue
        free = [r for i, r in enumerate(island) if not any(j != i and o[0] <= r[0] and r[1] <= o[1] for j, o in enumerate(island))]
        last = None
        for s, e, t in free:
            start = s if last is None else last + 1
            if start < e:
                want.append((start, e, t))
            last = e
    assert got == sorted(want)


def test_mean_jaccard_without_pairs(spark):
    from itertools import combinations

    from strandwise.operators import clustering as L

    rng = random.Random(13)
    rows = [(g, i, rng.choice([None, "", "A", "ACGTN", "acg"]) if rng.random() < 0.2 else dna(rng, rng.randint(1, 9))) for g in range(6) for i in range(rng.randint(0, 60))] + [(9, 1, "ACGT")]
    sets = lambda s: {s.upper()[i : i + 2] for i in range(len(s) - 1)} if s else set()
    want = {}
    for g in range(6):
        pairs = [len(a & b) / len(a | b) if a and b else 0.0 for a, b in combinations([sets(s) for h, _, s in rows if h == g], 2)]
        if pairs:
            want[g] = pytest.approx(sum(pairs) / len(pairs), abs=1e-9)
    got = L.jaccard_pairs(spark.createDataFrame(rows, "g int, o int, s string"), "g", "o", "s")
    assert {r.g: r.similarity for r in got.collect()} == want and "Join" not in got._jdf.queryExecution().toString()


def test_scratch_tables_go_at_once(spark):
    from strandwise.operators import scratch

    table = scratch.written(spark.range(3).toDF("id"))
    assert table.count() == 3 and scratch.run_folder(spark).split(":")[-1].lstrip("/") in table.inputFiles()[0]
    other = scratch.shared_folder(spark)
    assert other.startswith(scratch.run_folder(spark)) and other != scratch.shared_folder(spark)

import gzip

import pytest
from pyspark.sql import functions as F

from strandwise.operators import scratch
from strandwise.sources import readers as R
from strandwise.sources import writers as W


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


LIB = ">fam-1#LTR/Gypsy some words\nACGT\nNNAC\n>fam:1#DNA/hAT\nTTT\n\n>plain\nGG\n>a/b c\nCC\n"


def test_library(spark, tmp_path):
    got = [(r.name, r.te_class, r.description, r.seq) for r in R.library(spark, put(tmp_path, "l.fa", LIB)).orderBy("ordinal").collect()]
    assert got == [
        ("fam_1", "LTR/Gypsy", "some words", "ACGTNNAC"), ("fam_1_n2", "DNA/hAT", "", "TTT"), ("plain", "Unknown", "", "GG"), ("a_b", "Unknown", "c", "CC"),
    ]


def test_gzip_and_later_copy_wins(spark, tmp_path):
    path = tmp_path / "g.fa.gz"
    with gzip.open(path, "wt") as f:
        f.write(">x#1\nAC\n>x#2\nGT\n>y\nT\n")
    got = R.first_by_name(R.fasta(spark, f"file://{path}")).collect()
    assert {(r.key, r.seq) for r in got} == {("x", "GT"), ("y", "T")}


def test_genome_and_lengths(spark, tmp_path):
    genome = R.genome(spark, put(tmp_path, "c.fa", ">chr1 x\nacgtRYK\nNN\n>chr2\nA\n"))
    assert [(r.chrom, r.seq) for r in genome.orderBy("ordinal").collect()] == [("chr1", "ACGTNNNNN"), ("chr2", "A")]
    assert {(r.chrom, r.length) for r in R.lengths_of(genome).collect()} == {("chr1", 9), ("chr2", 1)}
    assert [tuple(r) for r in R.lengths(spark, put(tmp_path, "l.tsv", "a\t5\nb\t7\n")).collect()] == [("a", 5), ("b", 7)]


def test_hits(spark, tmp_path):
    line = "q\ts\t91.5\t200\t3\t0\t1\t200\t900\t701\tminus\t1e-50\t88"
    got = R.hits(spark, put(tmp_path, "h.tsv", line + "\n")).first()
    assert (got.pident, got.sstart, got.evalue, got.qcovhsp) == (91.5, 900, 1e-50, 88)
    blank = put(tmp_path, "h.txt", "qseqid sseqid pident\n  " + line.replace("\t", "   ") + "\nshort line\n")
    assert R.hits_by_blanks(spark, blank).collect() == [got]


def test_bed(spark, tmp_path):
    got = R.bed(spark, put(tmp_path, "b.bed", "#c\nc1\t1\t9\tn\t0\t-\nc1\t1\n")).collect()
    assert [tuple(r) for r in got] == [("c1", 1, 9, "n", "0", "-")]


def test_repeats_and_track(spark, tmp_path):
    text = (
        "   SW   perc perc perc  query\nscore   div. del. ins.  sequence\n\n"
        "  463   1.3  0.6  1.7  chr1   10  60 (940) + famA LTR/Copia 1 50 (0) 1\n"
        "  12   11.5  0.0  0.0  chr1   80  70 (930) C famB DNA/hAT (5) 40 1 2\nbad line\n"
    )
    rows = R.repeats(spark, put(tmp_path, "r.out", text))
    got = rows.orderBy("score").collect()
    assert [(r.score, r.perc_div, r.query_left, r.strand, r.repeat_start) for r in got] == [(12, 11.5, 930, "-", 5), (463, 1.3, 940, "+", 1)]
    assert [tuple(r) for r in R.track(rows, F.lit("x")).collect()] == [("chr1", 10, 60, "x", 50, "+")]


def test_clusters(spark, tmp_path):
    text = ">Cluster 0\n0\t4770nt, >TE_1#LTR/Gypsy... *\n1\t4769nt, >scaf..5#x... at 1:4770:5:99/-/99.72%\n>Cluster 1\n0\t33nt, >odd... what\n"
    got = {tuple(r) for r in R.clusters(spark, put(tmp_path, "c.clstr", text)).collect()}
    assert got == {("Cluster0", 4770, "TE_1", "standard", "+"), ("Cluster0", 4769, "scaf..5", "99.72%", "-"), ("Cluster1", 33, "odd", None, None)}


def test_alignment(spark, tmp_path):
    got = R.alignment(spark, put(tmp_path, "m.fa", ">s1 x\nac-tR\n>s2\nGGGGG\n")).orderBy("seq_ord").collect()
    assert [tuple(r) for r in got] == [("m.fa", "s1", 1, "AC-T-"), ("m.fa", "s2", 2, "GGGGG")]


def test_tree(spark):
    got = {(r.a, r.b): round(r.d, 6) for r in R.tree_distances(spark, "((a:1,b:2):0.5,c:3,(d:1):1);").collect()}
    assert got == {("a", "b"): 3, ("a", "c"): 4.5, ("b", "c"): 5.5, ("a", "d"): 3.5, ("b", "d"): 4.5, ("c", "d"): 5}


def test_headers_to_bed(spark):
    rows = spark.createDataFrame([("c:1:10-20(+)",), ("c:1:10-20(+)",), ("no",), ("x:5-6(-) t",)], "header string")
    assert {tuple(r) for r in R.headers_to_bed(rows).collect()} == {("c:1", 10, 20, ".", "0", "+"), ("x", 5, 6, ".", "0", "-")}


def test_tables_and_summary(spark, tmp_path):
    text = "TE_name\torf_start\torf_end\tdirection\torf_name\na\t1\t9\t+\tORF1\na\t1\t9\t+\tORF1\n"
    assert R.table(spark, put(tmp_path, "o.tsv", text), R.ORFS).count() == 1
    names = [f.split()[0] for f in R.SUMMARY.split(", ")]
    rows = spark.createDataFrame([("in1", None, 5)], "input_name string, output_name string, input_length long")
    full = rows.select(*(F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names))
    W.to_summary(full, f"file://{tmp_path}/sum")
    got = R.summary(spark, f"file://{tmp_path}/sum").first()
    assert (got.input_name, got.output_name, got.input_length) == ("in1", None, 5) and len(got) == 29
    assert R.summary(spark, f"file://{tmp_path}/sum", keep_text=True).first().output_name == "NaN"


def test_kmer_index(spark):
    rows = spark.createDataFrame([("c", "ACGTA"), ("s", "AC")], "chrom string, seq string")
    assert {tuple(r) for r in R.kmer_index(rows, 3).collect()} == {("c", 0, "ACG"), ("c", 1, "CGT"), ("c", 2, "GTA")}


@pytest.mark.parametrize("wrap", [None, 4])
def test_fasta_round_trip(spark, tmp_path, wrap):
    rows = spark.createDataFrame([("a", "LTR", "ACGTACGTA"), ("b", "DNA", "TT")], "name string, te_class string, seq string")
    W.to_fasta(rows.coalesce(1), f"file://{tmp_path}/out{wrap}", wrap=wrap)
    got = R.fasta(spark, f"file://{tmp_path}/out{wrap}").collect()
    assert {(r.header, r.seq) for r in got} == {("a#LTR", "ACGTACGTA"), ("b#DNA", "TT")}


def test_folders_and_coverage(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Good"), ("b", "Perfect")], "name string, evaluation string")
    W.to_folders(rows, f"file://{tmp_path}/grades")
    assert sorted(p.name for p in (tmp_path / "grades").glob("eval*")) == ["evaluation=Good", "evaluation=Perfect"]
    cells = spark.createDataFrame([(1, 3, 9, 2, 7), (1, 3, 9, 1, 5)], "q int, start int, end int, pos int, depth int")
    assert cells.groupBy("q").agg(W.coverage_struct().alias("c")).first().c.coverage == [5, 7]


def test_a_record_over_many_splits(spark, tmp_path):
    """One record of many lines is read by many tasks; records, tiles and blank lines are what the other reader sees."""
    import random

    from strandwise.sources import tiled

    rng = random.Random(3)
    seqs = {"long one": "".join(rng.choice("ACGTN") for _ in range(300_000)), "empty": "", "short x": "ACG", "odd": "AC G\tT", "last": "".join(rng.choice("acgt") for _ in range(1001))}
    lines = ["skipped before the first header"]
    for name, s in seqs.items():
        lines += [f">{name}", *(s[i : i + 60] for i in range(0, len(s), 60)), ""]
    path = put(tmp_path, "big.fa", "\n".join(lines))
    put(tmp_path, "other.fa", ">second file\nTTT\nA\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        got = tiled.fasta_tiles(spark, path.rsplit("/", 1)[0], tile=1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    parts = {}
    for r in sorted(got, key=lambda r: (r.file, r.record, r.tile)):
        parts.setdefault((r.file.rsplit("/", 1)[1], r.record, r.header, r.length), []).append(r)
    want = {("big.fa", i, n, len(s.replace(" ", "").replace("\t", ""))): s.replace(" ", "").replace("\t", "") for i, (n, s) in enumerate(seqs.items())} | {("other.fa", 0, "second file", 4): "TTTA"}
    assert {k: "".join(r.part for r in rows) for k, rows in parts.items()} == want
    assert all(r.first == 1000 * r.tile == 1000 * i and (len(r.part) == 1000 or r is rows[-1]) for rows in parts.values() for i, r in enumerate(rows))


def test_distinct_rows_are_found_by_tasks_that_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    lines = [f"te{i % 30}\t{i % 30}\t\t+\tORF1" for i in range(60)]
    found = R.table(spark, put(tmp_path, "t.tsv", "\n".join(["a\tb\tc\td\te", *lines]) + "\n"), R.ORFS)
    assert found.rdd.getNumPartitions() == 6 and len(found.collect()) == 30

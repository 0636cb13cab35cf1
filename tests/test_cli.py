import random

from strandwise.__main__ import main
from strandwise.sources import readers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def rows(spark, path):
    return [r.seq for r in readers.fasta(spark, path).orderBy("ordinal").collect()]


def test_gap_commands(spark, tmp_path):
    msa = put(tmp_path, "m.fa", "".join(f">s{i}\n{s}\n" for i, s in enumerate(["AC--GT", "AC--GT", "AC-TGT", "AC--GT", "ACT-GT", "A---GT"])))
    main(["remove-gaps", "-i", msa, "-o", f"file://{tmp_path}/a"])
    assert rows(spark, f"file://{tmp_path}/a") == ["acgt"] * 5 + ["a-gt"]
    main(["crop-gaps", "-i", msa, "-o", f"file://{tmp_path}/b", "-ws", "2", "-thr", "0"])
    assert rows(spark, f"file://{tmp_path}/b")[5] == "----gt"
    main(["crop-divergence", "-i", msa, "-o", f"file://{tmp_path}/c", "-ws", "2", "-thr", "0.9"])
    assert rows(spark, f"file://{tmp_path}/c")[0] == "ac--gt"


def test_benchmark(spark, tmp_path):
    line = "463 1.3 0.6 1.7 c {} {} (940) + fam {} 1 50 (0) 1\n"
    q = put(tmp_path, "q.out", line.format(0, 100, "LTR/Copia") + line.format(300, 350, "DNA/hAT"))
    r = put(tmp_path, "r.out", line.format(50, 120, "LTR/Gypsy"))
    main(["benchmark", "-q", q, "-r", r, "-gl", put(tmp_path, "l.tsv", "c\t1000\n"), "-o", f"file://{tmp_path}/out"])
    got = spark.read.csv(f"file://{tmp_path}/out/lengths", sep="\t", header=True, inferSchema=True).collect()
    assert {(x["query"], x.reference): x.length for x in got}["LTR", "LTR"] == 50
    assert {x["class"] for x in spark.read.csv(f"file://{tmp_path}/out/metrics", sep="\t", header=True).collect()} == {"LTR", "DNA-TIR", "All-TE"}


def test_separate(spark, tmp_path):
    rng = random.Random(1)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    end, inner = dna(200), dna(500)
    main(["separate-ltr", "-i", put(tmp_path, "l.fa", f">x#LTR d\n{end}{inner}{end}\n>y\n{dna(400)}\n"), "-o", f"file://{tmp_path}/out"])
    got = {r.header: r.seq for r in readers.fasta(spark, f"file://{tmp_path}/out").collect()}
    assert got["x_LTR#LTR"] == end and got["x_INT#LTR"] == inner and len(got["y"]) == 400

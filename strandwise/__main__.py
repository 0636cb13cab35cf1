"""Command line: ``python -m strandwise COMMAND ...`` reads and writes the text formats through Spark.

benchmark        compare two repeat annotations over a genome
remove-gaps      drop gap columns of an alignment
crop-gaps        crop gappy ends of an alignment's rows
crop-divergence  crop divergent ends of an alignment's rows
separate-ltr     split sequences with direct terminal repeats
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.classes import category
from strandwise.operators import alignment as A
from strandwise.operators import hits as H
from strandwise.operators import search
from strandwise.plans.workflows import benchmark_annotations
from strandwise.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandwise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    b = commands.add_parser("benchmark")
    b.add_argument("-q", "--query", required=True)
    b.add_argument("-r", "--reference", required=True)
    b.add_argument("-gl", "--genome_length", required=True, help="table of names and lengths")
    b.add_argument("-o", "--output_dir", required=True)
    b.add_argument("-lc", "--less_classification", action="store_true")
    g = commands.add_parser("remove-gaps")
    g.add_argument("--gap_threshold", type=float, default=0.8)
    g.add_argument("--simi_check_gap_thr", type=float, default=0.4)
    g.add_argument("--similarity_thr", type=float, default=0.7)
    g.add_argument("--min_nucleotide", type=int, default=5)
    c = commands.add_parser("crop-gaps")
    c.add_argument("-thr", "--gap_threshold", type=float, default=0.05)
    c.add_argument("-ws", "--window_size", type=int, default=300)
    d = commands.add_parser("crop-divergence")
    d.add_argument("-thr", "--threshold", type=float, default=0.8, help="share of the window")
    d.add_argument("-ws", "--window_size", type=int, default=20)
    s = commands.add_parser("separate-ltr")
    for p in (g, c, d, s):
        p.add_argument("-i", "--input_file", required=True)
        p.add_argument("-o", "--output_dir", required=True)
    return top


def _write_rows(msa: DataFrame, out: DataFrame, path: str) -> None:
    order = msa.select("seq_id", "seq_ord")
    rows = out.join(order, "seq_id").orderBy("seq_ord").select(F.col("seq_id").alias("name"), "seq")
    writers.to_fasta(rows, path, header=F.col("name"))


def run(spark: SparkSession, o: argparse.Namespace) -> None:
    if o.command == "benchmark":
        kind = category(F.col("repeat_class"), o.less_classification)
        tracks = [readers.track(readers.repeats(spark, p), kind).select("chrom", "start", "end", "type") for p in (o.query, o.reference)]
        for name, table in benchmark_annotations(*tracks, readers.lengths(spark, o.genome_length)).items():
            writers.to_tsv(table, f"{o.output_dir}/{name}", header=True)
    elif o.command == "separate-ltr":
        rows = readers.fasta(spark, o.input_file).select(F.split_part("header", F.lit(" "), F.lit(1)).alias("name"), F.upper("seq").alias("seq"))
        found = search.self_search_approximate(rows, least=150).where(F.col("sstrand") == "plus")
        writers.to_fasta(H.split_terminal(rows, found), o.output_dir, header=F.col("name"))
    else:
        msa = readers.alignment(spark, o.input_file)
        parts = A.cells(msa)
        if o.command == "remove-gaps":
            kept = A.gap_filter(A.column_counts(parts), o.gap_threshold, o.simi_check_gap_thr, o.similarity_thr, o.min_nucleotide)
            out = A.assemble(A.keep_columns(parts, kept))
        elif o.command == "crop-gaps":
            out = A.assemble(A.apply_crop(parts, A.crop_gaps(parts, o.gap_threshold, o.window_size)))
        else:
            crop = A.crop_divergence(parts, A.column_counts(parts), o.threshold * o.window_size, o.window_size, extra_right=0)
            out = A.assemble(A.apply_crop(parts, crop))
        _write_rows(msa, out, o.output_dir)


def main(args: list[str] | None = None) -> None:
    options = parser().parse_args(args)
    run(SparkSession.builder.appName("strandwise").getOrCreate(), options)


if __name__ == "__main__":
    main()

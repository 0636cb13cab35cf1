"""Per-element decisions: boundaries, grades, extension, provenance and roll-out of a curated library."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def final_boundary(te_class: Column, start: Column, end: Column, tail_end: Column, ambiguous_after: Column, least: int = 50) -> tuple[Column, Column]:
    """The coverage boundary; in LINE and SINE classes a poly-tail moves the right end, if what follows it is mostly
    ambiguous."""
    lines = te_class.startswith("LINE") | te_class.startswith("SINE")
    return start, F.when(lines & tail_end.isNotNull() & (ambiguous_after >= least), tail_end).otherwise(end)


def recompute_coverage(te_class: Column, coverage_start: Column, coverage_end: Column, msa_start: Column, msa_end: Column, inside: int = 30) -> Column:
    """Whether the coverage boundary lies so far inside the alignment's that it is taken again with a laxer consensus."""
    return ~te_class.startswith("LINE") & ((coverage_start - msa_start >= inside) | (msa_end - coverage_end >= inside))


def grade(
    start: Column, end: Column, msa_start: Column, msa_end: Column, length: Column, full_hits: Column, partial_hits: Column, sequences: Column, has_terminal: Column,
    terminal_start: Column, terminal_end: Column,
) -> Column:
    """Perfect: both boundaries agree within 15, three full hits, 40 from the edges.  Good: 40 from the edges, and two
    full hits or a terminal repeat whose ends are at most 40 behind the boundary's (differences are signed).
    Reco_check: 20 sequences and two partial hits.  Else Need_check."""
    agree = (F.abs(start - msa_start) <= 15) & (F.abs(end - msa_end) <= 15)
    inside = (start >= 40) & (end <= length - 40)
    terminal = F.coalesce(has_terminal & (terminal_start - start <= 40) & (terminal_end - end <= 40), F.lit(False))
    return (
        F.when(agree & inside & (full_hits >= 3), "Perfect")
        .when(inside & ((full_hits >= 2) | terminal), "Good")
        .when((sequences >= 20) & inside & (partial_hits >= 2), "Reco_check")
        .otherwise("Need_check")
    )


def promoted(evaluation: Column, start: Column, end: Column, length: Column, full_hits: Column, extended: Column) -> Column:
    """Elements that need a check but have three full-length hits away from the edges are recommended for one; without
    enough extension an element needs that first, whatever its grade."""
    enough = (evaluation == "Need_check") & (start >= 40) & (F.abs(length - end) >= 40) & (full_hits >= 3)
    return F.when(~extended, "Need_ext").when(enough, "Reco_check").otherwise(evaluation)


def folder(evaluation: Column) -> Column:
    """The curation folder of a grade."""
    known = ("Perfect", "Good", "Reco_check", "Need_ext")
    out = F.when(evaluation == known[0], known[0])
    for g in known[1:]:
        out = out.when(evaluation == g, g)
    return out.otherwise("Need_check")


def cluster_folder(rank: Column, evaluation: Column, te_class: Column, share: Column) -> Column:
    from ..functions.sequences import file_class, share_text

    return F.concat_ws("_", F.concat(F.lit("Cluster"), rank.cast("string")), evaluation, file_class(te_class, "_"), share_text(share))


def library(accepted: DataFrame, inputs: DataFrame) -> DataFrame:
    """(name, te_class, seq, provenance): accepted consensus sequences, low-copy inputs always, and other inputs without
    a result if they have two full-length hits."""
    low = inputs.where("low_copy").select("name", "te_class", "seq", F.lit("low_copy").alias("provenance"))
    rest = inputs.where(~F.col("low_copy") & (F.col("full_hits") >= 2)).join(accepted.select("name"), "name", "left_anti")
    return accepted.select("name", "te_class", "seq", F.lit("accepted").alias("provenance")).unionByName(low).unionByName(rest.select("name", "te_class", "seq", F.lit("input").alias("provenance")))


def redirected(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """Sequences, with their boundaries, turned round where the strand vote says so (name, keeps)."""
    from ..functions.sequences import reverse_complement

    met = rows.join(votes, "name", "left")
    turn = ~F.coalesce("keeps", F.lit(True))
    n = F.length("seq")
    return met.select(
        "name", F.when(turn, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(turn, n - F.col("end")).otherwise(F.col("start")).alias("start"),
        F.when(turn, n - F.col("start")).otherwise(F.col("end")).alias("end"),
    )


def extension_window(start: Column, end: Column, strand: Column, step: int, iteration: int) -> tuple[Column, Column]:
    """The window that the given iteration of an extension to the right looks at; windows overlap by a tenth."""
    shift = (step - round(step / 10)) * iteration
    plus = end + shift, end + shift + step
    minus = start - shift - step, start - shift
    return F.greatest(F.lit(0), F.when(strand == "-", minus[0]).otherwise(plus[0])), F.greatest(F.lit(0), F.when(strand == "-", minus[1]).otherwise(plus[1]))


def extend(hits: DataFrame, genome: DataFrame, step: int = 1000, longest: int = 7000, least: int = 5, similarity: float = 0.8, ambiguous: float = 0.35) -> DataFrame:
    """(query, extension): how far to the right the sequences of each query agree.

    All queries advance together, a step a round, over ungapped windows of their hits: a window is agreed on if at most
    a share ``ambiguous`` of its columns has no base of share ``similarity``; a query stops at the first that is not, at
    ``longest``, or with fewer than ``least`` sequences.  Rounds are bounded by longest / step.
    """
    from . import alignment as A
    from .clustering import written
    from .intervals import fetch

    state = written(hits.groupBy("query").agg(F.count("*").alias("sequences"), F.lit(0).alias("extension"), (F.count("*") >= least).alias("active")))
    for i in range(-(-longest // step)):
        low, high = extension_window(F.col("start"), F.col("end"), F.col("strand"), step, i)
        window = hits.join(state.where("active").select("query"), "query").select("query", "hit_id", "chrom", "strand", low.alias("start"), high.alias("end")).where("end > start")
        parts = A.cells(fetch(window, genome, drop_other=False).select(F.col("query").alias("msa_id"), F.col("hit_id").alias("seq_id"), "seq"))
        calls = A.column_counts(parts).groupBy(F.col("msa_id").alias("query")).agg((F.avg((A.call(similarity) == "N").cast("double")) <= ambiguous).alias("good"))
        met = state.join(calls, "query", "left")
        go = F.col("active") & F.coalesce("good", F.lit(False))
        state = written(met.select("query", "sequences", F.when(go, F.col("extension") + step).otherwise(F.col("extension")).alias("extension"), go.alias("active")))
    return state.select("query", F.least(F.col("extension"), F.lit(longest)).alias("extension"))


def summary_rows(elements: DataFrame, consensus: DataFrame) -> DataFrame:
    """One row for each consensus, exactly one for an input without any; missing values as the text NaN."""
    met = elements.join(consensus, "input_name", "left")
    return met.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c) for c in met.columns))


def first_tracks(starts: list[int], ends: list[int], gap: int) -> list[int]:
    """Tracks of features in order of their starts: the first whose last end plus ``gap`` is before the start.  As starts
    grow, a track that is free stays so until it is taken: two heaps, of taken tracks by end and of free ones by number."""
    taken, free, out = [], [], []
    for start, end in zip(starts, ends, strict=True):
        while taken and taken[0][0] + gap < start:
            heapq.heappush(free, heapq.heappop(taken)[1])
        track = heapq.heappop(free) if free else len(taken)
        heapq.heappush(taken, (end, track))
        out.append(track)
    return out


def pack_tracks(features: DataFrame, key: str = "name", gap: int = 200) -> DataFrame:
    """Adds ``track`` to (key, start, end, feature): features, by start, end and feature, go to the first track whose last
    end plus ``gap`` is before their start.  A sequence's own features, whose number its length bounds, are one group.
    Rows with a null start or end are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in features.schema.fields}
    rows = features.where("start is not null and end is not null").select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "feature")

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start", "end", "feature"])
        return part.assign(track=first_tracks(part["start"].tolist(), part["end"].tolist(), gap))

    return rows.groupBy(key).applyInPandas(kernel, f"`{key}` {kinds[key]}, start long, end long, feature {kinds['feature']}, track int")


def genome_shares(covered: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``share``: covered bases over the genome's length."""
    return covered.crossJoin(F.broadcast(lengths.agg(F.sum("length").alias("_g")))).withColumn("share", F.col("covered") / F.col("_g")).drop("_g")


def chromosome_names(genome: DataFrame, order: str = "ordinal") -> DataFrame:
    """(chrom, new_name): if any name is longer than 35 or has a sign outside letters, digits and underscores, all are
    numbered in order; else they stay.  Numbering goes by parts of the order, so it is no single task."""
    bad = genome.agg(F.coalesce(F.bool_or((F.length("chrom") > 35) | F.col("chrom").rlike("[^A-Za-z0-9_]")), F.lit(False)).alias("_bad"))
    part = F.floor(F.col(order) / 4096)
    rows = genome.select("chrom", order, part.alias("_part"))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(order))).join(before, "_part").crossJoin(F.broadcast(bad))
    name = F.concat(F.lit("chr_"), (F.col("_before") + F.col("_k")).cast("string"))
    return numbered.select("chrom", F.when(F.col("_bad"), name).otherwise(F.col("chrom")).alias("new_name"))

"""Whole workflows over tables: every decision is a column, so all elements go through one plan together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import alignment as A
from ..operators import clustering as L
from ..operators import curation as U
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators.scratch import written


def benchmark_annotations(query: DataFrame, reference: DataFrame, lengths: DataFrame) -> dict[str, DataFrame]:
    """Compare two annotation tracks (chrom, start, end, type): bases by class pair, metrics by class and for all classes
    together, the cross-tab's flow totals."""
    cross = written(I.cross_lengths(resolved(query), resolved(reference), lengths))  # read three times
    return {"lengths": cross, "metrics": M.confusion(cross).unionByName(M.confusion_all(cross)), "flow": M.flow_totals(cross)}


def resolved(track: DataFrame) -> DataFrame:
    """A track without overlaps: islands of one class are merged, in mixed ones contained intervals go and the others
    begin behind the one before them."""
    # what an island holds is summed up by bins, so no row and no task holds all of an island
    rows = written(I.islands(track.select("chrom", "start", "end", "type"), ["chrom"]).withColumn("_bin", F.floor(F.col("start") / I.BIN)))
    facts = rows.groupBy("chrom", "island", "_bin").agg(F.min(F.struct("type")).alias("_a"), F.max(F.struct("type")).alias("_b"), F.max("end").alias("_e"))
    whole = Window.partitionBy("chrom", "island")
    facts = written(facts.withColumns({"_a": F.min("_a").over(whole), "_b": F.max("_b").over(whole), "_e": F.max("_e").over(whole)}))
    plain = facts.where(F.col("_a").eqNullSafe(F.col("_b"))).select("chrom", F.col("island").alias("start"), F.col("_e").alias("end"), "_a.type").distinct()
    mixed = rows.join(facts.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("chrom", "island", "_bin"), ["chrom", "island", "_bin"])
    mixed = mixed.select("chrom", F.col("island").alias("_island"), "start", "end", "type")
    chained = I.chain_starts(I.drop_contained(mixed, ["chrom", "_island"]), ["chrom", "_island"])
    return plain.unionByName(chained.where("start < end").select("chrom", "start", "end", "type"))


def cluster_alignment(msa: DataFrame, eps: float = 0.1, least: int = 3, largest: int = 18, most: int = 5) -> DataFrame:
    """(msa_id, seq_id, label): subfamilies of each alignment: rare bases masked, gap columns dropped, distances of the rows,
    density clusters.  Alignments whose largest cluster is too small have the one label 0."""
    parts = A.cells(msa)
    counts = A.column_counts(parts)
    clean = A.keep_columns(A.mask_rare(parts, counts, 0.01), A.gap_filter(counts, 0.85))
    node = F.struct("msa_id", F.col("seq_id"))
    nodes = msa.select(node.alias("id"))
    pairs = L.k2p(clean, most=eps).select(F.struct("msa_id", F.col("a").alias("seq_id")).alias("a"), F.struct("msa_id", F.col("b").alias("seq_id")).alias("b"), "d")
    ids = nodes.select(F.xxhash64("id").alias("id"), F.col("id").alias("key"))
    labels = L.dbscan(ids.select("id"), pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), "d"), eps, least)
    named = ids.join(labels, "id").select("key.msa_id", "key.seq_id", "label")
    sizes = named.where("label <> -1").groupBy("msa_id", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("msa_id").agg((F.max("n") >= largest).alias("clustered"))
    return named.join(top, "msa_id", "left").select("msa_id", "seq_id", F.when(F.coalesce("clustered", F.lit(False)), F.col("label")).otherwise(F.lit(0)).alias("label"))


def clean_alignment(msa: DataFrame, window: int = 40, share: float = 0.8, gap: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The final clean-up: divergent ends cropped with a threshold from the alignment's own ends, then gap columns.
    Returns the rows and the map from new to old columns."""
    parts = A.cells(msa)
    counts = A.column_counts(parts)
    mean = A.crop_threshold(parts, counts, window).select("msa_id", F.least("left", "right").alias("_mean"))
    limit = F.when(F.col("_mean") < share * window, F.floor("_mean") - 3).otherwise(0.7 * window)
    limits = mean.select("msa_id", limit.alias("limit"))
    cropped = A.apply_crop(parts, A.crop_divergence(parts, counts, limits, window))
    kept = A.gap_filter(A.column_counts(cropped), gap)
    return A.assemble(A.keep_columns(cropped, kept)), A.with_sentinel(kept)


def merge_library(members: DataFrame, second: DataFrame) -> DataFrame:
    """One representative for each cluster of the first round, and for what had none those of a second clustering
    (name, cluster)."""
    first = R.representatives(members)
    rest = R.second_round(members).drop("cluster").join(second, "name")
    longest = rest.groupBy("cluster").agg(F.max_by("name", F.struct("length", "name")).alias("name"))
    return first.select("name").unionByName(longest.select("name"))


def curation_clusters(members: DataFrame, share: Column) -> DataFrame:
    """(cluster, rank, folder, share, te_class, evaluation): clusters by coverage with their folder names."""
    ranked = R.rank_by_share(R.cluster_rollup(members, share))
    return ranked.withColumn("folder", U.cluster_folder(F.col("rank"), F.col("evaluation"), F.col("te_class"), F.col("share")))

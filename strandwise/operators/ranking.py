"""Ranking, representatives and cluster roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Best first.
GRADES = ("Perfect", "Good", "Reco_check", "Need_check", "Need_ext")
STEPS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0)


def priority(evaluation: Column, order: tuple[str, ...] = GRADES) -> Column:
    """Position of a grade, from 1; what is no grade comes last."""
    at = F.array_position(F.array(*(F.lit(g) for g in order)), evaluation)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(order) + 1).otherwise(at).cast("int")


def representatives(members: DataFrame, cluster: str = "cluster", order: str = "name") -> DataFrame:
    """Per cluster the best of Perfect, Good, Reco_check and low-copy members, then the longest, then the first.
    Clusters without such a member have none."""
    rank = F.least(priority(F.col("evaluation"), GRADES[:3]), F.when(F.col("low_copy"), 4).otherwise(99))
    usable = members.withColumn("_rank", F.when(F.col("evaluation").isin(*GRADES[:3]), rank).when(F.col("low_copy"), 4)).where("_rank is not null")
    w = Window.partitionBy(cluster).orderBy("_rank", F.col("length").desc(), order)
    return usable.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def second_round(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Members of clusters without a representative, to be clustered again."""
    return members.join(representatives(members, cluster).select(cluster), cluster, "left_anti")


def cluster_rollup(members: DataFrame, share: Column, cluster: str = "cluster", order: str = "name") -> DataFrame:
    """(cluster, share, te_class, evaluation): the largest coverage share, the class of that member (the first on a
    tie, Unknown if null) and the best grade."""
    best = F.min_by(F.coalesce("te_class", F.lit("Unknown")), F.struct((-share).alias("s"), F.col(order).alias("o")))
    grade = F.array(*(F.lit(g) for g in GRADES))
    return members.groupBy(cluster).agg(F.max(share).alias("share"), best.alias("te_class"), F.get(grade, F.min(priority(F.col("evaluation"))) - 1).alias("evaluation"))


def rank_by_share(clusters: DataFrame, cluster: str = "cluster", running: bool = False) -> DataFrame:
    """Adds ``rank`` by share, largest first, and ``running``, the sum of the shares so far, if asked for.

    Shares are ranked in 1024 buckets that are offset by the counts and sums of the buckets before them, so neither
    the ranking nor the sum is a single task.
    """
    bucket = F.least(F.lit(1023), F.floor(F.col("share") / (F.lit(1e-9) + F.col("_top")) * 1024))
    rows = clusters.crossJoin(F.broadcast(clusters.agg(F.max("share").alias("_top")))).withColumn("_bucket", bucket).drop("_top")
    sums = rows.groupBy("_bucket").agg(F.count("*").alias("_n"), F.sum("share").alias("_s"))
    before = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_mass"))
    inside = Window.partitionBy("_bucket").orderBy(F.col("share").desc(), cluster)
    ranked = rows.withColumn("_inside", F.row_number().over(inside)).withColumn("_sum", F.sum("share").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.join(F.broadcast(offsets), "_bucket").withColumn("rank", F.col("_before") + F.col("_inside"))
    if running:
        ranked = ranked.withColumn("running", F.col("_mass") + F.col("_sum"))
    return ranked.drop("_bucket", "_inside", "_before", "_sum", "_mass")


def share_crossings(clusters: DataFrame, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """(step, rank): the fewest top-ranked clusters whose cumulative share of all shares reaches each step."""
    ranked = rank_by_share(clusters, running=True)
    sums = clusters.agg(F.sum("share").alias("_all"))
    cumulative = ranked.crossJoin(F.broadcast(sums)).withColumn("_c", F.round(F.col("running") / F.col("_all"), 9))
    met = cumulative.select("rank", F.explode(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.col("_c"))).alias("step"))
    return met.groupBy("step").agg(F.min("rank").alias("rank"))


def most_common(rows: DataFrame, label: str, k: int, seen: str) -> DataFrame:
    """The ``k`` most frequent labels; ties go to the one seen first."""
    counted = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(seen).alias("_first"))
    return counted.orderBy(F.col("n").desc(), "_first").limit(k).drop("_first")


def large_clusters(rows: DataFrame, label: str, least: int, most: int, noise: int = -1, noise_least: int = 12, noise_share: float = 0.6) -> DataFrame:
    """(label, n) of the clusters kept: up to ``most`` of at least ``least`` members by size, and noise as one more if it
    has ``noise_least`` members and ``noise_share`` of all, and fewer than ``most`` others were kept."""
    counted = rows.groupBy(label).agg(F.count("*").alias("n"))
    kept = counted.where((F.col(label) != noise) & (F.col("n") >= least)).orderBy(F.col("n").desc(), label).limit(most)
    facts = counted.agg(F.sum("n").alias("_all")).crossJoin(kept.agg(F.count("*").alias("_kept")))
    extra = counted.where(F.col(label) == noise).crossJoin(F.broadcast(facts))
    extra = extra.where((F.col("n") >= noise_least) & (F.col("n") >= noise_share * F.col("_all")) & (F.col("_kept") < most))
    return kept.unionByName(extra.select(*kept.columns))


def natural_key(name: Column) -> Column:
    """All integers in a name, as an array that sorts in natural order."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def first_label(hits: DataFrame, key: str, evalue: str, name: str, te_class: str) -> DataFrame:
    """(key, label): name#class of the hit with the least e-value, ties by name."""
    return hits.groupBy(key).agg(F.min_by(F.concat_ws("#", name, te_class), F.struct(evalue, name)).alias("label"))


def page(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) of a listing."""
    return df.orderBy(*order).offset(start).limit(end - start)


def completed(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: rows of ``work`` whose key is not in ``done``."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def add_facts(rows: DataFrame, facts: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join on ``key`` with defaults for what is missing."""
    return rows.join(facts, key, "left").na.fill(defaults)


def ordered_union(parts: list[DataFrame], value: str, order: str) -> DataFrame:
    """(value, place): the distinct values of the parts, placed by the first part that has them and the order in it."""
    rows = None
    for i, part in enumerate(parts):
        one = part.select(value, F.lit(i).alias("_part"), F.col(order).alias("_order"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(value).agg(F.min(F.struct("_part", "_order")).alias("_first"))
    return placed(first.select(value, "_first.*"), "_part", ["_order"]).select(value, (F.col("place") + 1).alias("place"))


def placed(df: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0) in the order of ``part``, then ``order``: parts are ranked apart and offset by the counts
    of the parts before them, so the order of everything is no single task."""
    counts = df.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(part, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return df.withColumn("_k", inside).join(offsets, part).withColumn("place", F.col("_before") + F.col("_k") - 1).drop("_k", "_before")

"""Confusion metrics, landscapes, cross-tabs, re-classification and progress counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("sensitivity", "specificity", "accuracy", "precision", "f1", "fdr")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns(
        {"sensitivity": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp)}
    )
    p, r = F.col("precision"), F.col("sensitivity")
    return out.withColumns({"f1": _ratio(2 * p * r, p + r), "fdr": 1 - p})


def confusion(cross: DataFrame, free: str = "Not-TE") -> DataFrame:
    """(class, tp, fp, fn, tn, metrics) from (query, reference, length) for each class that the query track has.  True
    negatives are bases where neither side is the class; empty denominators give 0, so the FDR is then 1."""
    # each row counts for its two classes; what neither side is is left of the whole
    both = F.array(
        F.struct(F.col("query").alias("class"), F.col("length").alias("q"), F.lit(0).cast("long").alias("r"), F.when(F.col("query") == F.col("reference"), F.col("length")).otherwise(0).alias("tp"), F.lit(1).alias("own")),
        F.struct(F.col("reference").alias("class"), F.lit(0).cast("long").alias("q"), F.col("length").alias("r"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("own")),
    )
    sums = cross.select(F.inline(both)).groupBy("class").agg(F.sum("q").alias("q"), F.sum("r").alias("r"), F.sum("tp").alias("tp"), F.max("own").alias("own"))
    whole = Window.partitionBy(F.lit(1)).orderBy("class").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sums.withColumn("all", F.sum("q").over(whole)).where((F.col("own") == 1) & (F.col("class") != free))
    return _scores(rows.select("class", "tp", (F.col("q") - F.col("tp")).alias("fp"), (F.col("r") - F.col("tp")).alias("fn"), (F.col("all") - F.col("q") - F.col("r") + F.col("tp")).alias("tn")))


def confusion_all(cross: DataFrame, free: str = "Not-TE", name: str = "All-TE") -> DataFrame:
    """The same with all classes but ``free`` taken together."""
    both = cross.select(*(F.when(F.col(c) == free, free).otherwise(name).alias(c) for c in ("query", "reference")), "length")
    return confusion(both.unionByName(both.sparkSession.createDataFrame([(name, name, 0)], "query string, reference string, length long")), free)


def crosstab_share(cross: DataFrame, classes: list[str]) -> DataFrame:
    """Bases by query class and reference class as shares of the reference class; missing pairs are 0."""
    table = cross.groupBy("query").pivot("reference", classes).agg(F.sum("length")).na.fill(0)
    whole = Window.partitionBy(F.lit(1)).orderBy("query").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table.select("query", *(_ratio(F.col(f"`{c}`"), F.sum(F.col(f"`{c}`")).over(whole)).alias(c) for c in classes))


def flow_totals(cross: DataFrame) -> DataFrame:
    """(side, class, length): bases by query class and by reference class, in one pass."""
    both = F.array(F.struct(F.lit("query").alias("side"), F.col("query").alias("class")), F.struct(F.lit("reference").alias("side"), F.col("reference").alias("class")))
    return cross.select(F.explode(both).alias("n"), "length").groupBy("n.side", "n.class").agg(F.sum("length").alias("length"))


def landscape(rm: DataFrame, most: int = 40) -> DataFrame:
    """(bin, family, bases): divergence rounded half to even, up to ``most``, by the last part of the class."""
    return (
        rm.select(F.bround("perc_div").cast("int").alias("bin"), F.element_at(F.split("class", "/"), -1).alias("family"), (F.col("query_end") - F.col("query_start")).alias("n"))
        .where(F.col("bin") <= most).groupBy("bin", "family").agg(F.sum("n").alias("bases"))
    )


def landscape_table(rm: DataFrame, families: list[str], most: int = 40) -> DataFrame:
    return landscape(rm, most).groupBy("bin").pivot("family", families).agg(F.sum("bases")).na.fill(0)


def reclassify(rm: DataFrame, lengths: DataFrame, identity: float = 70, least: int = 80, coverage: float = 0.8) -> DataFrame:
    """(query, new_class): the repeat and class with the largest total span per query among rows of enough identity, if
    it is long enough and covers enough of the query, for queries whose class contains Unknown."""
    kept = rm.where(F.col("perc_div") <= 100 - identity)
    spans = kept.groupBy("query", "repeat", "class").agg(F.sum(F.abs(F.col("query_start") - F.col("query_end"))).alias("span")).where(F.col("span") >= least)
    best = spans.groupBy("query").agg(F.min_by(F.struct("class", "span"), F.struct((-F.col("span")).alias("s"), "repeat", "class")).alias("b"))
    met = lengths.where(F.col("te_class").contains("Unknown")).join(best, "query")
    return met.where(F.col("b.span") / F.col("length") >= coverage).select("query", F.col("b.class").alias("new_class"))


def curated_matches(rm: DataFrame, div: float = 5, dele: float = 3, ins: float = 3, coverage: float = 95) -> DataFrame:
    """Queries of which one row alone, of few differences, covers enough: these are known already."""
    share = F.abs(F.col("query_start") - F.col("query_end")) / (F.col("query_end") + F.col("query_left")) * 100
    return rm.where((F.col("perc_div") <= div) & (F.col("perc_del") <= dele) & (F.col("perc_ins") <= ins) & (share >= coverage)).select("query").distinct()


def progress(summary: DataFrame) -> DataFrame:
    """One row of counts over a run summary (input_name, status, low_copy, te_class): a class that only contains
    Unknown counts as unknown and as classified; the share is 0 if either count is."""
    unknown, classified = F.count_if(F.col("te_class").contains("Unknown")), F.count_if(F.col("te_class") != "Unknown")
    return summary.agg(
        F.count_distinct("input_name").alias("inputs"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("low_copy")).alias("low_copy"),
        unknown.alias("unknown"), classified.alias("classified"),
        F.when((unknown > 0) & (classified > 0), classified / (classified + unknown)).otherwise(0.0).alias("classified_share"),
    )


def strand_vote(domains: DataFrame, key: str) -> DataFrame:
    """(key, keeps): whether domain lengths on the plus strand reach those on the minus strand."""
    n = F.abs(F.col("end") - F.col("start"))
    return domains.groupBy(key).agg((F.sum(F.when(F.col("strand") == "+", n).otherwise(-n)) >= 0).alias("keeps"))


def wants_classification(classified_share: Column, compressed: Column) -> Column:
    return (classified_share >= 0.3) & (classified_share < 0.99) & ~compressed

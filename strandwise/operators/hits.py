"""Operators over similarity-search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import dealt


def to_bed(hits: DataFrame, zero_based: bool = False, order: list[str] | None = None) -> DataFrame:
    """Hit intervals on the subject: start and end by strand, ``hit_id`` a running number in ``order`` for each query.

    Starts stay as the search reports them, counted from 1, unless ``zero_based``.
    """
    low, high = F.least("sstart", "send"), F.greatest("sstart", "send")
    strand = F.when(F.col("sstrand").contains("plus"), "+").otherwise("-")
    number = F.row_number().over(Window.partitionBy("qseqid").orderBy(*(order or ["sseqid", "sstart", "send"])))
    return hits.select(
        F.col("sseqid").alias("chrom"), (low - 1 if zero_based else low).alias("start"), high.alias("end"), number.alias("hit_id"), "pident", strand.alias("strand"),
        F.col("length").alias("alnlen"), F.col("qseqid").alias("query"), "qstart", "qend",
    )


def longer_than(hits: DataFrame, least: int = 150) -> DataFrame:
    """Hits strictly longer than ``least``."""
    return hits.where(F.col("length") > least)


def is_full_length(query_length: Column, identity: float = 80, coverage: float = 0.9, min_hit: int = 100) -> Column:
    return (F.col("pident") > identity) & (F.col("length") / query_length >= coverage) & (F.col("length") > min_hit)


def full_length_counts(hits: DataFrame, queries: DataFrame, **profile) -> DataFrame:
    """(query, hits, full_hits) for every query (query, query_length), zeros where it has no hits."""
    met = queries.join(hits.withColumnRenamed("qseqid", "query"), "query", "left")
    return met.groupBy("query").agg(F.count("length").alias("hits"), F.count_if(is_full_length(F.col("query_length"), **profile)).alias("full_hits"))


def low_copy(full_hits: Column, terminal: Column) -> Column:
    """At least one full-length hit, and inverted terminal repeats, or direct ones with two."""
    return (full_hits >= 1) & (((terminal == "LTR") & (full_hits >= 2)) | (terminal == "TIR"))


def divergence() -> Column:
    return 100 - F.col("pident")


def hit_bucket(query_length: Column, full: float = 0.9, half: float = 0.5) -> Column:
    """``full``, ``half`` or ``grey`` by the share of the query that a hit spans."""
    span = F.abs(F.col("qstart") - F.col("qend"))
    return F.when(span >= full * query_length, "full").when(span >= half * query_length, "half").otherwise("grey")


def first_of(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; an order-free distinct would keep any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def down_sample(hits: DataFrame, keys: list[str], length: str, order: list[str], most: int = 100, top: int = 100, seed: int = 7) -> DataFrame:
    """At most ``most`` rows a key: the ``top`` longest (ties by ``order``) and a hash-ordered fill.  Keys within the
    limit keep all rows.  Tasks follow the rows, and rows that are not among the first ``most`` are left at the sort."""
    w = Window.partitionBy(*keys)
    ranked = dealt(hits, keys).withColumn("_long", F.row_number().over(w.orderBy(F.col(length).desc(), *order)))
    if top >= most:
        return ranked.where(F.col("_long") <= most).drop("_long")
    fill = F.row_number().over(w.orderBy((F.col("_long") > top).cast("int"), F.when(F.col("_long") > top, F.xxhash64(*order, F.lit(seed))), "_long"))
    return ranked.withColumn("_pick", fill).where(F.col("_pick") <= most).drop("_long", "_pick")


def terminal_repeat(self_hits: DataFrame, lengths: DataFrame, ltr_slack: int = 3000, tir_slack: int = 2000) -> DataFrame:
    """(query, terminal, start, end): LTR for the widest direct self-hit of span 150 and up that lies downstream and
    spans all but ``ltr_slack``; TIR likewise for inverted ones of span 50 and up, but only where no direct candidate
    exists at all, even one that fails the span test; else the text False.  Starts count from 0."""
    span = F.col("qend") - F.col("qstart")
    off = (F.col("qstart") != F.col("sstart")) & (F.col("qend") != F.col("send"))
    direct = off & (span >= 150) & (F.col("sstart") < F.col("send")) & (F.col("sstart") > F.col("qstart"))
    inverted = off & (span >= 50) & (F.col("sstart") > F.col("send")) & (F.col("send") > F.col("qstart"))
    rows = self_hits.select(
        "query", F.when(direct, "LTR").when(inverted, "TIR").alias("kind"), F.col("qstart").alias("start"),
        F.when(direct, F.col("send")).otherwise(F.col("sstart")).alias("end"), "ordinal",
    ).where("kind is not null")
    best = first_of(rows.withColumn("_span", F.col("start") - F.col("end")), ["query", "kind"], ["_span", "ordinal"])
    kinds = best.withColumn("_direct", F.max((F.col("kind") == "LTR").cast("int")).over(Window.partitionBy("query")))
    chosen = kinds.where((F.col("kind") == "LTR") | (F.col("_direct") == 0))
    met = lengths.select("query", "length").join(chosen, "query", "left")
    slack = F.when(F.col("kind") == "LTR", ltr_slack).otherwise(tir_slack)
    holds = F.col("end") - F.col("start") >= F.col("length") - slack
    return met.select("query", F.when(holds, F.col("kind")).otherwise("False").alias("terminal"), F.when(holds, F.col("start") - 1).alias("start"), F.when(holds, F.col("end")).alias("end"))


def split_terminal(seqs: DataFrame, self_hits: DataFrame, least: int = 150, slack: int = 200) -> DataFrame:
    """One or two rows a sequence (name, seq): of a sequence with a non-overlapping direct repeat that spans all but
    ``slack``, the repeat (the side with fewer N, the left one on a tie) as name_LTR and what is between as name_INT."""
    span = F.col("qend") - F.col("qstart") + 1
    direct = (F.col("sstart") > F.col("qend")) & (F.col("send") > F.col("sstart")) & (span >= least)
    best = first_of(self_hits.where(direct).withColumn("_w", F.col("qstart") - F.col("send")), ["query"], ["_w", "ordinal"])
    met = seqs.join(best.withColumnRenamed("query", "name"), "name", "left")
    good = F.col("send") - F.col("qstart") + 1 >= F.length("seq") - slack
    left = F.substring(F.col("seq"), F.col("qstart").cast("int"), (F.col("qend") - F.col("qstart") + 1).cast("int"))
    right = F.substring(F.col("seq"), F.col("sstart").cast("int"), (F.col("send") - F.col("sstart") + 1).cast("int"))
    inner = F.substring(F.col("seq"), (F.col("qend") + 1).cast("int"), (F.col("sstart") - F.col("qend") - 1).cast("int"))
    ns = lambda s: F.length(F.regexp_replace(s, "[^Nn]", ""))
    suffix = lambda k: F.regexp_replace(F.col("name"), r"^([^#]*)", f"$1_{k}")
    parts = F.when(good, F.array(F.struct(suffix("LTR").alias("name"), F.when(ns(right) < ns(left), right).otherwise(left).alias("seq")), F.struct(suffix("INT").alias("name"), inner.alias("seq"))))
    whole = F.array(F.struct(F.col("name").alias("name"), F.col("seq").alias("seq")))
    return met.select(F.explode(F.coalesce(parts, whole)).alias("x")).select("x.name", "x.seq")


def numbered(self_hits: DataFrame) -> DataFrame:
    """Adds ``ordinal``, the place of a hit among those of its query."""
    return self_hits.withColumn("ordinal", F.row_number().over(Window.partitionBy("query").orderBy("qstart", "sstart", "send")).cast("long"))


def dot_segments(self_hits: DataFrame) -> DataFrame:
    """Segments of a dot plot with their orientation."""
    return self_hits.withColumn("orientation", F.when((F.col("qend") - F.col("qstart")) * (F.col("send") - F.col("sstart")) >= 0, "direct").otherwise("inverted"))


def best_protein_hits(hits: DataFrame, key: str = "orf", score: str = "bitscore", order: list[str] | None = None) -> DataFrame:
    return first_of(hits.withColumn("_s", -F.col(score)), [key], ["_s", *(order or [])]).drop("_s")

"""Approximate homology search and alignment, where no external tool's output is at hand."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import reverse_complement

HIT_COLUMNS = ("qseqid", "sseqid", "pident", "length", "qstart", "qend", "sstart", "send", "sstrand")


def _grams(seq: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substring(seq, i, F.lit(k)))


def _seeds(q: DataFrame, s: DataFrame, own: bool, hot: int = 10_000, salts: int = 16) -> DataFrame:
    """Places of equal k-mers.  A k-mer that occurs over ``hot`` times in the subjects is dealt in salted shares, so it is
    not one task.  ``own``: a sequence meets itself only, so how often others hold a k-mer plays no part."""
    if own:
        return q.join(s, (q["gram"] == s["gram"]) & (q["name"] == s["chrom"])).drop(s["gram"])
    often = s.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram", F.lit(True).alias("_hot"))
    spread = s.join(often, "gram", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("chrom", "spos"), F.lit(salts))).otherwise(0)).drop("_hot")
    zero = F.lit(0).cast("long")
    copies = F.when(F.col("_hot"), F.sequence(zero, zero + salts - 1)).otherwise(F.array(zero))
    return q.join(often, "gram", "left").withColumn("_salt", F.explode(copies)).drop("_hot").join(spread, ["gram", "_salt"]).drop("_salt")


def search_approximate(
    queries: DataFrame, subjects: DataFrame, k: int = 11, gap: int = 40, least: int = 50, frequent: int | None = None, own: bool = False
) -> DataFrame:
    """Hits (HIT_COLUMNS) of queries (name, seq) in subjects (chrom, seq): ungapped stretches of one diagonal.

    Both sides' k-mers meet in an equi-join; seeds of one query, subject, strand and diagonal that are at most ``gap``
    apart are one stretch, whose identity is counted over its letters.  All k-mers seed, those of high-copy families in
    salted shares; ``frequent`` masks those that occur more often in the subjects, as search tools can.  ``own`` compares
    each sequence with itself only.  Approximate: no gaps.
    """
    both = queries.select("name", F.upper("seq").alias("seq"), F.lit("plus").alias("sstrand")).unionByName(
        queries.select("name", reverse_complement(F.upper("seq")).alias("seq"), F.lit("minus").alias("sstrand"))
    )
    q = both.where(F.length("seq") >= k).select("name", "sstrand", F.posexplode(_grams(F.col("seq"), k)).alias("qpos", "gram"))
    s = subjects.where(F.length("seq") >= k).select("chrom", F.posexplode(_grams(F.upper("seq"), k)).alias("spos", "gram"))
    if frequent is not None:
        masked = s.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > frequent).select("gram")
        s = s.join(masked, "gram", "left_anti")
    seeds = _seeds(q, s, own).withColumn("diagonal", F.col("spos") - F.col("qpos"))
    w = Window.partitionBy("name", "sstrand", "chrom", "diagonal").orderBy("qpos")
    fresh = F.coalesce(F.col("qpos") - F.lag("qpos").over(w) > gap, F.lit(True)).cast("int")
    runs = seeds.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(w))
    spans = runs.groupBy("name", "sstrand", "chrom", "diagonal", "run").agg(F.min("qpos").alias("a"), (F.max("qpos") + k).alias("b")).where(F.col("b") - F.col("a") >= least)
    met = spans.join(both, ["name", "sstrand"]).join(subjects.select("chrom", F.upper("seq").alias("_s")), "chrom")
    n = F.col("b") - F.col("a")
    x, y = F.substring(F.col("seq"), F.col("a") + 1, n), F.substring(F.col("_s"), F.col("a") + F.col("diagonal") + 1, n)
    same = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda i, j: F.when(i == j, 1).otherwise(0)), F.lit(0), lambda t, v: t + v)
    plus = F.col("sstrand") == "plus"
    size, low, high = F.length("seq"), F.col("a") + F.col("diagonal") + 1, F.col("b") + F.col("diagonal")
    return met.select(
        F.col("name").alias("qseqid"), F.col("chrom").alias("sseqid"), F.round(same / n * 100, 3).alias("pident"), n.cast("long").alias("length"),
        F.when(plus, F.col("a") + 1).otherwise(size - F.col("b") + 1).cast("long").alias("qstart"), F.when(plus, F.col("b")).otherwise(size - F.col("a")).cast("long").alias("qend"),
        F.when(plus, low).otherwise(high).cast("long").alias("sstart"), F.when(plus, high).otherwise(low).cast("long").alias("send"), "sstrand",
    )


def self_search_approximate(seqs: DataFrame, k: int = 11, least: int = 50) -> DataFrame:
    """Hits of each sequence with itself, the trivial one left out, each direct pair once."""
    found = search_approximate(seqs, seqs.select(F.col("name").alias("chrom"), "seq"), k, least=least, own=True)
    rows = found.where((F.col("sstrand") == "minus") | (F.col("qstart") < F.col("sstart")))
    order = F.row_number().over(Window.partitionBy("qseqid").orderBy("qstart", "sstart", "send"))
    return rows.withColumn("ordinal", order.cast("long")).withColumnRenamed("qseqid", "query")


def align_pair(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> tuple[str, str]:
    """One best global alignment with linear gap costs; ends of ``b`` hang over free of cost."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    n, m = len(x), len(y)
    score = np.zeros((n + 1, m + 1), np.int64)
    score[:, 0] = gap * np.arange(n + 1)
    for i in range(1, n + 1):
        base = np.maximum(score[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), score[i - 1, 1:] + (gap if i else 0))
        # gaps along the row are a running maximum once the cost of their length is taken out
        steps = gap * np.arange(1, m + 1)
        row = np.maximum.accumulate(np.concatenate(([score[i, 0]], base - steps)))
        score[i, 1:] = row[1:] + steps
    i, j, left, right = n, int(score[n].argmax()), [], []
    left.extend("-" * (m - j))
    right.extend(reversed(b[j:]))
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and score[i, j] == score[i - 1, j] + gap:
            i -= 1
            left.append(a[i])
            right.append("-")
        elif i == 0:
            j -= 1
            left.append("-")
            right.append(b[j])
        else:
            j -= 1
            left.append("-")
            right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right))


def centre_star(seqs: list[str]) -> list[str]:
    """Align all sequences to the longest one; a gap once opened in it is kept for all."""
    if not seqs:
        return []
    centre = max(range(len(seqs)), key=lambda i: (len(seqs[i]), -i))
    pairs = [align_pair(seqs[centre], s) for s in seqs]
    slots = np.zeros(len(seqs[centre]) + 1, int)
    for top, _ in pairs:
        at = run = 0
        for c in top:
            if c == "-":
                run += 1
                slots[at] = max(slots[at], run)
            else:
                at, run = at + 1, 0
    out = []
    for top, low in pairs:
        parts, at, run = [], 0, []
        for c, d in zip(top, low, strict=True):
            if c == "-":
                run.append(d)
            else:
                parts += ["".join(run).ljust(slots[at], "-"), d]
                at, run = at + 1, []
        parts.append("".join(run).ljust(slots[at], "-"))
        out.append("".join(parts))
    return out


def align_approximate(rows: DataFrame, key: str = "msa_id", most: int = 100) -> DataFrame:
    """(key, seq_id, seq): aligned sequences of each group, lower case, by centre-star alignment.  Approximate: not what a
    progressive aligner gives.  A group is an element's own sequences, of which the ``most`` longest are aligned, as the
    down-sampling of hits before it leaves no more."""
    w = Window.partitionBy(key).orderBy(F.length("seq").desc(), "seq_id")
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select(key, "seq_id", "seq")

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq_id")
        return part.assign(seq=centre_star([s.lower() for s in part["seq"]]))

    return kept.groupBy(key).applyInPandas(kernel, kept.schema)

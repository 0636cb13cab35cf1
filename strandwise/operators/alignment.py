"""Alignment columns: rows are (msa_id, seq_id, seq), cells (msa_id, seq_id, col, base) with columns from 0.

Everything per column is one aggregate over cells; what runs along a sequence or along columns is a window frame.
Letters are folded to lower case where cells are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASES = ("a", "c", "g", "t")


def _along():
    return Window.partitionBy("msa_id").orderBy("col")


def cells(msa: DataFrame) -> DataFrame:
    letters = F.filter(F.split(F.lower("seq"), ""), lambda x: x != "")
    return msa.select("msa_id", "seq_id", F.posexplode(letters).alias("col", "base"))


def assemble(parts: DataFrame) -> DataFrame:
    """Cells back to rows."""
    letters = F.array_sort(F.collect_list(F.struct("col", "base")))
    return parts.groupBy("msa_id", "seq_id").agg(F.array_join(F.transform(letters, lambda x: x["base"]), "").alias("seq"))


def is_ragged(msa: DataFrame) -> DataFrame:
    """(msa_id, ragged): whether rows differ in length."""
    return msa.groupBy("msa_id").agg((F.min(F.length("seq")) != F.max(F.length("seq"))).alias("ragged"))


def column_counts(parts: DataFrame) -> DataFrame:
    """(msa_id, col, n, a, c, g, t, gaps): letters by column; N and others are in n only."""
    count = lambda b: F.count_if(F.col("base") == b)
    return parts.groupBy("msa_id", "col").agg(F.count("*").alias("n"), *(count(b).alias(b) for b in BASES), count("-").alias("gaps"))


def acgt() -> Column:
    return F.col("a") + F.col("c") + F.col("g") + F.col("t")


def top_count() -> Column:
    return F.greatest(*BASES)


def proportions(counts: DataFrame, least: int = 0, digits: int | None = None) -> DataFrame:
    """Shares of the four bases by column; columns with fewer than ``least`` bases, or none, have zeros.  ``digits``
    rounds half to even."""
    total = acgt()
    share = lambda b: F.when((total >= least) & (total > 0), F.col(b) / total).otherwise(0.0)
    return counts.select("msa_id", "col", *((share(b) if digits is None else F.bround(share(b), digits)).alias(f"p_{b}") for b in BASES))


def conservation() -> Column:
    """The largest base count over all bases; 0 without bases."""
    return F.when(acgt() > 0, top_count() / acgt()).otherwise(0.0)


def call(threshold: float, least: int = 0) -> Column:
    """The most frequent base in upper case, the first of A, C, G, T on a tie, if its share reaches the threshold."""
    top = top_count()
    winner = F.when(F.col("a") == top, "A").when(F.col("c") == top, "C").when(F.col("g") == top, "G").otherwise("T")
    return F.when((acgt() > 0) & (acgt() >= least) & (top / acgt() >= threshold), winner).otherwise("N")


def consensus(counts: DataFrame, threshold: float = 0.8, least: int = 0) -> DataFrame:
    """(msa_id, consensus)."""
    letters = F.array_sort(F.collect_list(F.struct("col", call(threshold, least).alias("call"))))
    return counts.groupBy("msa_id").agg(F.array_join(F.transform(letters, lambda x: x["call"]), "").alias("consensus"))


def too_ambiguous(consensus: Column, share: float = 0.4) -> Column:
    return F.length(F.regexp_replace(consensus, "[^N]", "")) / F.length(consensus) > share


def gap_filter(counts: DataFrame, gap: float = 0.8, check: float = 0.4, similarity: float = 0.7, least: int = 5) -> DataFrame:
    """Columns that stay, with their new numbers: at least ``least`` letters, at most ``gap`` gaps, and from ``check``
    gaps on enough conservation."""
    share = F.col("gaps") / F.col("n")
    keep = (F.col("n") - F.col("gaps") >= least) & (share <= gap) & ((share < check) | (conservation() >= similarity))
    return renumber(counts.where(keep).select("msa_id", "col"))


def renumber(kept: DataFrame) -> DataFrame:
    """(msa_id, new_col, old_col): dense numbers from 0."""
    return kept.select("msa_id", (F.row_number().over(_along()) - 1).alias("new_col"), F.col("col").alias("old_col"))


def with_sentinel(mapping: DataFrame) -> DataFrame:
    """The column map with one entry past its end."""
    last = mapping.groupBy("msa_id").agg((F.max("new_col") + 1).alias("new_col"), (F.max("old_col") + 1).alias("old_col"))
    return mapping.unionByName(last)


def usable(mapping: DataFrame, least: int = 50) -> DataFrame:
    """(msa_id, usable): whether enough columns stay."""
    return mapping.groupBy("msa_id").agg((F.count("*") >= least).alias("usable"))


def keep_columns(parts: DataFrame, mapping: DataFrame) -> DataFrame:
    joined = parts.join(mapping.withColumnRenamed("old_col", "col"), ["msa_id", "col"])
    return joined.select("msa_id", "seq_id", F.col("new_col").alias("col"), "base")


def mask_rare(parts: DataFrame, counts: DataFrame, threshold: float = 0.08) -> DataFrame:
    """Bases whose share of their column is below the threshold become gaps; shares are not taken anew."""
    met = parts.join(counts, ["msa_id", "col"])
    own = F.when(F.col("base") == "a", F.col("a")).when(F.col("base") == "c", F.col("c")).when(F.col("base") == "g", F.col("g")).when(F.col("base") == "t", F.col("t"))
    rare = F.coalesce(own / acgt() < threshold, F.lit(False))
    return met.select("msa_id", "seq_id", "col", F.when(rare, "-").otherwise(F.col("base")).alias("base"))


def divergent_columns(counts: DataFrame, high: float = 0.8, high_many: float = 0.85, many: int = 90) -> DataFrame:
    """Columns in which no base has more than the threshold; columns of gaps stay."""
    limit = F.when(F.col("n") >= many, high_many).otherwise(high)
    return counts.where(~(conservation() > limit)).select("msa_id", "col")


def worth_clustering(divergent: DataFrame, counts: DataFrame, least: int = 50, share: float = 0.05, cap: int = 100) -> DataFrame:
    """(msa_id, cluster): whether there are enough divergent columns: more than the larger of ``least`` and a share of
    the length, or than ``cap`` in long alignments."""
    length = counts.groupBy("msa_id").agg(F.count("*").alias("length"))
    found = divergent.groupBy("msa_id").agg(F.count("*").alias("found"))
    limit = F.when(F.col("length") > cap / share, F.lit(float(cap))).otherwise(F.greatest(F.lit(float(least)), share * F.col("length")))
    return length.join(found, "msa_id", "left").select("msa_id", (F.coalesce("found", F.lit(0)) > limit).alias("cluster"))


def _frames(window: int, extra: int = 0):
    w = Window.partitionBy("msa_id", "seq_id").orderBy("col")
    return w.rowsBetween(0, window - 1), w.rowsBetween(-(window - 1 + extra), 0)


def crop_divergence(parts: DataFrame, counts: DataFrame, threshold: float | DataFrame, window: int, extra_right: int = 1) -> DataFrame:
    """(msa_id, seq_id, start, end): first and last column of the outermost windows whose shares of the sequence's own
    letters add up to more than the threshold; the right window is ``extra_right`` columns longer.  Sequences without
    such a window have start and end 0.  Gaps and other letters have no share.  A table (msa_id, limit) gives each
    alignment a threshold of its own."""
    met = parts.join(proportions(counts), ["msa_id", "col"])
    own = F.when(F.col("base") == "a", F.col("p_a")).when(F.col("base") == "c", F.col("p_c")).when(F.col("base") == "g", F.col("p_g")).when(F.col("base") == "t", F.col("p_t"))
    rows = met.withColumn("_v", F.coalesce(own, F.lit(0.0)))
    if isinstance(threshold, DataFrame):
        rows, threshold = rows.join(threshold.select("msa_id", F.col("limit").alias("_limit")), "msa_id"), F.col("_limit")
    return _crop(rows, window, extra_right, lambda s, n: s > threshold)


def crop_gaps(parts: DataFrame, threshold: float, window: int) -> DataFrame:
    """(msa_id, seq_id, start, end) of the outermost windows with at most the threshold's share of gaps; ends are not
    before starts."""
    gaps = parts.withColumn("_v", (F.col("base") == "-").cast("double"))
    out = _crop(gaps, window, 0, lambda s, n: s / n <= threshold)
    return out.withColumn("end", F.greatest("start", "end"))


def _crop(rows: DataFrame, window: int, extra: int, good) -> DataFrame:
    ahead, behind = _frames(window, extra)
    sums = rows.withColumns({"_a": F.round(F.sum("_v").over(ahead), 9), "_na": F.count("*").over(ahead), "_b": F.round(F.sum("_v").over(behind), 9), "_nb": F.count("*").over(behind)})
    return sums.groupBy("msa_id", "seq_id").agg(
        F.coalesce(F.min(F.when((F.col("_na") == window) & good(F.col("_a"), F.lit(window)), F.col("col"))), F.lit(0)).alias("start"),
        F.coalesce(F.max(F.when((F.col("_nb") == window + extra) & good(F.col("_b"), F.lit(window + extra)), F.col("col") + 1)), F.lit(0)).alias("end"),
    )


def apply_crop(parts: DataFrame, crop: DataFrame) -> DataFrame:
    """Letters outside [start, end) become gaps."""
    inside = (F.col("col") >= F.col("start")) & (F.col("col") < F.col("end"))
    return parts.join(crop, ["msa_id", "seq_id"]).select("msa_id", "seq_id", "col", F.when(inside, F.col("base")).otherwise("-").alias("base"))


def large_crops(crop: DataFrame, lengths: DataFrame, share: float = 0.9) -> DataFrame:
    """(msa_id, seq_id, large): whether more than ``share`` of the alignment was cropped off a sequence."""
    return crop.join(lengths, "msa_id").select("msa_id", "seq_id", (F.col("length") - (F.col("end") - F.col("start")) > share * F.col("length")).alias("large"))


def crop_threshold(parts: DataFrame, counts: DataFrame, window: int = 40, steps: int = 100) -> DataFrame:
    """(msa_id, left, right): means of the window sums over the first and last ``steps`` offsets."""
    met = counts.select("msa_id", "col", conservation().alias("_v"))
    sums = met.withColumns({"_s": F.sum("_v").over(_along().rowsBetween(0, window - 1)), "_n": F.count("*").over(_along().rowsBetween(0, window - 1))}).where(F.col("_n") == window)
    last = F.max("col").over(Window.partitionBy("msa_id"))
    sums = sums.withColumn("_last", last)
    return sums.groupBy("msa_id").agg(
        F.avg(F.when(F.col("col") < steps, F.col("_s"))).alias("left"), F.avg(F.when(F.col("col") > F.col("_last") - steps, F.col("_s"))).alias("right")
    )


def consensus_boundary(counts: DataFrame, window: int = 50, most: float = 0.3, threshold: float = 0.8, least: int = 0, buffer: int = 10) -> DataFrame:
    """(msa_id, start, end, extend_left, extend_right, stop): the outermost windows of the consensus with at most a share
    ``most`` of N.  Without one, start is the length and end is 1.  The vote's threshold is its own parameter; a bound
    within ``buffer`` of an edge asks for extension, unless the bounds cross, which stops the element."""
    n = counts.withColumn("_v", (call(threshold, least) == "N").cast("int"))
    ahead, behind = _along().rowsBetween(0, window - 1), _along().rowsBetween(-(window - 1), 0)
    sums = n.withColumns({"_a": F.sum("_v").over(ahead), "_na": F.count("*").over(ahead), "_b": F.sum("_v").over(behind), "_nb": F.count("*").over(behind)})
    out = sums.groupBy("msa_id").agg(
        F.count("*").alias("_len"),
        F.min(F.when((F.col("_na") == window) & (F.col("_a") <= most * window), F.col("col"))).alias("_s"),
        F.max(F.when((F.col("_nb") == window) & (F.col("_b") <= most * window), F.col("col") + 1)).alias("_e"),
    )
    start, end = F.coalesce(F.col("_s"), F.col("_len")), F.coalesce(F.col("_e"), F.lit(1))
    return out.select("msa_id", start.alias("start"), end.alias("end"), ((start < end) & (start <= buffer)).alias("extend_left"), ((start < end) & (end >= F.col("_len") - buffer)).alias("extend_right"), (start >= end).alias("stop"))


def gap_runs(counts: DataFrame, gap: float = 0.3, least: int = 10, similarity: float = 0.6, jump: float = 0.1, shortest: int = 3) -> DataFrame:
    """(msa_id, start, end): runs of successive columns with many gaps, enough letters and enough conservation.  A run
    is split where the gap count jumps by more than ``jump`` of the rows; short runs are dropped.  Ends are inclusive."""
    good = (F.col("gaps") / F.col("n") >= gap) & (F.col("n") - F.col("gaps") >= least) & (conservation() >= similarity)
    rows = counts.where(good).withColumns({"_prev": F.lag("col").over(_along()), "_gaps": F.lag("gaps").over(_along())})
    fresh = F.col("_prev").isNull() | (F.col("col") - F.col("_prev") > 1) | (F.abs(F.col("gaps") - F.col("_gaps")) > jump * F.col("n"))
    runs = rows.withColumn("_run", F.sum(F.when(fresh, 1).otherwise(0)).over(_along())).groupBy("msa_id", "_run").agg(F.min("col").alias("start"), F.max("col").alias("end"))
    return runs.where(F.col("end") - F.col("start") + 1 >= shortest).select("msa_id", "start", "end")


def merge_runs(runs: DataFrame, distance: int = 2) -> DataFrame:
    """Join runs that are at most ``distance`` columns apart (ends inclusive)."""
    w = Window.partitionBy("msa_id").orderBy("start")
    far = F.coalesce(F.col("start") - F.lag("end").over(w) > distance, F.lit(True))
    marked = runs.withColumn("_fresh", far.cast("int"))
    return marked.withColumn("_run", F.sum("_fresh").over(w)).groupBy("msa_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def nucleotide_radius(parts: DataFrame, centre: Column, radius: int) -> DataFrame:
    """(msa_id, seq_id, left, right): the columns that hold the ``radius``-th letter before and from the centre, gaps
    skipped; the outermost letter where there are fewer."""
    w = Window.partitionBy("msa_id", "seq_id").orderBy("col")
    letters = parts.where("base <> '-'").withColumn("_c", centre).withColumn("_i", F.row_number().over(w))
    at = letters.withColumn("_before", F.sum((F.col("col") < F.col("_c")).cast("int")).over(Window.partitionBy("msa_id", "seq_id")))
    left = F.min(F.when((F.col("col") < F.col("_c")) & (F.col("_i") > F.col("_before") - radius), F.col("col")))
    right = F.max(F.when((F.col("col") >= F.col("_c")) & (F.col("_i") <= F.col("_before") + radius), F.col("col")))
    return at.groupBy("msa_id", "seq_id").agg(left.alias("left"), right.alias("right"))


def drop_gappy(msa: DataFrame, gap: float = 0.9) -> DataFrame:
    """Rows whose share of gaps is below the threshold."""
    return msa.where((F.length("seq") - F.length(F.replace(F.col("seq"), F.lit("-"), F.lit("")))) / F.length("seq") < gap)


def drop_short(msa: DataFrame, share: float = 0.1) -> DataFrame:
    """Rows with letters in at least ``share`` of the columns."""
    return msa.where(F.length(F.replace(F.col("seq"), F.lit("-"), F.lit(""))) >= share * F.length("seq"))


def cut(seq: Column, start: Column, end: Column) -> Column:
    """Letters of [start, end), clamped to the sequence."""
    low = F.greatest(F.lit(0), F.least(start, F.length(seq)))
    return F.substring(seq, (low + 1).cast("int"), F.greatest(F.lit(0), F.least(end, F.length(seq)) - low).cast("int"))


def ends_only(seq: Column, k: int) -> Column:
    """The first and last ``k`` letters with ten gaps between."""
    return F.concat(F.substring(seq, 1, k), F.lit("-" * 10), F.right(seq, F.lit(k)))


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Alignments of equal height side by side, with the lengths of both."""
    other = b.select("msa_id", "seq_id", F.col("seq").alias("_b"))
    return a.join(other, ["msa_id", "seq_id"]).select("msa_id", "seq_id", F.concat("seq", "_b").alias("seq"), F.length("seq").alias("first"), F.length("_b").alias("second"))


def highlight(parts: DataFrame, share: float = 0.6, rare: float = 0.2) -> DataFrame:
    """Cells to show: in columns whose top letter has ``share`` only letters below ``rare``, else all; others are null."""
    whole = Window.partitionBy("msa_id", "col")
    own = F.count("*").over(Window.partitionBy("msa_id", "col", "base")) / F.count("*").over(whole)
    rows = parts.withColumn("_p", own).withColumn("_top", F.max("_p").over(whole))
    return rows.select("msa_id", "seq_id", "col", F.when((F.col("_top") < share) | (F.col("_p") < rare), F.col("base")).alias("shown"))


def codes(parts: DataFrame) -> DataFrame:
    """Cells as numbers: bases 1 to 4, gaps 0, others 5."""
    code = F.coalesce(F.array_position(F.array(*map(F.lit, BASES)), F.col("base")).cast("int"), F.lit(0))
    return parts.select("msa_id", "seq_id", "col", F.when(F.col("base") == "-", 0).when(code == 0, 5).otherwise(code).alias("code"))


def mean_proportions(counts: DataFrame) -> DataFrame:
    """(msa_id, mean): the mean over columns of the mean share of the bases that occur."""
    p = proportions(counts)
    mean = lambda r: F.aggregate(F.filter(r, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size(F.filter(r, lambda x: x > 0)))
    return p.groupBy("msa_id").agg(F.avg(mean(F.array(*(f"p_{b}" for b in BASES)))).alias("mean"))


def lookup(mapping: DataFrame, values: DataFrame) -> DataFrame:
    """Values of old columns by new column; null where there is none."""
    return mapping.join(values.withColumnRenamed("col", "old_col"), ["msa_id", "old_col"], "left").select("msa_id", F.col("new_col").alias("col"), "value")

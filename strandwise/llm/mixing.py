"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks.  Block i (from 1) of a source of weight w may start at slot floor((i-1)/w) and
must be placed before slot ceil(i/w); at every slot the released block with the earliest deadline is placed.  With
weights that add up to 1 this keeps every source within one block of its ideal share at every slot.  Weights are
multiples of 1/Q, so the schedule repeats after Q slots: it is worked out once for one period, by a fold over the
slots, and laid over the blocks by a join.

The fold goes by windows of about the square root of the number of sources.  No more blocks than a window has slots are
placed in it, so only the most urgent of those that wait are looked at slot by slot; the others are sorted once a
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_few, materialize

#: Rows of a schedule that are sent to every task; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1 << 18
_INDEX = 1 << 31  # a waiting block is its deadline times this, plus the number of its source

OUTPUT = ["block", "slot", "place", "release", "deadline", "weight"]


def temperature_shares(docs: DataFrame, source: Column, exponent: float = 0.5, denominator: int = 1000) -> DataFrame:
    """(source, share): whole shares of about ``denominator``, at least 1, by document count to the ``exponent``."""
    mass = docs.groupBy(source.alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(exponent)).alias("mass"))
    total = F.sum("mass").over(Window.partitionBy(F.lit(1)).orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return mass.select("source", F.greatest(F.lit(1), F.floor(denominator * F.col("mass") / total + 0.5).cast("int")).alias("share"))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _place(state: Column, t: Column, jobs: Column) -> Column:
    """One slot: what is released at t joins those that wait, and the earliest deadline among them is placed."""
    joined = F.concat(state["near"], F.transform(F.filter(jobs, lambda x: x["release"] == t), lambda x: x["job"]))
    chosen = lambda near: F.struct(near.alias("near"), F.array_min(near).alias("job"))
    return _bind(_bind(joined, chosen), lambda x: F.struct(
        F.array_remove(x["near"], x["job"]).alias("near"), F.concat(state["order"], F.array(x["job"])).alias("order")))


def period(shares: DataFrame) -> DataFrame:
    """(source, share, turn, slot, total): the slots of one period; ``turn`` counts a source's blocks from 0.

    One row holds all blocks of a period: its size is that of the weights, never that of the data.
    """
    placed = shares.agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"), F.sum("share").cast("long").alias("total"))
    known = materialize(placed.select("total", F.posexplode("s").alias("k", "x")).select("total", "k", "x.source", "x.share"), "shares")
    count = known.count()
    width = max(8, int(count**0.5))
    n, w = F.col("total"), F.col("share")
    jobs = known.select("total", "k", "share", F.explode(F.sequence(F.lit(0).cast("long"), w.cast("long") - 1)).alias("i"))
    job = F.ceil((F.col("i") + 1) * n / w) * _INDEX + F.col("k")
    jobs = jobs.select("total", F.floor(F.col("i") * n / w).alias("release"), job.alias("job"))
    windows = jobs.groupBy("total", F.floor(F.col("release") / width).alias("window")).agg(F.collect_list(F.struct("release", "job")).alias("jobs"))
    # a window in which nothing is released is one all the same
    every = known.select("total").distinct().select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / width))).alias("window"))
    windows = every.join(windows, ["total", "window"], "left").withColumn("jobs", F.coalesce("jobs", F.array().cast("array<struct<release:bigint,job:bigint>>")))
    row = windows.groupBy("total").agg(F.array_sort(F.collect_list(F.struct("window", "jobs"))).alias("w"))

    def run(state: Column, x: Column) -> Column:
        first = x["window"] * width
        slots = F.sequence(first, F.least(first + width, n) - 1)
        start = lambda waiting: F.struct(F.slice(waiting, 1, width).alias("near"), F.array().cast("array<bigint>").alias("order"))
        done = lambda waiting: _bind(F.aggregate(slots, start(waiting), lambda s, t: _place(s, t, x["jobs"])), lambda s: F.struct(
            F.concat(s["near"], F.slice(waiting, width + 1, F.greatest(F.lit(1), F.size(waiting)))).alias("waiting"),
            F.concat(state["order"], F.array(s["order"])).alias("order")))
        return _bind(F.sort_array(state["waiting"]), done)

    start = F.struct(F.array().cast("array<bigint>").alias("waiting"), F.array().cast("array<array<bigint>>").alias("order"))
    folded = row.select(F.posexplode(F.aggregate("w", start, run)["order"]).alias("window", "jobs"))
    slots = folded.select("window", F.posexplode("jobs").alias("at", "job"))
    slots = slots.select((F.col("window") * width + F.col("at")).alias("slot"), (F.col("job") % _INDEX).cast("int").alias("k"))
    named = join_few(slots, known, ["k"], F.col("slot"), BROADCAST_ROWS)
    turn = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return named.select("source", "share", "slot", "total").withColumn("turn", turn)


def ranked(rows: DataFrame, salt_digits: int = 3) -> DataFrame:
    """Adds ``rank`` (from 0) of each row within its source by md5 of the id, then id.

    A source is cut by the leading digits of the digest into 4096 parts that are ranked apart and offset by the
    counts of the parts before them, so a source that holds a third of all rows is not one task.
    """
    rows = rows.withColumn("_key", F.coalesce(F.md5(F.col("_id").cast("string").cast("binary")), F.lit("")))
    rows = rows.withColumn("_part", F.substring("_key", 1, salt_digits))
    counts = rows.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_source", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_key", "_id"))
    numbered = rows.withColumn("_inside", inside)
    return numbered.join(offsets, ["_source", "_part"]).withColumn("_rank", F.col("_before") + F.col("_inside") - 1)


def mix(
    docs: DataFrame, shares: DataFrame | None = None, source: str = "source", block_docs: int = 16, exponent: float = 0.5, denominator: int = 1000
) -> DataFrame:
    """Every row of ``docs`` with its place in the mixture: ``block`` of its source (from 1), the ``slot`` of that
    block in the mixture, the row's ``place`` inside the block, the block's ``release`` and ``deadline`` slots, and
    the ``weight`` used.  Reading by (slot, place) is the mixture; no row is dropped or repeated.

    ``shares`` (source, share) are target weights in whole shares, one row a source (a repeated one counts its
    largest share); sources without a positive share are given one share.  Without it, weights follow the sources'
    document counts to the power ``exponent``.  When a source runs out its later slots stay unused and the rest go
    on in order.  A null source is the same as an empty one; rows with null or equal ids rank by what is left to
    compare; an empty table gives no rows.  Input columns named like an output column are left out.
    """
    kept = [c for c in docs.columns if c not in OUTPUT]
    rows = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), F.col("doc_id").alias("_id"), F.struct(*kept).alias("_row"))
    if shares is None:
        wanted = temperature_shares(rows, F.col("_source"), exponent, denominator)
    else:
        given = shares.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.max("share").cast("int").alias("share"))
        seen = rows.select(F.col("_source").alias("source")).distinct()
        wanted = given.where("share > 0").join(seen, "source", "full").select("source", F.coalesce("share", F.lit(1)).alias("share"))
    cycle = materialize(period(wanted).withColumnRenamed("source", "_source"), "cycle")
    placed = ranked(rows).withColumn("_block", F.floor(F.col("_rank") / block_docs)).withColumn("place", (F.col("_rank") % block_docs).cast("int"))
    lengths = cycle.select("_source", "share", "total").distinct()
    placed = join_few(placed, lengths, ["_source"], F.col("_rank"), BROADCAST_ROWS).withColumn("turn", F.col("_block") % F.col("share"))
    placed = join_few(placed, cycle.select("_source", "turn", F.col("slot").alias("_slot")), ["_source", "turn"], F.col("_rank"), BROADCAST_ROWS)
    done, total, share = F.col("_block"), F.col("total").cast("long"), F.col("share")
    return placed.select(
        "_row.*",
        (done + 1).alias("block"),
        (F.floor(done / share) * total + F.col("_slot")).alias("slot"),
        "place",
        F.floor(done * total / share).alias("release"),
        F.ceil((done + 1) * total / share).alias("deadline"),
        (share / total).alias("weight"),
    )

"""Extension of elements to both sides, and their boundaries.

All elements and both sides advance together, a window a round.  The state is three tables of constant size: spans
(query, hit_id and how far each hit reaches by now), members (the sequences that a side still looks at) and sides
(query, side, how far, whether it goes on).  A round cuts the members' next windows from the genome, aligns them,
masks rare bases, drops gap columns, crops the sequences' ends by gaps, drops sequences that lose most of their
window, and asks the consensus whether the boundary is inside.  Windows are cut and state is kept by operators over all
elements at once; what is asked of an alignment, which is bounded, is worked out in one task over its letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import fetch
from .progressive import aligned_groups, over_groups
from .scratch import drop, written

#: Codes of an alignment's letters: the bases 0 to 3, others 4.
GAP = 5
CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate("acgt"):
    CODES[ord(_c)] = CODES[ord(_c.upper())] = _i
CODES[ord("-")] = GAP

#: Sequences of an element that are aligned, the longest ones.
ALIGNED = 100


@dataclass(frozen=True)
class Limits:
    """step: letters that a round adds; longest: letters after which a side stops; least: sequences that a side needs;
    rare, gap, check, similarity: masking and gap columns; crop_gap, crop_window: end crop; large: cropped share at which
    a sequence is dropped; threshold, window, ambiguous, buffer: consensus and boundary; columns: what an alignment needs;
    final_window, final_ambiguous: the boundary in the end, which is sought more narrowly."""

    step: int = 1000
    longest: int = 7000
    least: int = 5
    rare: float = 0.08
    gap: float = 0.6
    check: float = 0.4
    similarity: float = 0.7
    crop_gap: float = 0.1
    crop_window: int = 250
    large: float = 0.9
    threshold: float = 0.8
    window: int = 150
    ambiguous: float = 0.35
    buffer: int = 400
    columns: int = 50
    final_window: int = 4
    final_ambiguous: float = 0.0

    @property
    def ahead(self) -> int:
        """What a round advances by: windows overlap."""
        return self.step - round(self.step / 10)


def outward(side: Column, strand: Column) -> Column:
    """Whether a side of an element lies towards smaller coordinates."""
    return (side == "left") == (strand != "-")


def next_window(side: Column, strand: Column, start: Column, end: Column, limits: Limits, round_: int) -> tuple[Column, Column]:
    """The window of a round (from 1) beside a hit: it ends ``round_`` steps outside and overlaps the one before."""
    far = limits.ahead * round_
    near = limits.step - far + round(limits.step / 10)
    low = outward(side, strand)
    return F.when(low, start - far).otherwise(end - 1 - near), F.when(low, start + 1 + near).otherwise(end + far)


def _runs_within(flags: np.ndarray, window: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of flags: whether any ``window`` cells in a row hold ``most`` at most, where the first such run begins,
    and where the last one ends, both 0 without one."""
    if flags.shape[1] < window:
        return np.zeros(len(flags), bool), np.zeros(len(flags), np.int64), np.zeros(len(flags), np.int64)
    sums = np.cumsum(np.pad(flags.astype(np.int64), ((0, 0), (1, 0))), axis=1)
    good = sums[:, window:] - sums[:, :-window] <= most
    return good.any(1), good.argmax(1), np.where(good.any(1), good.shape[1] - good[:, ::-1].argmax(1) + window - 1, 0)


def _base_counts(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each column: the four bases' counts, all bases, and the largest share of one."""
    counts = np.stack([np.count_nonzero(table == b, axis=0) for b in range(4)])
    total = counts.sum(0)
    return counts, total, counts.max(0) / np.maximum(1, total)


def judge(seqs: list[str], limits: Limits, window: int, ambiguous: float, buffer: int) -> list[tuple] | None:
    """What an alignment says, a row for each of its sequences: stays, extend_left, extend_right, stop, columns, and how
    many letters lie before the boundary (before) and up to its end (upto); None with too few columns.

    The steps are ``mask_rare``, ``gap_filter``, ``crop_gaps``, ``apply_crop`` and ``consensus_boundary`` of
    operators.alignment, over the letters of one alignment: no cell of it is a row anywhere.
    """
    table = CODES[np.array([np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in seqs])]
    n, letters = len(table), table != GAP
    counts, total, _ = _base_counts(table)
    rare = np.vstack((counts / np.maximum(1, total) < limits.rare, np.zeros((2, table.shape[1]), bool)))
    masked = np.where(rare[table, np.arange(table.shape[1])], np.uint8(GAP), table)
    _, _, share = _base_counts(masked)
    gaps = np.count_nonzero(masked == GAP, axis=0)
    kept = np.flatnonzero((n - gaps >= limits.least) & (gaps / n <= limits.gap) & ((gaps / n < limits.check) | (share >= limits.similarity)))
    length = len(kept)
    if not length or length < limits.columns:
        return None
    cells = masked[:, kept]
    # shares of gaps are compared as the operators do
    most = max((k for k in range(limits.crop_window + 1) if k / limits.crop_window <= limits.crop_gap), default=-1)
    _, start, end = _runs_within(cells == GAP, limits.crop_window, most)
    cells = np.where((np.arange(length) >= start[:, None]) & (np.arange(length) < end[:, None]), cells, np.uint8(GAP))
    _, total, share = _base_counts(cells)
    unclear = ~((total > 0) & (total >= limits.least) & (share >= limits.threshold))
    (any_,), (first,), (last,) = _runs_within(unclear[None, :], window, ambiguous * window)
    first, last = (int(first), int(last)) if any_ else (length, 1)
    inside = first < last
    low, high = (kept[first], kept[last - 1] + 1) if inside else (0, 0)
    stays = length - (end - start) <= limits.large * length
    before, upto = (np.count_nonzero(letters[:, :at], axis=1).tolist() for at in (low, high))
    same = (inside and first <= buffer, inside and last >= length - buffer, not inside, last - first if inside else 0)
    return [(stay, *same, b, u) for stay, b, u in zip(stays.tolist(), before, upto, strict=True)]


_JUDGED = "msa_id, hit_id, stays boolean, extend_left boolean, extend_right boolean, stop boolean, columns long, before long, upto long"


def _judged(rows: DataFrame, limits: Limits, window: int, ambiguous: float, buffer: int, aligned: bool = True) -> DataFrame:
    """(msa_id, hit_id, ...): :func:`judge` of alignments (msa_id, seq_id, seq) with enough columns.  What is not
    ``aligned`` yet is, in the same task, so that no alignment is shuffled or written."""

    def work(groups: list[list[tuple]]) -> list[tuple]:
        made = [[row[2] for row in g] for g in groups] if aligned else aligned_groups(groups)
        judged = (judge(seqs, limits, window, ambiguous, buffer) or [] for seqs in made)
        return [(*row[:2], *facts) for g, found in zip(groups, judged, strict=True) for row, facts in zip(g, found)]

    return over_groups(rows, "msa_id", work, _JUDGED, None if aligned else ALIGNED)


def extend_ends(hits: DataFrame, genome: DataFrame, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """Extend the elements of ``hits`` (query, hit_id, chrom, start, end, strand) in ``genome`` (chrom, seq).

    Returns spans (query, hit_id, chrom, start, end, strand) and sides (query, side, extension, rounds, sequences,
    to_longest).  A side stops when its boundary is inside the window, with fewer than ``least`` sequences left, when too
    few columns can be compared, or after ``longest`` letters (to_longest).  Sequences that lose most of a window leave
    the side, but keep the coordinates of that round.  Windows are clamped to their sequence; hits on sequences that the
    genome lacks, and rows with a null, take no part; queries without enough hits have rounds 0.
    """
    genome = written(genome)  # read in each round
    found = _extend(hits, genome, limits or Limits())
    drop(genome)
    return found


def _extend(hits: DataFrame, genome: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """:func:`extend_ends` in a written genome.  Tables of a round are deleted when no later round reads them."""
    lengths = genome.select("chrom", F.length("seq").cast("long").alias("_length"))
    hits = hits.select("query", "hit_id", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand").dropna()
    hits = written(hits.join(lengths, "chrom"))
    both = F.explode(F.array(F.lit("left"), F.lit("right")))
    sides = hits.groupBy("query").agg(F.count("*").alias("sequences")).select("query", both.alias("side"), "sequences")
    zero = F.lit(0).cast("long")
    sides = written(sides.select("query", "side", zero.alias("extension"), F.lit(0).alias("rounds"), "sequences", (F.col("sequences") >= limits.least).alias("active")))
    members = hits.select("query", "hit_id", "chrom", "start", "end", "strand", "_length", both.alias("side"))
    reach = hits.select("query", "hit_id", "start", "end")
    for round_ in range(1, -(-limits.longest // limits.ahead) + 1):
        low, high = next_window(F.col("side"), F.col("strand"), F.col("start"), F.col("end"), limits, round_)
        looked = members.join(sides.where("active").select("query", "side"), ["query", "side"])
        looked = looked.withColumns({"_low": F.greatest(zero, low), "_high": F.least(F.col("_length"), high)})
        # what is left of a window at the end of its sequence may be too short to hold a letter
        looked = written(looked.where("_low < _high").withColumn("msa_id", F.concat_ws("/", F.col("query").cast("string"), "side")))
        cut = fetch(looked.select("msa_id", "hit_id", "chrom", F.col("_low").alias("start"), F.col("_high").alias("end"), "strand"), genome)
        # written, so that the genome's shuffle is gone before the windows are dealt again
        cut = written(cut.select("msa_id", F.col("hit_id").alias("seq_id"), "seq"))
        stay = written(_judged(cut, limits, limits.window, limits.ambiguous, limits.buffer, aligned=False))
        asked = stay.groupBy("msa_id", "extend_left", "extend_right", "stop").agg(F.count_if("stays").alias("left"))
        names = looked.select("msa_id", "query", "side").distinct()
        asked = written(asked.join(names, "msa_id"))
        # all sequences of an alignment that could be compared move, those that leave for the last time
        moved = looked.join(stay.select("msa_id", "hit_id"), ["msa_id", "hit_id"]).select("query", "hit_id", F.when(outward(F.col("side"), F.col("strand")), F.col("_low")).alias("_s"), F.when(~outward(F.col("side"), F.col("strand")), F.col("_high")).alias("_e"))
        moved = moved.groupBy("query", "hit_id").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        past = [cut, asked, sides, stay, looked, *([reach, members] if round_ > 1 else [])]
        reach = written(reach.join(moved, ["query", "hit_id"], "left").select("query", "hit_id", F.least("start", "_s").alias("start"), F.greatest("end", "_e").alias("end")))
        further = F.when(F.col("side") == "left", F.col("extend_left")).otherwise(F.col("extend_right")) & ~F.col("stop") & (F.col("left") >= limits.least)
        met = sides.join(asked.select("query", "side", "left", further.alias("_further")), ["query", "side"], "left")
        done = F.col("active") & F.col("_further").isNotNull()
        sides = written(
            met.select(
                "query", "side", F.when(done, limits.ahead * round_).otherwise(F.col("extension")).cast("long").alias("extension"), F.when(done, round_).otherwise(F.col("rounds")).alias("rounds"),
                F.when(done, F.col("left")).otherwise(F.col("sequences")).alias("sequences"), (done & F.col("_further")).alias("active"),
            )
        )
        gone = looked.join(stay.where("not stays").select("msa_id", "hit_id"), ["msa_id", "hit_id"]).select("query", "side", "hit_id")
        members = written(members.join(gone, ["query", "side", "hit_id"], "left_anti"))
        drop(*past)
        if sides.where("active").isEmpty():
            break
    spans = reach.join(hits.select("query", "hit_id", "chrom", "strand"), ["query", "hit_id"])
    return spans.select("query", "hit_id", "chrom", "start", "end", "strand"), sides.withColumnRenamed("active", "to_longest")


def boundaries(spans: DataFrame, genome: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(query, hit_id, chrom, start, end, strand, columns): each sequence's part of its element, from the boundaries of
    the consensus over the whole extended sequences; columns is the consensus' length.  Elements whose bounds cross, and
    sequences without a letter between them, have no row."""
    limits = limits or Limits()
    named = spans.withColumn("msa_id", F.col("query").cast("string"))
    cut = fetch(named.select("msa_id", "hit_id", "chrom", "start", "end", "strand"), genome, drop_other=False)
    cut = written(cut.select("msa_id", F.col("hit_id").alias("seq_id"), "seq"))
    judged = _judged(cut, limits, limits.final_window, limits.final_ambiguous, 0, aligned=False)
    at = judged.where("not stop and before < upto").select("msa_id", "hit_id", "columns", F.col("before").alias("_a"), F.col("upto").alias("_b"))
    met = named.join(at, ["msa_id", "hit_id"])
    minus = F.col("strand") == "-"
    low = F.when(minus, F.col("end") - F.col("_b")).otherwise(F.col("start") + F.col("_a"))
    high = F.when(minus, F.col("end") - F.col("_a")).otherwise(F.col("start") + F.col("_b"))
    return met.select("query", "hit_id", "chrom", low.alias("start"), high.alias("end"), "strand", "columns")


def extend_in_rounds(hits: DataFrame, genome: DataFrame, limits: Limits | None = None, edge: int = 20) -> DataFrame:
    """(query, hit_id, chrom, start, end, strand, columns, rounds): boundaries after extension, and after one more,
    shorter extension of the elements whose boundary still lies within ``edge`` of the extended sequences' ends."""
    limits = limits or Limits()
    genome = written(genome)
    spans, sides = _extend(hits, genome, limits)
    spans = written(spans)
    found = written(boundaries(spans, genome, limits))
    near = found.join(spans.select("query", "hit_id", F.col("start").alias("_s"), F.col("end").alias("_e")), ["query", "hit_id"])
    close = near.groupBy("query").agg((F.percentile_approx(F.least(F.col("start") - F.col("_s"), F.col("_e") - F.col("end")), 0.5) <= edge).alias("again")).where("again").select("query")
    close = written(close)
    rounds = sides.groupBy("query").agg(F.max("rounds").alias("rounds"))
    if not close.isEmpty():
        once = Limits(**{**limits.__dict__, "longest": limits.ahead})
        more, _ = _extend(spans.join(close, "query", "left_semi"), genome, once)
        found = found.join(close, "query", "left_anti").unionByName(boundaries(written(more), genome, limits))
    return found.join(rounds, "query")

"""Sequence functions as column expressions, and the few kernels that need a scan of their own (Arrow batches)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters of nucleotides and their complements, ambiguity codes included.
LETTERS = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
COMPLEMENTS = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), LETTERS, COMPLEMENTS)


def flipped(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """Coordinates of [start, end) on the other strand."""
    return length - end, length - start


def kmers(seq: Column, k: int = 2) -> Column:
    """The set of substrings of ``k`` letters; empty for shorter sequences."""
    places = F.sequence(F.lit(1), F.length(seq) - k + 1)
    return F.when(F.length(seq) >= k, F.array_distinct(F.transform(places, lambda i: F.substring(seq, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, k: int = 2) -> Column:
    """Jaccard index of the k-mer sets in upper case; 0 if either is empty."""
    x, y = kmers(F.upper(a), k), kmers(F.upper(b), k)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def clipped(seq: Column, start: Column, stop: Column) -> Column:
    """Letters of [start, stop), clamped."""
    low = F.greatest(F.lit(0), start)
    return F.substring(seq, (low + 1).cast("int"), F.greatest(F.lit(0), F.least(stop, F.length(seq)) - low).cast("int"))


def top_base_share(seq: Column) -> Column:
    """The share of the most frequent letter of ACGT; 0 for an empty sequence."""
    count = lambda b: F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit("")))
    return F.when(F.length(seq) > 0, F.greatest(*(count(b) for b in "ACGT")) / F.length(seq)).otherwise(0.0)


def header_suffix(header: Column, suffix: str) -> Column:
    """Add a suffix to the name in front of the class."""
    return F.regexp_replace(header, r"^([^#]*)", f"$1_{suffix}")


def header_name(header: Column) -> Column:
    """The sanitised name of a library header ``name#class description``."""
    first = F.when(header.contains("#"), F.split_part(header, F.lit("#"), F.lit(1))).otherwise(F.regexp_extract(header, r"^(\S*)", 1))
    dots = F.regexp_replace(first, r"\.\.\.", "_")
    return F.when(header.contains("#"), F.regexp_replace(dots, r"[/ \-:|]", "_")).otherwise(F.regexp_replace(dots, r"[/ \-:]", "_"))


def header_class(header: Column) -> Column:
    """What follows # up to a blank; Unknown without."""
    found = F.regexp_extract(header, r"#(\S+)", 1)
    return F.when(found == "", "Unknown").otherwise(found)


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Later occurrences of a name get ``_n`` and their number."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("_k", k).withColumn(name, F.when(F.col("_k") > 1, F.concat(name, F.lit("_n"), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_k")


def display_name(name: Column) -> Column:
    """The curation view's sanitising: slashes become two underscores, other awkward signs one."""
    return F.regexp_replace(F.regexp_replace(name, r"[/\\]", "__"), r'[ |<:"*?]', "_")


def file_class(te_class: Column, sign: str = "__") -> Column:
    return F.replace(te_class, F.lit("/"), F.lit(sign))


def final_class(new_class: Column, input_class: Column) -> Column:
    """The new class unless it is missing or unknown."""
    return F.when(new_class.isNull() | (new_class == "NaN") | F.lower(new_class).contains("unknown"), input_class).otherwise(new_class)


def plain_int(text: Column) -> Column:
    """An integer in parentheses or not."""
    return F.regexp_replace(text, "[()]", "").try_cast("bigint")


def plain_strand(strand: Column) -> Column:
    return F.when(strand == "C", "-").otherwise(strand)


def repeat_length(strand: Column, start: Column, end: Column, left: Column) -> Column:
    """Length on the repeat's side of an annotation row, whose columns are swapped on the complement strand."""
    return F.when(strand == "C", F.abs(end - left) + 1).otherwise(F.abs(end - start) + 1)


def repeat_coverage(strand: Column, start: Column, end: Column, left: Column) -> Column:
    whole = F.when(strand == "C", end + start).otherwise(end + left)
    return repeat_length(strand, start, end, left) / whole * 100


def size_text(n: Column) -> Column:
    """Bases with a unit and one decimal, rounded half to even."""
    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit(" bp")))
        .when(n < 1_000_000, F.format_string("%.1f Kbp", F.bround(n / 1_000, 1)))
        .when(n < 1_000_000_000, F.format_string("%.1f Mbp", F.bround(n / 1_000_000, 1)))
        .otherwise(F.format_string("%.1f Gbp", F.bround(n / 1_000_000_000, 1)))
    )


def share_text(share: Column) -> Column:
    """Percent with two decimals, scientific below 0.01 %."""
    return F.when(share * 100 < 0.01, F.format_string("%.2e%%", share * 100)).otherwise(F.format_string("%.2f%%", share * 100))


def score_bucket(score: Column) -> Column:
    return F.when(score < 40, "<40").when(score < 50, "40-50").when(score < 80, "50-80").when(score < 200, "80-200").otherwise(">=200")


def run_stamp(time: Column) -> Column:
    """The name of a run by its start: YYYYmmdd_HHMMSS."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def duration_text(seconds: Column) -> Column:
    """Whole seconds as H:MM:SS."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s / 60) % 60), two(s % 60))


def oriented(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Start, end and direction of a feature whose ends may be swapped."""
    return F.least(start, end), F.greatest(start, end), F.when(start > end, "-").otherwise("+")


def domain_span(orf_start: Column, orf_end: Column, direction: Column, aa_start: Column, aa_end: Column) -> tuple[Column, Column]:
    """Nucleotides of a protein domain inside a reading frame, mirrored on the minus strand."""
    plus = orf_start + 3 * aa_start - 3, orf_start + 3 * aa_end - 1
    minus = orf_end - 3 * aa_end + 1, orf_end - 3 * aa_start + 3
    return tuple(F.when(direction == "-", m).otherwise(p) for p, m in zip(plus, minus, strict=True))


def protein_hit_span(orf_start: Column, orf_end: Column, aa_start: Column, aa_end: Column) -> tuple[Column, Column]:
    """The same for best protein hits, which count from the lower coordinate on both strands."""
    low = F.least(orf_start, orf_end)
    return low + 3 * (aa_start - 1), low + 3 * (aa_end - 1)


def protein_class(text: Column) -> Column:
    """Protein classes under their shown names; the order of the replacements matters."""
    for old, new in (("DNA/Maverick", "MAV/Maverick"), ("DNA/Crypton", "CRY/Crypton"), ("LINE/Penelope", "PLE/Penelope"), ("LTR/DIRS", "DIRS/DIRS"), ("^DNA", "TIR")):
        text = F.regexp_replace(text, old, new)
    return text


def start_motif(seq: Column, start: Column, patterns: list[str], reach: int = 15, helitron: bool = False) -> Column:
    """struct(pattern, matched, position) of the motif at a start.

    The first pattern is taken if it fits at the start, or else at its leftmost place within ``reach``, to which the
    start moves; a later pattern counts only if it fits at the start and the first was found nowhere, and leaves
    ``matched`` false.  Without any, the pattern is the text False.  The leading A of helitron motifs is no part of
    the element.
    """
    low = F.greatest(F.lit(0), start - reach)
    at = F.locate(patterns[0], clipped(seq, low, start + reach))
    moved = low + at - 1 + (1 if helitron and patterns[0].upper().startswith("A") else 0)
    return _motif(lambda p: clipped(seq, start, start + len(p)) == p, at > 0, moved, start, patterns)


def end_motif(seq: Column, end: Column, patterns: list[str], reach: int = 15, helitron: bool = False) -> Column:
    """The same for what ends at ``end``; the rescue takes the rightmost place, and the last T of helitron motifs is no
    part of the element."""
    low = F.greatest(F.lit(0), end - reach)
    near = clipped(seq, low, end + reach)
    at = F.locate(patterns[0][::-1], F.reverse(near))
    moved = low + F.length(near) - at + 1 - (1 if helitron and patterns[0].upper().endswith("T") else 0)
    return _motif(lambda p: clipped(seq, end - len(p), end) == p, at > 0, moved, end, patterns)


def _motif(fits, rescue: Column, moved: Column, here: Column, patterns: list[str]) -> Column:
    pattern = F.when(fits(patterns[0]) | rescue, patterns[0])
    for p in patterns[1:]:
        pattern = pattern.when(fits(p), p)
    position = F.when(fits(patterns[0]), here).when(rescue, moved).otherwise(here)
    return F.struct(pattern.otherwise("False").alias("pattern"), (fits(patterns[0]) | rescue).alias("matched"), position.alias("position"))


def wrapped(text: Column, width: int = 70) -> Column:
    """Break a text into lines of at most ``width`` signs, at blanks."""
    return F.regexp_replace(F.regexp_replace(F.concat(text, F.lit(" ")), f"(.{{1,{width}}})\\s+", "$1\n"), r"\n$", "")


# Kernels.


def align_local(a: str, b: str, match: float = 2.0, mismatch: float = -1.0, gap_open: float = -1.0, gap_extend: float = -0.5) -> tuple[float, float, float, float]:
    """Score, identity and both coverages (percent, two decimals) of the best local alignment with affine gaps; of equal
    ones the first that ends, letters of ``a`` before those of ``b``; a pair of letters goes before a gap in ``b``, and
    that before one in ``a``.

    Row by row, in memory linear in ``b``: each cell carries where its alignment begins, its columns and its equal
    letters, so there is no way back to walk.  A gap along the row is a running maximum, as extending one is never
    worse than closing and opening another.
    """
    return align_local_all([(a, b)], match, mismatch, gap_open, gap_extend)[0]


def align_local_all(pairs: list[tuple[str, str]], match: float = 2.0, mismatch: float = -1.0, gap_open: float = -1.0, gap_extend: float = -0.5, cells: int = 1 << 14) -> list[tuple[float, float, float, float]]:
    """:func:`align_local` of many pairs; those of similar length advance together, ``cells`` of a row at a time."""
    out = [(0.0, 0.0, 0.0, 0.0)] * len(pairs)
    order = sorted((k for k, (a, b) in enumerate(pairs) if a and b), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    while order:
        size = max(1, cells // len(pairs[order[0]][1]))
        size = max(1, min(size, cells // len(pairs[order[min(size, len(order)) - 1]][1])))
        some, order = order[:size], order[size:]
        for k, found in zip(some, _align_rows([pairs[k] for k in some], match, mismatch, gap_open, gap_extend), strict=True):
            out[k] = found
    return out


def _align_rows(pairs: list[tuple[str, str]], match: float, mismatch: float, gap_open: float, gap_extend: float) -> list[tuple[float, float, float, float]]:
    n, m = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    size, high, wide = len(pairs), int(n.max()), int(m.max())
    x, y = np.zeros((size, high), np.int16), np.full((size, wide), -1, np.int16)
    for k, (a, b) in enumerate(pairs):
        x[k, : n[k]], y[k, : m[k]] = (np.frombuffer(t.encode("latin-1", "replace"), np.uint8) for t in (a, b))
    places, own = np.arange(wide + 1), np.arange(size)
    there = places <= m[:, None]
    h, e = np.zeros((size, wide + 1)), np.full((size, wide + 1), -np.inf)
    hs = np.zeros((4, size, wide + 1), np.int64)  # first row, first column, equal letters, columns
    hs[1] = places
    es = hs.copy()
    best, found = np.zeros(size), np.zeros((6, size), np.int64)
    for i in range(1, high + 1):
        opens = h + gap_open >= e + gap_extend
        e = np.where(opens, h + gap_open, e + gap_extend)
        es = np.where(opens, hs, es)
        es[3] += 1
        e[:, 0] = -np.inf
        same = y == x[:, i - 1 : i]
        pair = np.full((size, wide + 1), -np.inf)
        pair[:, 1:] = h[:, :-1] + np.where(same, match, mismatch)
        ps = np.concatenate((hs[:, :, :1], hs[:, :, :-1]), axis=2)
        ps[2, :, 1:] += same
        ps[3] += 1
        body = np.maximum(np.maximum(pair, e), 0.0)
        body[:, 0] = 0.0
        bs = np.where(pair >= e, ps, es)
        # a gap in a from cell k costs gap_open and gap_extend for each further column
        lead = body + gap_open - gap_extend * (places + 1)
        reach = np.maximum.accumulate(lead, axis=1)
        source = np.maximum.accumulate(np.where(lead >= reach, places, 0), axis=1)
        f = np.full((size, wide + 1), -np.inf)
        f[:, 1:] = reach[:, :-1] + gap_extend * places[1:]
        source = np.concatenate((np.zeros((size, 1), np.int64), source[:, :-1]), axis=1)
        gapped = f > body
        h = np.where(gapped, f, body)
        hs = np.where(gapped, bs[:, own[:, None], source], bs)
        hs[3] += np.where(gapped, places - source, 0)
        empty = h <= 0
        for fact, value in zip(hs, (i, places, 0, 0), strict=True):
            np.copyto(fact, value, where=empty)
        at = np.where(there, h, -1.0).argmax(1)
        top = h[own, at]
        better = (top > best) & (i <= n)
        best[better] = top[better]
        found[:, better] = np.stack([np.full(size, i), at, *hs[:, own, at]])[:, better]
    share = lambda part, whole: round(part / whole * 100, 2) if whole else 0.0
    return [
        (float(score), share(equal, columns), share(end_a - start_a, len(a)), share(end_b - start_b, len(b))) if score > 0 else (0.0, 0.0, 0.0, 0.0)
        for score, (end_a, end_b, start_a, start_b, equal, columns), (a, b) in zip(best.tolist(), found.T.tolist(), pairs, strict=True)
    ]


def local_alignment(a: Column, b: Column) -> Column:
    """struct(score, identity, coverage_a, coverage_b); null sequences align with nothing."""

    @F.pandas_udf("score double, identity double, coverage_a double, coverage_b double")
    def kernel(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align_local_all([(p or "", q or "") for p, q in zip(x, y, strict=True)]), columns=["score", "identity", "coverage_a", "coverage_b"])

    return kernel(a, b)


_COMPLEMENT = str.maketrans(LETTERS, COMPLEMENTS)


def find_orfs(seq: str, least: int = 200) -> list[tuple[int, int, str]]:
    """Stretches between stop codons of at least ``least`` nucleotides in six frames: (start, end, direction), counted
    from 1 on the plus strand, start after end on the minus strand."""
    out = []
    for direction, text in (("+", seq.upper()), ("-", seq.upper().translate(_COMPLEMENT)[::-1])):
        for frame in range(3):
            begin, codons = frame, len(text) - frame
            end = frame + codons // 3 * 3
            stops = [i for i in range(frame, end, 3) if text[i : i + 3] in ("TAA", "TAG", "TGA")]
            for stop in [*stops, end]:
                if stop - begin >= least:
                    out.append((begin + 1, stop, "+") if direction == "+" else (len(text) - begin, len(text) - stop + 1, "-"))
                begin = stop + 3
    return sorted(out, key=lambda o: (min(o[:2]), o[2]))


def orfs(rows: DataFrame, name: str = "name", seq: str = "seq", least: int = 200) -> DataFrame:
    """(name, orf_start, orf_end, direction, orf_name)."""

    @F.pandas_udf("array<struct<orf_start:int,orf_end:int,direction:string>>")
    def kernel(x: pd.Series) -> pd.Series:
        return x.map(lambda s: [dict(zip(("orf_start", "orf_end", "direction"), o, strict=True)) for o in find_orfs(s or "", least)])

    found = rows.select(name, F.posexplode(kernel(F.col(seq))).alias("k", "o"))
    return found.select(name, "o.*", F.concat(F.lit("ORF"), (F.col("k") + 1).cast("string")).alias("orf_name"))


def _tail_place(tail: Column, pattern: str, least: int) -> tuple[Column, int]:
    """Where a reversed tail first holds a run of the pattern (from 1; 0: nowhere), and how far behind its first letter
    the run's value is.

    A run of one letter has ``least`` of them, or 5 and more, one other letter and as many again as make ``least`` with
    it; another letter must follow.  A longer pattern is repeated ``least`` times.
    """
    if len(pattern) > 1:
        return F.regexp_instr(tail, F.lit(f"(?:{pattern[::-1]}){{{least}}}")), (least - 1) * len(pattern) - 1
    broken = [f"{pattern}{{{n}}}[^{pattern}]{pattern}{{{least - 1 - n},}}" for n in range(5, least)]
    return F.regexp_instr(tail, F.lit(f"(?:{'|'.join([f'{pattern}{{{least},}}', *broken])})(?=[^{pattern}])")), 0


def poly_tail(seq: Column, patterns: tuple[str, ...] = ("A",), least: int = 10) -> Column:
    """Where the run of a pattern ends that is nearest to the end in the last two fifths of a sequence; patterns in order
    of priority, null without any.  For a single letter that is the index of the run's last letter, for a longer pattern
    the exclusive end of the front one of ``least`` repeats."""
    tail = F.reverse(F.upper(F.right(seq, F.floor(F.length(seq) / 2.5).cast("int"))))
    ends = []
    for pattern in patterns:
        place, back = _tail_place(tail, pattern.upper(), least)
        ends.append(F.when(place > 0, F.length(seq) - place - back))
    return F.coalesce(*ends).cast("int")

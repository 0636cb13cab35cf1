"""Progressive multiple alignment: a guide tree over shared k-mers, then profile against profile, from the leaves up.

One alignment's sequences are bounded by the down-sampling of hits before it; Spark deals the alignments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("acgt"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i


def kmer_distances(seqs: list[np.ndarray], k: int = 4) -> np.ndarray:
    """One less the share of k-mers that two sequences (codes) have in common, of the shorter one's."""
    counts = np.zeros((len(seqs), 5**k), np.int32)
    for row, s in zip(counts, seqs, strict=True):
        if len(s) >= k:
            words = sum(s[i : len(s) - k + 1 + i].astype(np.int64) * 5 ** (k - 1 - i) for i in range(k))
            np.add.at(row, words, 1)
    sizes = counts.sum(1)
    shared = np.array([np.minimum(row, counts).sum(1) for row in counts])
    return 1 - shared / np.maximum(1, np.minimum(sizes[:, None], sizes[None, :]))


def guide_tree(distances: np.ndarray) -> list[tuple[int, int]]:
    """Merges of the average-linkage tree; leaves are 0 to n - 1, the i-th merge makes node n + i.  Ties go to the
    smaller indexes."""
    n = len(distances)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    node, weight, merges = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        merges.append((node[i], node[j]))
        row = (weight[i] * d[i] + weight[j] * d[j]) / (weight[i] + weight[j])
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        node[i], weight[i] = n + step, weight[i] + weight[j]
    return merges


def _shares(rows: np.ndarray) -> np.ndarray:
    """Shares of the four bases in each column; what is left are gaps and other letters."""
    return np.stack([(rows == b).mean(0) for b in range(4)], axis=1)


def align_profiles(a: np.ndarray, b: np.ndarray, match: float = 2.0, mismatch: float = -1.5, gap: float = 3.0, ends: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers of both alignments (rows of codes, gaps 5), -1 for a new gap column, of a best global alignment of
    their columns.  A gap costs ``gap`` times the letters that stand against it, at the ends ``ends`` times that.
    """
    return align_all_profiles([(a, b)], match, mismatch, gap, ends)[0]


def align_all_profiles(pairs: list[tuple[np.ndarray, np.ndarray]], match: float = 2.0, mismatch: float = -1.5, gap: float = 3.0, ends: float = 0.5, band: int = 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`align_profiles` of many pairs, which advance together, a column of the first alignments at a time.

    Cells further off the diagonal than a band are left out if no way through them can be as good as the best way
    inside, by a bound of what so many gaps cost at least; else the pair is aligned again in a band twice as wide.  So
    the result is that of all cells.  Scores are kept with what gaps along the row cost up to a column added, so such a
    gap is a running maximum.
    """
    size, n, m = len(pairs), np.array([a.shape[1] for a, _ in pairs]), np.array([b.shape[1] for _, b in pairs])
    tall, own = int(n.max()), np.arange(size)
    band = max(band, tall // 7)
    low, high = band + max(0, int((n - m).max())), band + max(0, int((m - n).max()))  # row i has the columns from i - low to i + high
    wide = low + high + 1
    long = max(tall, int(m.max()) - high) + wide
    p, q = np.zeros((4, tall, size)), np.zeros((4, long, size))
    down, across, along = np.zeros((tall, size)), np.zeros((long, size)), np.zeros((long, size))
    most = np.zeros((2, size))  # of a way that leaves the band below, above
    for k, (a, b) in enumerate(pairs):
        x, y, height, width = _shares(a), _shares(b), int(n[k]), int(m[k])
        p[:, :height, k], down[:height, k] = x.T, gap * (a < 5).mean(0)
        inside = slice(low + 1, low + 1 + width)
        q[:, inside, k], across[inside, k] = (match - mismatch) * y.T + mismatch * y.sum(1), gap * (b < 5).mean(0)
        along[low + 1 :, k] = np.cumsum(across[low + 1 :, k])
        gain = np.maximum(0, (match - mismatch) * x.max(1) + mismatch * x.sum(1))
        lost, cheap = np.sort(gain + ends * down[:height, k]), np.sort(ends * across[inside, k])
        for side, (rows, columns) in enumerate(((low + 1, low + 1 + width - height), (high + 1 - width + height, high + 1))):
            most[side, k] = gain.sum() - lost[:rows].sum() - cheap[:columns].sum() if rows <= height and columns <= width else -np.inf
    score = np.full((wide, size), -np.inf)
    score[low:] = (1 - ends) * along[low:wide]
    paired, downward = (np.zeros((tall + 1, wide, size), bool) for _ in range(2))
    pair, up, part = (np.full((wide, size), -np.inf) for _ in range(3))
    total = np.zeros(size)
    for i in range(1, tall + 1):
        span, done = slice(i, i + wide), n == i
        np.multiply(q[0, span], p[0, i - 1], out=pair)
        for f in range(1, 4):
            np.multiply(q[f, span], p[f, i - 1], out=part)
            pair += part
        pair += across[span]
        pair += score
        np.subtract(score[1:], down[i - 1], out=up[:-1])
        if i <= low:  # the column before the first one
            up[low - i] = score[low - i + 1] - ends * down[i - 1]
        at = m - i + low
        if (edge := np.flatnonzero((at >= 0) & (at < wide - 1))).size:
            up[at[edge], edge] = score[at[edge] + 1, edge] - ends * down[i - 1, edge]
        np.maximum(pair, up, out=score)
        if done.any():
            shift = np.where(done, (1 - ends) * along[span], 0.0)
            score -= shift
        step = 1
        while step < wide:  # in two tables by turns, as one that overlaps itself would be copied
            part[:step] = score[:step]
            np.maximum(score[step:], score[:-step], out=part[step:])
            score, part, step = part, score, 2 * step
        if done.any():
            score += shift
            total[done] = (score[m - n + low, own] - along[m + low, own])[done]
        np.subtract(score, 1e-7, out=part)
        np.greater_equal(pair, part, out=paired[i])
        np.greater_equal(up, part, out=downward[i])
    sure = most.max(0) < total - 1e-6
    paired, downward = paired.reshape(-1), downward.reshape(-1)
    i, j = np.where(sure, n, 0), np.where(sure, m, 0)
    left, right = (np.full((tall + int(m.max()), size), -2, np.int64) for _ in range(2))
    for step in range(len(left)):
        at = (i * wide + j - i + low) * size + own
        both = paired[at]
        rises = both | downward[at]
        back = both | (~rises & (j > 0))
        if not (rises | back).any():
            break
        i, j = i - rises, j - back
        left[step] = np.where(rises, i, -1 - ~back)
        right[step] = np.where(back, j, -1 - ~rises)
    found = [(left[left[:, k] > -2, k][::-1], right[right[:, k] > -2, k][::-1]) for k in range(size)]
    if not sure.all():
        again = np.flatnonzero(~sure)
        for k, wider in zip(again, align_all_profiles([pairs[k] for k in again], match, mismatch, gap, ends, 2 * band), strict=True):
            found[k] = wider
    return found


def _spread(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.full((len(rows), len(at)), 5, np.uint8)
    out[:, at >= 0] = rows[:, at[at >= 0]]
    return out


def align_progressive(seqs: list[str]) -> list[str]:
    """Aligned sequences in the given order, with their own letters."""
    return align_many([seqs])[0]


#: Cells of the score tables that are held at once, and alignments that advance together.
CELLS, TOGETHER = 1 << 24, 128


def _batches(work: list[tuple[int, int, int]]) -> Iterator[list[int]]:
    """Numbers of pairs (number, height, width) of similar size, as many as go together."""
    some: list[int] = []
    tall = wide = 0
    for number, n, m in sorted(work, key=lambda w: (max(w[1:]), w[0])):
        tall, wide = max(tall, n), max(wide, m)
        if some and (len(some) >= TOGETHER or (len(some) + 1) * tall * wide > CELLS):
            yield some
            some, tall, wide = [], n, m
        some.append(number)
    if some:
        yield some


def align_many(groups: list[list[str]]) -> list[list[str]]:
    """:func:`align_progressive` of many groups, of which all merges whose parts are ready go together."""
    codes = [[_CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)] for s in seqs] for seqs in groups]
    trees = [guide_tree(kmer_distances(c)) if len(c) > 1 else [] for c in codes]
    members = [{i: [i] for i in range(len(c))} for c in codes]
    rows = [{i: x[None, :] for i, x in enumerate(c)} for c in codes]
    rounds: dict[int, list[tuple[int, int, int, int]]] = {}  # merges whose parts are ready, by round
    for g, tree in enumerate(trees):
        depth = [0] * len(codes[g])
        for i, j in tree:
            depth.append(1 + max(depth[i], depth[j]))
            rounds.setdefault(depth[-1], []).append((g, i, j, len(depth) - 1))
    for _, merges in sorted(rounds.items()):
        for some in _batches([(k, rows[g][i].shape[1], rows[g][j].shape[1]) for k, (g, i, j, _) in enumerate(merges)]):
            parts = [(rows[g].pop(i), rows[g].pop(j)) for g, i, j, _ in (merges[k] for k in some)]
            for k, (a, b), (left, right) in zip(some, parts, align_all_profiles(parts), strict=True):
                g, i, j, new = merges[k]
                rows[g][new] = np.concatenate((_spread(a, left), _spread(b, right)))
                members[g][new] = members[g].pop(i) + members[g].pop(j)
    return [_lettered(seqs, next(iter(m.values())), next(iter(r.values()))) if len(seqs) > 1 else list(seqs) for seqs, m, r in zip(groups, members, rows, strict=True)]


def _lettered(seqs: list[str], order: list[int], table: np.ndarray) -> list[str]:
    """The rows of a table of codes with the sequences' own letters, in their order."""
    out = [""] * len(seqs)
    for k, row in zip(order, table, strict=True):
        letters = np.full(len(row), ord("-"), np.uint8)
        letters[row < 5] = np.frombuffer(seqs[k].encode("latin-1", "replace"), np.uint8)
        out[k] = letters.tobytes().decode("latin-1")
    return out


def column_score(rows: list[str]) -> float:
    """The mean share of equal pairs of letters over an alignment's columns, all pairs of rows counted."""
    table = np.array([np.frombuffer(r.lower().encode(), np.uint8) for r in rows])
    n = len(rows)
    equal = sum((c * (c - 1) / 2).sum() for c in ((table == ord(b)).sum(0) for b in "acgt"))
    return float(equal / (n * (n - 1) / 2) / table.shape[1]) if n > 1 else 1.0


def _in_groups(batches: Iterator[pa.RecordBatch], letters: int = 1 << 22, most: int = 128) -> Iterator[list[list[tuple]]]:
    """Whole groups of rows (key, seq_id, seq, first), some at a time; rows of a group follow each other."""
    groups: list[list[tuple]] = []
    held = 0
    for batch in batches:
        for *row, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first and groups and (held >= letters or len(groups) >= most):
                yield groups
                groups, held = [], 0
            if first:
                groups.append([])
            groups[-1].append(tuple(row))
            held += len(row[2])
    if groups:
        yield groups


def over_groups(rows: DataFrame, key: str, work: Callable[[list[list[tuple]]], list[tuple]], schema: str, most: int | None = None) -> DataFrame:
    """What ``work`` makes of whole groups, some at a time, in the task that holds them: of lists of rows (key, seq_id,
    seq) in the order of seq_id, rows that begin with a key and a seq_id.  Null and empty sequences are left out, as are
    all but the ``most`` longest of a group."""
    w, along = Window.partitionBy(key).orderBy(F.length("seq").desc(), "seq_id"), Window.partitionBy(key).orderBy("seq_id")
    # the work of a group is far above its size, so tasks are not fitted to the size
    dealt = rows.where("length(seq) > 0").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    if most is not None:
        dealt = dealt.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    firsts = dealt.select(key, "seq_id", "seq").withColumn("_first", F.row_number().over(along) == 1).sortWithinPartitions(key, "seq_id")
    names, more = [c.split()[0] for c in schema.split(", ")], schema.split(", ")[2:]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = kinds or [*batch.schema.types[:2], *(batch.schema.types[1] if c.split()[1] == kind["seq_id"] else None for c in more)]
                yield batch

        for groups in _in_groups(typed()):
            if made := work(groups):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    return firsts.mapInArrow(kernel, ", ".join([*(f"`{n}` {kind[c]}" for n, c in zip(names, (key, "seq_id"))), *more]))


def aligned_groups(groups: list[list[tuple]]) -> list[list[str]]:
    """The aligned sequences, lower case, of groups of rows (key, seq_id, seq)."""
    return align_many([[row[2].lower() for row in g] for g in groups])


def align(rows: DataFrame, key: str = "msa_id", most: int = 100) -> DataFrame:
    """(key, seq_id, seq): the aligned sequences of each group, lower case.  A group is an element's own sequences, of
    which the ``most`` longest are aligned, as the down-sampling of hits leaves no more.  Null and empty sequences are
    left out; a group of one stays as it is.  A task aligns some groups at a time."""

    def work(groups: list[list[tuple]]) -> list[tuple]:
        return [(*row[:2], seq) for g, seqs in zip(groups, aligned_groups(groups), strict=True) for row, seq in zip(g, seqs, strict=True)]

    return over_groups(rows, key, work, f"{key}, seq_id, seq string", most)

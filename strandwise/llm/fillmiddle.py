"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at unit boundaries and put into another order.

A unit is a word with the white space before it, or the white space that ends a text.  One pass over a text's bytes
counts its units and keeps a checkpoint (units, bytes, code points so far) after every ``every``-th, in pieces of
bounded size.  A cut is found by binary search among the checkpoints and a rescan of at most ``every`` units, so a
cut costs the same in a long text as in a short one.  The kernel sees each text once and hands back four offsets;
Spark puts the output together from slices of the text's bytes.  No row meets another: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle; a text that holds one is left plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINELS = re.compile(b"<[PSM]>")

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_CUTS = "struct<n: long, form: string, prefix_bytes: int, middle_bytes: int, prefix_chars: long, middle_chars: long>"


def _ends(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Offsets in (lo, hi] at which a word of ``data`` ends."""
    solid = ~_IS_SPACE[data[lo : hi + 1]]
    if hi >= len(data):
        solid = np.append(solid, False)
    return np.flatnonzero(solid[:-1] & ~solid[1:]) + lo + 1


def _chars(data: np.ndarray) -> int:
    """Code points that begin in ``data``."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Index(NamedTuple):
    """Units of a text and its checkpoints, the first of them at the start."""

    data: np.ndarray
    n: int
    chars: int
    units: np.ndarray
    bytes: np.ndarray
    points: np.ndarray

    def find(self, unit: int, step: int = 1 << 13) -> tuple[int, int]:
        """Bytes and code points before the end of the ``unit``-th unit."""
        if unit >= self.n:
            return len(self.data), self.chars
        at = int(np.searchsorted(self.units, unit, "right")) - 1
        left, lo = unit - int(self.units[at]), int(self.bytes[at])
        while left:
            hi = min(len(self.data), lo + step)
            ends = _ends(self.data, lo, hi)
            if left <= len(ends):
                lo, left = int(ends[left - 1]), 0
            else:
                left, lo = left - len(ends), hi
        return lo, int(self.points[at]) + _chars(self.data[int(self.bytes[at]) : lo])


def index(data: np.ndarray, every: int = 1024, step: int = 1 << 20) -> Index:
    """Count the units of a text's bytes and lay checkpoints, ``step`` bytes at a time."""
    seen = chars = 0
    marks = [(0, 0, 0)]
    for lo in range(0, len(data), step):
        hi = min(len(data), lo + step)
        ends = _ends(data, lo, hi)
        at, before = lo, chars
        for i in range(every - 1 - seen % every, len(ends), every):
            before += _chars(data[at : ends[i]])
            at = int(ends[i])
            marks.append((seen + i + 1, at, before))
        chars = before + _chars(data[at:hi])
        seen += len(ends)
    n = seen + int(len(data) > 0 and _IS_SPACE[data[-1]])
    units, offsets, points = np.array(marks, np.int64).T
    return Index(data, n, chars, units, offsets, points)


def _kernel(seed: int, fim_share: int, spm_share: int, every: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def cuts(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for key, text in zip(ids.to_pylist(), texts, strict=True):
            raw = text.as_buffer() if text.is_valid else b""
            found = index(np.frombuffer(raw, np.uint8), every)
            digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
            a, b, c, d = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
            if not found.n or c % 100 >= fim_share or _SENTINELS.search(raw):
                rows.append((found.n, "plain", None, None, None, None))
                continue
            first, second = sorted((a % (found.n + 1), b % (found.n + 1)))
            (p, p_chars), (m, m_chars) = found.find(first), found.find(second)
            rows.append((found.n, "spm" if d % 100 < spm_share else "psm", p, m - p, p_chars, m_chars - p_chars))
        names = ["n", "form", "prefix_bytes", "middle_bytes", "prefix_chars", "middle_chars"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return cuts


def transform(docs: DataFrame, seed: int = 42, fim_share: int = 50, spm_share: int = 80, every: int = 1024) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs`` (doc_id, text).

    The cuts, whether a text is cut at all (``fim_share`` of 100) and the order (``spm_share`` of 100 put the suffix
    first) come from a hash of ``seed`` and doc_id.  A null text is the empty one; empty texts and texts with a
    sentinel stay plain, with null lengths.  A null doc_id hashes like an empty one, rows of one doc_id share their
    hash.  Texts without a word are one unit of white space; a cut may fall on either end.  Columns other than doc_id
    and text are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    cut = F.arrow_udf(_kernel(seed, fim_share, spm_share, every), _CUTS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("cut", cut("doc_id", "text")).select("doc_id", "text", "cut.*")
    at = F.col("prefix_bytes") + F.col("middle_bytes")
    prefix = F.substring("text", 1, F.col("prefix_bytes"))
    middle = F.substring("text", F.col("prefix_bytes") + 1, F.col("middle_bytes"))
    suffix = F.substring("text", at + 1, F.octet_length("text"))
    p, s, m = (F.encode(F.lit(x), "utf-8") for x in (PREFIX, SUFFIX, MIDDLE))
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.cast("string").alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The exact text behind an output.  A sentinel occurs in no cut text and shares no end with another, so its first
    occurrence is the one that was put in."""
    size = len(PREFIX)
    middle_at = F.instr(output, MIDDLE)
    second_at = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    first = F.substring(output, F.lit(size + 1), second_at - size - 1)
    second = F.substring(output, second_at + size, middle_at - second_at - size)
    middle = F.substring(output, middle_at + size, F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))

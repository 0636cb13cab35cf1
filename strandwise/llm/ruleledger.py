"""Quality rules in a bitmask ledger.

One pass over every whole text takes integer measurements; every rule is evaluated once on them, and its failure is
one bit of a long.  The ledger (doc_id, failures, measurements) is all that later questions need: a policy is two
masks over the bits, so another version of it, the share of documents that a rule alone removes, or what a policy
would keep without a rule are bitwise expressions and counts over the ledger, and no text is read again.  A ledger has at most 2^rules different
bit patterns, so counts by pattern answer any number of policies.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_adjacent", "top_word",
    "n_upper", "n_lower", "n_marks", "n_letter_words", "n_bullets", "n_ellipses",
]
WINDOW = 8

#: Rules by bit.  Each is an expression over the measurements that is true where a text fails; Spark and other SQL
#: engines read it alike.  A text without words fails the first rule only.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines",
    "adjacent_words": "100 * n_adjacent > 15 * n_words",
    "top_word": "n_words >= 20 AND 100 * top_word > 25 * n_words",
    "capitals": "n_upper > n_lower",
    "marks": "100 * n_marks > 20 * n_words",
    "few_letters": "100 * n_letter_words < 80 * n_words",
    "bullets": "n_lines >= 5 AND 100 * n_bullets > 90 * n_lines",
    "ellipses": "n_lines >= 5 AND 100 * n_ellipses > 30 * n_lines",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


def mask(*names: str) -> int:
    return reduce(int.__or__, (BITS[n] for n in names), 0)


#: What fails a text under any policy.
BASE = mask("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Rejects a text that fails any rule of ``hard``, or more than ``most`` rules of ``soft``."""

    version: str
    hard: int
    soft: int = 0
    most: int = 0

    def rejects(self, failures: Column) -> Column:
        rejected = failures.bitwiseAND(F.lit(self.hard)) != 0
        if self.soft:
            rejected |= F.bit_count(failures.bitwiseAND(F.lit(self.soft))) > self.most
        return rejected


_SOFT = mask("short_words", "long_words", "top_word", "few_letters", "bullets", "ellipses")
POLICIES = {
    "2024-base": Policy("2024-base", BASE),
    "2025-soft": Policy("2025-soft", BASE | mask("symbols", "capitals"), _SOFT | mask("repeated_lines", "adjacent_words", "marks"), 1),
    "2026-strict": Policy("2026-strict", BASE | mask("symbols", "repeated_lines", "adjacent_words", "capitals", "marks"), _SOFT, 1),
}

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def _pieces(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """``data`` in pieces of some ``step`` bytes that end between words."""
    at = 0
    while at < len(data):
        end = at + step
        cut = _SPACE.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of WINDOW words that are found twice or more.  Windows are compared as numbers of their halves
    and quarters, so equal numbers are equal words."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    pairs, size = ids[:-1] * distinct + ids[1:], distinct * distinct
    if size >= 1 << 31:
        _, pairs = np.unique(pairs, return_inverse=True)
        size = int(pairs.max()) + 1
    values, fours = np.unique(pairs[:-2] * size + pairs[2:], return_inverse=True)
    _, which, counts = np.unique(fours[:-4] * len(values) + fours[4:], return_inverse=True, return_counts=True)
    steps = np.zeros(len(ids) + 1, np.int64)
    found = np.flatnonzero(counts[which] > 1)
    np.add.at(steps, found, 1)
    np.add.at(steps, found + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(steps)))


def measure(data: bytes) -> list[int]:
    """The measurements of one text, in the order of MEASURES; all zero for an empty one."""
    codes: defaultdict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    signs, parts = np.zeros(256, np.int64), []
    for piece in _pieces(data):
        signs += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        words = piece.split()
        parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    counts = np.bincount(ids, minlength=len(codes))
    lettered = sum(n for w, n in zip(codes, counts.tolist(), strict=True) if _LETTER.search(w))
    lines = [x for x in data.split(b"\n") if x.strip()]
    solid = [x.strip() for x in lines]
    return [
        len(ids),
        int(len(data) - signs[128:192].sum() - signs[32] - signs[9:14].sum()),
        int(signs[list(b"#*$%&|<>")].sum()),
        len(lines) - len(set(lines)),
        _repeated(ids, len(codes)),
        len(lines),
        int(np.count_nonzero(ids[1:] == ids[:-1])),
        int(counts.max(initial=0)),
        int(signs[65:91].sum()),
        int(signs[97:123].sum()),
        int(signs[33] + signs[63]),
        lettered,
        sum(x.startswith((b"-", b"*", "•".encode())) for x in solid),
        sum(x.endswith((b"...", "…".encode())) for x in solid),
    ]


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([measure((t.as_py() or "").encode()) for t in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], ["doc_id", *MEASURES])


def ledger(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, MEASURES..., failures) per row of ``docs`` (doc_id, text); bit i of failures is the i-th rule's.

    A null text is the empty one, which has no words.  Rows of one doc_id stay rows of their own; a null doc_id stays
    null; columns other than doc_id and text are not read.  No row meets another, so there is no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rejudge(rows.mapInArrow(_kernel, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)), rules)


def rejudge(ledger: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """The ledger with its failures set anew, under other rules or thresholds, from the stored measurements."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate((rules or RULES).values())]
    return ledger.withColumn("failures", reduce(Column.bitwiseOR, bits))


def verdicts(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    failures = F.col("failures")
    base = failures.bitwiseAND(F.lit(BASE)) != 0
    return ledger.withColumns({"base_failed": base, "kept": ~base & ~policy.rejects(failures), "policy": F.lit(policy.version)})


def ablations(ledger: DataFrame, policies: list[Policy] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_kept, n_only, n_kept_without) per policy and rule.

    n_failed counts texts that fail the rule, n_only those that the policy rejects for it alone, n_kept_without what
    it would keep if the rule were off.  The ledger is counted by bit pattern first; an empty one gives no rows.
    """
    patterns = ledger.groupBy("failures").agg(F.count("*").alias("n"))
    each = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(rules or RULES)]
    spread = patterns.select("failures", "n", F.inline(F.array(*each)))
    failures, bit, n = F.col("failures"), F.col("bit"), F.col("n")
    without = failures.bitwiseAND(F.bitwise_not(bit))
    parts = []
    for policy in policies if policies is not None else list(POLICIES.values()):
        now, then = policy.rejects(failures), policy.rejects(without)
        parts.append(
            spread.groupBy(F.lit(policy.version).alias("policy"), "rule").agg(
                F.sum(n).alias("n_docs"),
                F.sum(F.when(failures.bitwiseAND(bit) != 0, n).otherwise(0)).alias("n_failed"),
                F.sum(F.when(~now, n).otherwise(0)).alias("n_kept"),
                F.sum(F.when(now & ~then, n).otherwise(0)).alias("n_only"),
                F.sum(F.when(~then, n).otherwise(0)).alias("n_kept_without"),
            )
        )
    return reduce(DataFrame.unionByName, parts)

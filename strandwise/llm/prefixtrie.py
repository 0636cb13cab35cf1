"""The prefix trie of conversations, by distributed MSD radix partitioning.

Turns are dictionary-encoded: a code stands for a pair of role and text, and the dictionary is checked for codes that
two pairs share.  A conversation is a string of codes, kept in blocks of BLOCK, and a trie node is a bucket of
conversations that agree in their first codes.

Recursion starts with all conversations in one bucket.  A step deals the conversations of the large buckets by their
next codes, BLOCK depths in one job: buckets that are still large are nodes of the upper trie, counted with partial
aggregates, and what falls below ``local_convs`` members and ``local_turns`` turns is local.  A local bucket with one
member is a chain of nodes, one row of a block after the other; the others go whole to a kernel that finishes them by
multikey quicksort, whose recursion emits the nodes.  Sums over subtrees are rolled up inside a kernel's bucket and,
for the upper trie, a block of depths at a time.  Upper buckets are few, at most a ``local_convs``-th of all
conversations at each depth; members that end at one are joined into blobs in order before its digest is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_few, materialize

#: Codes in a block, and so depths in a step of the recursion.
BLOCK = 8
#: Conversations with more turns are joined apart from the others, so that one of them is not one task.
LONG = 1 << 16
#: Rows up to which a table is broadcast.
BOUND = 1 << 17

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NAMES = [x.split()[0] for x in NODE.split(", ")]
_LOCAL = ["parent_depth", "parent_lead", "next"]
_NONE = hashlib.sha256(b"").hexdigest()


class Sequences(NamedTuple):
    """Conversations: (conv_id, length), and their codes in blocks: (conv_id, block, length, codes, chars)."""

    convs: DataFrame
    blocks: DataFrame


def encode(conversations: DataFrame, seeds: int = 8) -> DataFrame:
    """(conv_id, turn, role, head, digest, code, chars) per row; code tells (role, text) apart, chars are the text's
    code points.  Codes are hashes; should two different turns share one, the next seed is taken."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), digest.alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    for seed in range(seeds):
        found = materialize(rows.withColumn("code", F.xxhash64(F.lit(seed), "digest")), "turns")
        if found.groupBy("code").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").isEmpty():
            return found
        discard(found)
    raise RuntimeError("turns share codes under every seed")


def _in_order(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their partition and place in the order by conversation and turn, and (conv_id, part, first, n, before):
    for each conversation and partition its first place, its rows, and those in earlier partitions.

    Rows are dealt by range, so a conversation that holds most of them is many tasks; only its parts are put in order.
    """
    keys = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("head").asc(), F.col("digest").asc()]
    dealt = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(dealt.select("conv_id", "code", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "placed")
    parts = placed.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def rebuild(conversations: DataFrame, family: int = 100, heads: int = 6) -> Sequences:
    """Each conversation c with the first h turns of c - c % ``family`` in place of its own first h, h = crc32(c) %
    ``heads``; fewer if that one has fewer, none if it is absent.

    Rows (conv_id, turn, role, text) are ordered by turn, null first; ties by role, then by text.  A null role or text
    is the empty one; rows with a null conv_id belong to no conversation and take no part.  Repeated rows are turns of
    their own.  Other columns are not read.
    """
    turns = encode(conversations)
    placed, parts = _in_order(turns)
    parts = materialize(parts, "parts")
    discard(turns)
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    first = sizes.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("family"), F.col("own").alias("family_own"))
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % heads
    convs = sizes.withColumns({"family": F.col("conv_id") - F.col("conv_id") % family, "h": h}).join(first, "family", "left")
    taken = F.least("h", F.coalesce("family_own", F.lit(0)))
    convs = convs.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "family", "h", "taken", "length"), "convs")

    d = (F.col("seq") - F.col("first") + F.col("before") + 1).alias("d")
    own = placed.join(parts.join(convs, "conv_id"), ["conv_id", "part"])
    own = own.select("conv_id", "length", "h", "taken", "code", "chars", d).where("d > h").withColumn("d", F.col("d") - F.col("h") + F.col("taken"))
    lent = placed.where(F.col("conv_id") % family == 0).join(parts, ["conv_id", "part"])
    lent = lent.select(F.col("conv_id").alias("family"), "code", "chars", d).where(F.col("d") < heads)
    lent = lent.join(convs, "family").where("d <= h")
    columns = ["conv_id", "length", "d", "code", "chars"]
    rebuilt = own.select(columns).unionByName(lent.select(columns))
    block = F.floor((F.col("d") - 1) / BLOCK).alias("block")
    packed = rebuilt.groupBy("conv_id", block).agg(F.first("length").alias("length"), F.sort_array(F.collect_list(F.struct("d", "code", "chars"))).alias("row"))
    blocks = materialize(packed.select("conv_id", "block", "length", F.col("row.code").alias("codes"), F.col("row.chars").alias("chars")), "blocks")
    discard(placed, parts)
    return Sequences(convs.select("conv_id", "length"), blocks)


def _step(step: int, rows: DataFrame, local_convs: int, local_turns: int) -> tuple[DataFrame, DataFrame]:
    """One step of the recursion over the conversations of large buckets: (conv_id, length, top, codes, chars), top the
    smallest member of the bucket that they are in.

    Returns the upper nodes of these depths and, per conversation, the deepest upper node that it goes through
    (parent_depth, parent_lead) with its next code, null if it ends there.
    """
    at = step * BLOCK
    each = rows.select("conv_id", "length", "top", "codes", "chars", F.explode(F.sequence(F.lit(0), F.size("codes"))).alias("j"))
    each = each.select("conv_id", "length", "top", "j", F.slice("codes", 1, F.col("j")).alias("path"), F.get("codes", F.col("j")).alias("next"), F.get("chars", F.col("j") - 1).alias("text"))
    groups = each.where("j > 0").groupBy("top", "j", "path").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("lead"), F.sum(F.col("length") - F.lit(at) - F.col("j")).alias("left"), F.first("text").alias("text")
    )
    large = materialize(groups.where((F.col("n") > local_convs) | ((F.col("n") > 1) & (F.col("left") > local_turns))).drop("left"), "large")
    met = join_few(each, large.select("top", "j", "path", "lead"), ["top", "j", "path"], F.col("conv_id"), BOUND)
    lead = F.when(F.col("j") == 0, F.col("top")).otherwise(F.col("lead"))
    deepest = met.where((F.col("j") == 0) | F.col("lead").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("j", lead.alias("lead"), "next")).alias("x"), F.first("length").alias("length"))
    found = deepest.select("conv_id", "length", (F.col("x.j") + at).cast("long").alias("parent_depth"), F.col("x.lead").alias("parent_lead"), F.col("x.next").alias("next"))
    above = large.select("top", (F.col("j") + 1).alias("j"), F.col("path").alias("above"), F.col("lead").alias("parent_lead"))
    upper = large.withColumn("above", F.slice("path", 1, F.col("j") - 1)).join(above, ["top", "j", "above"], "left")
    upper = upper.select(
        F.lit(step).alias("step"), "top", "j", "path", (F.col("j") + at).cast("long").alias("depth"), "lead", "n", "text",
        F.when(F.col("j") == 1, F.col("top")).otherwise(F.col("parent_lead")).alias("parent_lead"),
    )
    return materialize(upper, "upper"), materialize(found, "found")


def _finish(key: tuple[int, int, int], ids: list[int], starts: list[int], sizes: list[int], codes: list[int], chars: list[int]) -> list[tuple]:
    """The nodes of one local bucket: multikey quicksort over strings of codes, of which the i-th is ``sizes[i]`` codes
    from ``starts[i]``; all begin with the same one.  Rows as NODE, then whether the node is the bucket's top."""
    depth, lead, _ = key
    nodes: list[list] = []  # lead, depth, parent's index, members, text, ends

    def emit(d: int, parent: int, group: list[int]) -> int:
        nodes.append([min(ids[i] for i in group), d, parent, len(group), chars[starts[group[0]] + d - 1], [ids[i] for i in group if sizes[i] == d]])
        return len(nodes) - 1

    stack = [(list(range(len(ids))), 0, -1)]
    while stack:
        group, d, parent = stack.pop()
        if len(group) == 1:
            for d in range(d + 1, sizes[group[0]] + 1):
                parent = emit(d, parent, group)
            continue
        digits = [codes[starts[i] + d] for i in group]
        pivot = digits[len(digits) // 2]
        for part in ([i for i, x in zip(group, digits, strict=True) if x < pivot], [i for i, x in zip(group, digits, strict=True) if x > pivot]):
            if part:
                stack.append((part, d, parent))
        same = [i for i, x in zip(group, digits, strict=True) if x == pivot]
        node = emit(d + 1, parent, same)
        if rest := [i for i in same if sizes[i] > d + 1]:
            stack.append((rest, d + 1, node))

    kids, leaves, saved = ([0] * len(nodes) for _ in range(3))
    for t in range(len(nodes) - 1, -1, -1):  # children come after their parents
        _, _, parent, n, text, _ = nodes[t]
        leaves[t] += kids[t] == 0
        saved[t] += (n - 1) * text
        if parent >= 0:
            kids[parent] += 1
            leaves[parent] += leaves[t]
            saved[parent] += saved[t]
    return [
        (at, depth + d, nodes[parent][0] if parent >= 0 else lead, n, kids[t], leaves[t], saved[t], hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest(), parent < 0)
        for t, (at, d, parent, n, _, ends) in enumerate(nodes)
    ]


_OUT = pa.schema([*((n, pa.int64()) for n in _NAMES[:-1]), (_NAMES[-1], pa.string()), ("top", pa.bool_())])


def _local_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole and in order: (*_LOCAL, conv_id, block, length, codes, chars), sorted by all up to block."""

    def flush(key: tuple[int, int, int], parts: list[pa.RecordBatch]) -> list[tuple]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        conv, block, length = (rows[c].to_numpy() for c in ("conv_id", "block", "length"))
        lists = rows["codes"].combine_chunks()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        starts = offsets[new] + key[0] - BLOCK * block[new]
        return _finish(key, conv[new].tolist(), starts.tolist(), (length[new] - key[0]).tolist(), lists.flatten().to_pylist(), rows["chars"].combine_chunks().flatten().to_pylist())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    last, parts, ready = None, [], []
    for batch in batches:
        keys = [batch.column(i).to_numpy() for i in range(3)]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(int(k[lo]) for k in keys)
            if key != last and parts:
                ready += flush(last, parts)
                parts = []
                if len(ready) > 8192:
                    yield batch_of(ready)
                    ready = []
            last = key
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        ready += flush(last, parts)
    if ready:
        yield batch_of(ready)


def _blob_kernel(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """(depth, lead, conv_id) in order to (depth, lead, first, blob): ids of one node, joined."""
    for batch in batches:
        depth, lead, conv = (batch.column(i).to_numpy() for i in range(3))
        same = (depth[1:] == depth[:-1]) & (lead[1:] == lead[:-1])
        cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        at = [(i, min(hi, i + most)) for lo, hi in zip(cuts, cuts[1:]) for i in range(lo, hi, most)]
        heads = np.array([i for i, _ in at], np.int64)
        blobs = pa.array([",".join(map(str, conv[i:j].tolist())) for i, j in at], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(depth[heads]), pa.array(lead[heads]), pa.array(conv[heads]), blobs], ["depth", "lead", "first", "blob"])


def _digest_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs in order to (depth, lead, ends_sha256); one blob is held at a time."""
    last, state, ready = None, None, []
    for batch in batches:
        for depth, lead, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (depth, lead) != last:
                if last is not None:
                    ready.append((*last, state.hexdigest()))
                last, state = (depth, lead), hashlib.sha256()
            else:
                state.update(b",")
            state.update(blob.as_buffer())
    if last is not None:
        ready.append((*last, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "lead", "ends_sha256"])


def _ends(found: DataFrame) -> DataFrame:
    """(depth, lead, ends_sha256) of the upper nodes at which members end."""
    keys = ["depth", "lead", "conv_id"]
    ends = found.where(F.col("next").isNull()).select(F.col("parent_depth").alias("depth"), F.col("parent_lead").alias("lead"), "conv_id")
    blobs = ends.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_blob_kernel, "depth long, lead long, first long, blob string")
    return blobs.repartition("depth", "lead").sortWithinPartitions("depth", "lead", "first").mapInArrow(_digest_kernel, "depth long, lead long, ends_sha256 string")


def _roll_up(upper: DataFrame, steps: int) -> DataFrame:
    """(depth, lead, n_leaves, saved_tokens) over subtrees, from what each upper node adds; a step's depths at a time,
    the deepest first.  Paths of step 0 begin at the root, whose own row has an empty one."""
    done, below = [], None
    for step in reversed(range(steps)):
        rows = upper.where(F.col("step") == step).select("top", "j", "path", "leaves", "saved")
        if below is not None:
            keys = upper.where((F.col("step") == step) & (F.col("j") == BLOCK)).select("top", "j", "path", F.col("lead").alias("_lead"))
            rows = rows.unionByName(below.join(keys, F.col("lead") == F.col("_lead")).select("top", "j", "path", "leaves", "saved"))
        spread = rows.select("top", "path", "leaves", "saved", F.explode(F.sequence(F.lit(0), F.col("j"))).alias("j"))
        sums = spread.groupBy("top", "j", F.slice("path", 1, F.col("j")).alias("path")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        sums = materialize(sums, "sums")
        below = sums.where("j = 0").select(F.col("top").alias("lead"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        kept = upper.where(F.col("step") == step).join(sums, ["top", "j", "path"]).select("depth", "lead", "n_leaves", "saved_tokens")
        done.append(kept)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def nodes(seqs: Sequences, local_convs: int = 512, local_turns: int = 1 << 16) -> DataFrame:
    """The trie's nodes, as NODE: a node is named by its depth and its smallest member (conv_id), the root has depth 0
    and no parent.  n_convs counts members, n_children the next nodes, n_leaves childless nodes of the subtree,
    saved_tokens sums (n_convs - 1) * code points of the last text over it, ends_sha256 is of the decimal ids of the
    members that end here, ascending and comma-joined.  Without conversations there are no nodes.
    """
    convs, blocks = seqs
    spark = convs.sparkSession
    if not 1 <= local_convs or not 1 <= local_turns:
        raise ValueError("local buckets hold at least one conversation and turn")
    n, lead = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not n:
        return spark.createDataFrame([], NODE)
    root = spark.createDataFrame([(0, lead, 0, [], 0, lead, n, 0, None)], "step int, top long, j int, path array<long>, depth long, lead long, n long, text long, parent_lead long")
    uppers, settled = root, convs.where("length = 0").select("conv_id", "length", F.lit(0).cast("long").alias("parent_depth"), F.lit(lead).alias("parent_lead"), F.lit(None).cast("long").alias("next"))
    rows, step = blocks.where("block = 0").withColumn("top", F.lit(lead)), 0
    while rows is not None:
        upper, found = _step(step, rows, local_convs, local_turns)
        step += 1
        goes_on = (F.col("parent_depth") == step * BLOCK) & F.col("next").isNull() & (F.col("length") > step * BLOCK)
        uppers, settled = uppers.unionByName(upper), settled.unionByName(found.where(~goes_on))
        active = found.where(goes_on).select("conv_id", F.col("parent_lead").alias("top"))
        rows = None if active.isEmpty() else active.join(blocks.where(F.col("block") == step), "conv_id")

    met = settled.where(F.col("next").isNotNull()).withColumn("members", F.count("*").over(Window.partitionBy(*_LOCAL)))
    met = materialize(met, "local")
    here = F.col("block") >= F.floor(F.col("parent_depth") / BLOCK)
    usual = blocks.where(F.col("length") <= LONG).join(met.drop("length"), "conv_id")
    long = join_few(blocks.where(F.col("length") > LONG), met.where(F.col("length") > LONG).drop("length"), ["conv_id"], F.col("block"), BOUND)
    placed = usual.unionByName(long.where(F.col("members").isNotNull())).where(here)

    several = placed.where("members > 1").select(*_LOCAL, "conv_id", F.col("block").cast("long").alias("block"), "length", "codes", "chars")
    several = several.repartition(*_LOCAL).sortWithinPartitions(*_LOCAL, "conv_id", "block").mapInArrow(_local_kernel, NODE + ", top boolean")
    several = materialize(several, "finished")
    depth = F.col("block") * BLOCK + F.col("i")
    chain = placed.where("members = 1").select("conv_id", "block", "length", "parent_depth", "parent_lead", F.explode(F.sequence(F.lit(1), F.size("codes"))).alias("i"))
    last = F.col("depth") == F.col("length")
    chain = chain.withColumn("depth", depth.cast("long")).where("depth > parent_depth").select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("parent_depth") + 1, F.col("parent_lead")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.encode(F.col("conv_id").cast("string"), "utf-8"), 256)).otherwise(_NONE).alias("ends_sha256"),
    )

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    below = met.where("members = 1").select(F.col("parent_depth").alias("depth"), F.col("parent_lead").alias("lead"), one.alias("leaves"), none.alias("saved"))
    below = below.unionByName(several.where("top").select((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("lead"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    below = below.unionByName(uppers.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent_lead").alias("lead"), none.alias("leaves"), none.alias("saved")))
    below = below.groupBy("depth", "lead").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    known = uppers.join(below, ["depth", "lead"], "left").fillna(0, ["n_children", "leaves", "saved"])
    known = known.withColumns({"leaves": F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": F.col("saved") + (F.col("n") - 1) * F.col("text")})
    known = materialize(known, "known")
    top = known.join(_roll_up(known, step), ["depth", "lead"]).join(_ends(settled), ["depth", "lead"], "left")
    top = top.select(
        F.col("lead").alias("conv_id"), "depth", F.col("parent_lead").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )
    return top.unionByName(several.drop("top")).unionByName(chain)

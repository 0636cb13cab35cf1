import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandwise.llm import prefixtrie as pt

SCHEMA = "conv_id long, turn long, role string, text string, block int, lead string, n double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA)


def sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(int(c / 100) * 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in sequences(rows).items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids, leaves, saved = (defaultdict(int) for _ in range(3))
    for s in members:
        if s:
            kids[s[:-1]] += 1
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(members[s]) - 1) * (len(s[-1][1]) if s else 0)
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], digest(s)) for s, m in members.items()), key=repr)


def corpus(seed=3, n=260):
    rng = random.Random(seed)
    say = lambda k: (rng.choice(["user", "assistant", None]), f"text é{rng.randrange(k)}" * rng.randint(0, 3))
    rows, shared = [], [("system", "hello"), *(("user", f"t{i}") for i in range(30))]
    for c in range(n):
        turns = [say(2) for _ in range(rng.randint(0, 7))]
        if c % 3 == 0:
            turns = shared[: rng.randint(1, 31)] + turns[: rng.randint(0, 2)]
        if c % 7 == 0:
            turns = [*shared[:12], ("user", "the same")]
        rows += [(c * 13 if c % 2 else c, t, *x) for t, x in enumerate(turns)]
    rng.shuffle(rows)
    return rows


ODD = [
    (None, 0, "user", "nobody"), (9001, None, "user", "null turn"), (9001, 0, "user", "zero turn"), (9002, 3, None, None), (9003, 1, "user", ""), (9003, 1, "user", ""),
    (9004, 5, "b", "tie"), (9004, 5, "a", "tie"), (9004, 5, "a", "other"), (-7, 0, "user", "negative"), (-7, 1, "user", "negative again"), (9005, 0, "user", "x" * 200_000),
    *((9006, t, "user", f"long {t}") for t in range(400)), *((9106, t, "user", f"long {t}") for t in range(399)),
]


def got(spark, rows, **options):
    return sorted(map(tuple, pt.nodes(pt.rebuild(frame(spark, rows)), **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"local_convs": 3}, {"local_convs": 40, "local_turns": 100}, {"local_convs": 1}])
def test_nodes_are_those_of_the_definition(spark, options):
    rows = corpus() + [r for r in ODD if r[0] is None or r[0] not in (9006, 9106) or not options or r[1] < 30]
    assert got(spark, rows, **options) == brute(rows)


def test_long_conversations_apart_and_codes_that_collide(spark, monkeypatch):
    monkeypatch.setattr(pt, "LONG", 5)
    monkeypatch.setattr(pt, "BOUND", 2)
    rows = corpus(8)
    assert got(spark, rows, local_convs=9) == brute(rows)
    narrow = lambda seed, digest: F.when(seed == 0, F.lit(1)).otherwise(F.conv(F.substring(F.hex(digest), 1, 15), 16, 10)).cast("long")
    monkeypatch.setattr(pt.F, "xxhash64", narrow)
    assert len({r.code for r in pt.encode(frame(spark, rows)).collect()}) == len({((r[2] or ""), (r[3] or "")) for r in rows})


def test_one_conversation_may_hold_all_rows(spark):
    rows = [(100, t, "user", f"{t % 7}") for t in range(3000)] + [(101, t, "user", f"{t % 5}") for t in range(20)]
    turns = pt.rebuild(frame(spark, rows))
    assert {r.conv_id: r.length for r in turns.convs.collect()} == {c: len(s) for c, s in sequences(rows).items()}
    assert turns.blocks.where("size(codes) > 8").isEmpty()
    assert sorted(map(tuple, pt.nodes(turns).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 0, "a", "b")], [(5, 0, None, None)], [(6, 0, "u", "t")]])
def test_smallest_tables(spark, rows):
    assert got(spark, rows) == (brute(rows) if any(r[0] is not None for r in rows) else [])


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        pt.nodes(pt.rebuild(frame(spark, [(1, 0, "u", "t")])), local_convs=0)

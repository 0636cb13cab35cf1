from collections import Counter

import pytest

from strandwise.llm import mixing

SCHEMA = "doc_id long, source string, slot int, extra string"


def frame(spark, sizes):
    rows = [(1000 * k + i, s, 0, "e") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("shares", [{"a": 9, "b": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 50, "b": 31, "c": 17, "d": 2}, {"a": 1}, {f"s{k}": 1 + k * k % 11 for k in range(70)}])
def test_less_than_one_block_deviation(spark, shares):
    total = sum(shares.values())
    cycle = mixing.period(spark.createDataFrame(list(shares.items()), "source string, share int")).collect()
    order = {r.slot: r.source for r in cycle}
    assert sorted(order) == list(range(total))
    done = Counter()
    for t in range(total):
        done[order[t]] += 1
        for s, share in shares.items():
            assert abs(done[s] - (t + 1) * share / total) < 1
    assert done == shares


def earliest_deadline_first(shares):
    total, done, order = sum(shares), [0] * len(shares), []
    for t in range(total):
        waiting = [(-(-(n + 1) * total // s), k) for k, (n, s) in enumerate(zip(done, shares)) if n * total // s <= t]
        order.append(min(waiting)[1])
        done[order[-1]] += 1
    return order


@pytest.mark.parametrize("shares", [[5, 1, 1, 7, 2], [1] * 30, [1 + k * k % 13 for k in range(150)], [200] + [1] * 90])
def test_order_is_that_of_the_earliest_deadlines(spark, shares):
    names = [f"{k:04d}" for k in range(len(shares))]
    cycle = mixing.period(spark.createDataFrame(list(zip(names, shares)), "source string, share int")).collect()
    assert [int(r.source) for r in sorted(cycle, key=lambda r: r.slot)] == earliest_deadline_first(shares)


def test_very_many_sources(spark):
    """A row or two for each of 20,000 sources, and one that holds a third of all rows."""
    rows = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'host' || id % 20000 END AS source")
    got = mixing.mix(rows)
    assert got.count() == 40_000 and got.where("slot < release or slot >= deadline").count() == 0
    assert got.select("slot", "place").distinct().count() == 40_000


def test_schedules_beyond_the_broadcast_bound_are_joined_by_a_shuffle(spark, monkeypatch):
    sizes = {"a": 301, "b": 40, "c": 7, None: 5}
    want = sorted(map(tuple, mixing.mix(frame(spark, sizes), block_docs=4, denominator=50).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(frame(spark, sizes), block_docs=4, denominator=50).collect()), key=str) == want


def test_every_row_is_placed_in_its_window(spark):
    sizes = {"a": 301, "b": 40, "c": 7, None: 5}
    got = mixing.mix(frame(spark, sizes), block_docs=4, denominator=50).collect()
    assert len(got) == 353 and len({r.doc_id for r in got}) == 353
    places = [(r.slot, r.place) for r in got]
    assert len(set(places)) == 353
    for r in got:
        assert r.release <= r.slot < r.deadline and r.extra == "e"
    blocks = Counter((r.source, r.block) for r in got)
    assert all(n == 4 for (s, b), n in blocks.items() if b <= sizes[s] // 4)


def test_given_shares_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a", 0, "x"), (1, "a", 0, "x"), (1, "a", 0, "x"), (2, "b", 0, "x"), (3, "", 0, "y"), (4, None, 0, "y")], SCHEMA)
    shares = spark.createDataFrame([("a", 3), ("a", 1), ("z", 2), ("b", 0), ("b", None)], "source string, share int")
    got = mixing.mix(docs, shares, block_docs=1).collect()
    assert len(got) == 6
    assert {r.source: round(r.weight, 6) for r in got} == {"a": round(3 / 7, 6), "b": round(1 / 7, 6), "": round(1 / 7, 6), None: round(1 / 7, 6)}


def test_empty(spark):
    assert mixing.mix(frame(spark, {})).collect() == []

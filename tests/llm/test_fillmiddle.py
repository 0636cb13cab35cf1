import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import fillmiddle as fm

SCHEMA = "doc_id long, text string, n int, form string, cut string, output double"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
EDGES = [None, "", " ", "\n\t ", "a", " a", "a ", "a b\x0b\x0cc\r\n", "É ß 世界 \U0001f600 x y z", "x <P> y", "<S>", "a <M", "<< P> <S <S", "<P a b <", "w " * 40_000, "世" * 30_000, " " * 5000]


def brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(4)
    made = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "世", "<", "<P", "S>", "M"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*enumerate(EDGES * 6 + made), (None, "null id of some words"), (7, "again a b c"), (7, "again a b c"), (-5, "negative id here")]


@pytest.mark.parametrize("every", [1, 3, 1024])
def test_outputs_and_exact_restoration(spark, every):
    given = rows()
    docs = spark.createDataFrame([(i, t, 1, "f", "c", 0.5) for i, t in given], SCHEMA)
    got = fm.transform(docs, every=every).withColumn("restored", fm.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(*x) for x in given), key=repr)
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in given)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_cuts_by_checkpoints_equal_a_full_scan():
    rng = random.Random(9)
    for every, step in ((1, 4), (3, 7), (5, 64), (64, 1 << 20)):
        for _ in range(60):
            text = "".join(rng.choice(["a", "é", "世", " ", "\n"]) for _ in range(rng.randint(0, 80)))
            data = np.frombuffer(text.encode(), np.uint8)
            units = UNITS.findall(text)
            found = fm.index(data, every, step)
            assert found.n == len(units) and len(found.units) >= 1 + len(re.findall(r"[^\x20\x09-\x0D]+", text)) // every
            for k in range(len(units) + 1):
                head = "".join(units[:k])
                assert found.find(k, 5) == (len(head.encode()), len(head))


def test_shares_are_parameters(spark):
    docs = spark.createDataFrame([(i, f"a b c {i}") for i in range(200)], "doc_id long, text string")
    assert {r.form for r in fm.transform(docs, fim_share=0).collect()} == {"plain"}
    assert {r.form for r in fm.transform(docs, fim_share=100, spm_share=0).collect()} == {"psm"}
    assert [r.output for r in fm.transform(docs, seed=1).collect()] != [r.output for r in fm.transform(docs, seed=2).collect()]


def test_empty_table_and_one_kernel(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    got = fm.transform(docs)
    assert got.collect() == [] and dict(got.dtypes)["doc_id"] == "bigint"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan

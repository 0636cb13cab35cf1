import random
import re

import pytest

from strandwise.llm import ruleledger as rl

SPACE = r"[\x20\x09-\x0D]"
SCHEMA = "doc_id long, text string, failures int, n_words string, kept double"
EDGES = [
    None, "", " \n\t", "one", "a " * 7, "a " * 8, "a " * 9, "x" * 200_000, "SHOUT!! " * 50, "a b c d e f g h a b c d e f g h", "line\n" * 30, "line\n line\n\nline \nline",
    "- a\n* b\n • c\n- d\n- e\n- f", "so...\nwell …\nno...\nyes\nend", "é ß 世界     #$% <b>", "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3000,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bare = [re.sub(f"^{SPACE}+|{SPACE}+$", "", x) for x in lines]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_adjacent": sum(a == b for a, b in zip(words, words[1:])), "top_word": max((words.count(w) for w in set(words)), default=0),
        "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)), "n_marks": len(re.findall("[!?]", text)),
        "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words),
        "n_bullets": sum(x[:1] in tuple("-*•") and x != "" for x in bare), "n_ellipses": sum(x.endswith(("...", "…")) for x in bare),
    }


def failed(m):
    return {k for k, rule in rl.RULES.items() if eval(rule.replace("AND", "and"), {}, m)}


def corpus():
    rng = random.Random(6)
    texts = []
    for _ in range(250):
        words = [rng.choice(["the", "The", "é", "x#", "12", "wow!", "…", "-"]) + rng.choice(["", "", "q", "zz"]) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t\n"]) for w in words) * rng.choice([1, 1, 2, 3]))
    return EDGES + texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], SCHEMA)


def test_measurements_bits_and_verdicts(spark):
    rows = [*enumerate(corpus()), (None, "no id"), (3, "one"), (3, "one")]
    policy = rl.POLICIES["2026-strict"]
    got = rl.verdicts(rl.ledger(frame(spark, rows)), policy).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        m = brute(t)
        bad = failed(m)
        base = bool(bad & {"few_words", "repeated_windows"})
        bits = sum(rl.BITS[b] for b in bad)
        soft = sum(bool(rl.BITS[b] & policy.soft) for b in bad)
        want.append((i, *m.values(), bits, base, not base and not bits & policy.hard and soft <= policy.most, policy.version))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {b for w in want for b in rl.BITS if w[-4] & rl.BITS[b]} >= set(rl.BITS) - {"long_words"}


@pytest.mark.parametrize("distinct", [3, 40_000, 1 << 17])
def test_repeated_windows_in_long_texts(distinct):
    rng = random.Random(distinct)
    words = [f"w{rng.randrange(distinct)}" for _ in range(50_000)]
    words[30_000:30_020] = words[100:120]
    counts = {}
    for i in range(len(words) - 7):
        counts.setdefault(tuple(words[i : i + 8]), []).append(i)
    want = {i + j for at in counts.values() if len(at) > 1 for i in at for j in range(8)}
    assert rl.measure(" ".join(words).encode())[rl.MEASURES.index("n_repeat_words")] == len(want)


def test_ablations_are_those_of_leaving_rules_out(spark):
    rows = list(enumerate(corpus()))
    table = rl.ledger(frame(spark, rows)).cache()
    bad = [failed(brute(t)) for _, t in rows]

    def kept(policy, failures):
        hard = any(rl.BITS[b] & policy.hard for b in failures)
        return not hard and sum(bool(rl.BITS[b] & policy.soft) for b in failures) <= (policy.most if policy.soft else 99)

    got = {(r.policy, r.rule): tuple(r)[2:] for r in rl.ablations(table).collect()}
    assert len(got) == len(rl.POLICIES) * len(rl.RULES)
    for name, policy in rl.POLICIES.items():
        for rule in rl.RULES:
            now, then = [kept(policy, b) for b in bad], [kept(policy, b - {rule}) for b in bad]
            assert got[name, rule] == (len(rows), sum(rule in b for b in bad), sum(now), sum(t and not n for n, t in zip(now, then)), sum(then))


def test_thresholds_change_without_the_texts(spark):
    table = rl.ledger(frame(spark, list(enumerate(corpus()))))
    harder = rl.rejudge(table, rl.RULES | {"few_words": "n_words < 40"})
    bit = rl.BITS["few_words"]
    assert harder.where(f"(failures & {bit} <> 0) <> (n_words < 40)").isEmpty() and table.where(f"(failures & {bit} <> 0) <> (n_words < 20)").isEmpty()


def test_empty_table(spark):
    table = rl.ledger(frame(spark, []))
    assert rl.verdicts(table, rl.POLICIES["2024-base"]).collect() == [] and rl.ablations(table).collect() == []

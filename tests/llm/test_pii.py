import random
import re

from strandwise.llm import pii

SCHEMA = "doc_id long, text string, key int, spans string, email int"

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


EDGES = [
    None, "", " ", "a@b.c", "a@b", "a@b.c@d.e", "a@b.c%x@y.z", "..@a..b a@b.c.", "é😀 x.y+z@q-r.st-u.v! é", "a@@b.c@d.e-", "%@%.%", "x@y.z" * 50,
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255", "1.2.3", "1..2.3.4.5", "9.9.9.9.9.9.9", "00000000255.1.2.3",
    "4532015112830366", "4532 0151 1283 0366", "4532-0151-1283-0366", "4532  0151 1283 0366", "x4532015112830366y", "4532015112830367",
    "12 4532015112830366", "1" * 40, "0000000000000", "45320151128303664532015112830366", "- 4-5", "٤٥٣٢٠١٥١١٢٨٣٠٣٦٦",
    "+1 (555) 555-0100", "+1 555", "++15555550100", "+1 (555) 555-0100 (", "+12345678901234567", "+1+1 (555) 555-0100+1 (555) 555-0101", "+1é5555555555",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], SCHEMA)


def test_base_spans_against_python(spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "1", "23", "255", "4532015112830366", "+", "-", " ", "(", ")", "é", "\n", "%", "😀", "+1 (555) 555-0100", "x@y.zz"]
    texts = EDGES + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts.append("word " * 40_000 + "a@b.cd " * 300 + "8.8.8.8")
    got = pii.find(frame(spark, enumerate(texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(x.kind, x.start, x.end) for x in r.base] == brute(texts[r.doc_id]), repr(texts[r.doc_id])
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}


def corpus():
    """Emails follow the word 'kontakt:', which is used for nothing else; 'the' stands before anything."""
    rows = [(i, f"prose and the kontakt: user{i}@mail.example and the end of it") for i in range(12)]
    rows += [(100 + i, f"the text the 4532015112830366 the word the {i} the") for i in range(12)]
    rows.append((200, "more prose kontakt: hidden.one@localhost and so on"))
    rows.append((201, "the 1234567812345678 the bystander@localhost the 42"))
    rows.append((202, "elsewhere hidden.one@localhost again"))
    rows += [(300 + i, f"a decorated 4532015112830366%%% and {4 + i}.3.2.{i}%%% in junk") for i in range(9)]
    rows.append((320, "signs are no context: 1234567812345678%%% stays"))
    return rows


def test_contexts_discover_unseen_identifiers_and_leave_others(spark):
    got = {r.doc_id: {(x.kind, x.start, x.end) for x in r.spans} - {(x.kind, x.start, x.end) for x in r.base} for r in pii.find(frame(spark, corpus())).collect()}
    text = dict(corpus())
    for i in (200, 202):
        at = text[i].index("hidden.one")
        assert got[i] == {("email", at, at + len("hidden.one@localhost"))}
    assert not any(v for i, v in got.items() if i not in (200, 202))


def test_redaction_keeps_columns_and_rows(spark):
    rows = [*corpus(), (None, "a@b.cd"), (1, None), (2, ""), (2, "é 1.2.3.4, +1 (555) 555-0100😀"), (2, "é 1.2.3.4, +1 (555) 555-0100😀")]
    got = pii.redact(frame(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "key", "spans", "email"]
    texts = {(r.doc_id, r.text) for r in got}
    assert (None, "<email>") in texts and (1, None) in texts and (2, "") in texts and (2, "é <ip>, <phone>😀") in texts
    assert (200, "more prose kontakt: <email> and so on") in texts
    assert (201, dict(corpus())[201]) in texts


def test_empty_table_and_native_plan(spark):
    docs = frame(spark, [])
    assert pii.find(docs).collect() == []
    plan = pii.redact(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


ZEROS = ["10.0.0.1", "0.0.0.0", "127.0.0.1", "000.1.2.3", "00.0.00.000", "0256.0.0.1", "1.0.0.256", "x 10.0.0.1, 0.0.0.0", "0" * 4000 + ".0.0.1", "0" * 4000 + "256.0.0.1"]


def test_octets_of_zero_are_octets(spark):
    got = {r.doc_id: r for r in pii.find(frame(spark, enumerate(ZEROS))).collect()}
    for i, text in enumerate(ZEROS):
        assert [(x.kind, x.start, x.end) for x in got[i].base] == brute(text), text[:40]
    assert ("ip", 0, 8) in {(x.kind, x.start, x.end) for x in got[0].base}
    masked = {r.text for r in pii.redact(frame(spark, [(0, "from 10.0.0.1 to 0.0.0.0")])).collect()}
    assert masked == {"from <ip> to <ip>"}


def hops():
    """'login:' stands beside what only 'kontakt:' brings in, and once beside an address that nothing else vouches for."""
    rows = [(i, f"prose of the kontakt: user{i}@mail.example and more") for i in range(100)]
    rows += [(200 + i, f"prose of the kontakt: near{i}@localhost and more") for i in range(8)]
    rows += [(300 + i, f"the login: near{i}@localhost") for i in range(8)]
    rows.append((400, "the login: far@localhost"))
    rows += [(500 + i, f"the stranger{i}@localhost") for i in range(4)]
    return rows


def test_patterns_of_discovered_instances_vouch_in_later_rounds(spark):
    found = {r.doc_id: [x.kind for x in r.spans] for r in pii.find(frame(spark, hops())).collect()}
    assert {i for i, kinds in found.items() if kinds == ["email"]} == {*range(100), *range(200, 208), *range(300, 308), 400}
    one = {r.doc_id: r.spans for r in pii.find(frame(spark, hops()), rounds=1).collect()}
    assert one[200] and one[300] and not one[400]

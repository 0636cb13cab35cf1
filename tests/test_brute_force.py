"""Registered queries that SQL can't express, in whole, against plain Python over the same rows."""

import os
from collections import defaultdict

import pytest

from strandwise.functions import sequences as S
from strandwise.plans import registry, views

from .test_sequences import brute_local, brute_orfs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def msa(spark):
    return {r.seq_id: (r.msa_id, r.seq) for r in views.msa(spark, SF).collect()}


def test_feature_tracks(spark):
    rows = defaultdict(list)
    for r in views.hits(spark, SF).collect():
        rows[r["query"]].append((r.start, r.end, str(r.hit_id)))
    want = set()
    for name, features in rows.items():
        ends = []
        for start, end, feature in sorted(features):
            k = next((i for i, e in enumerate(ends) if e + 200 < start), len(ends))
            ends[k : k + 1] = [end]
            want.add((name, start, end, feature, k))
    got = [(r.name, r.start, r.end, r.feature, r.track) for r in registry.QUERIES["feature_tracks"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_orf_scan(spark, msa):
    joined = defaultdict(str)
    for _, (group, seq) in sorted(msa.items()):
        joined[group] += seq.replace("-", "").upper()
    want = {(name, *orf) for name, seq in joined.items() for orf in brute_orfs(seq, 60)}
    got = registry.QUERIES["orf_scan"](spark, SF).collect()
    assert {(r.name, r.orf_start, r.orf_end, r.direction) for r in got} == want and len(got) == len(want)
    assert all(r.orf_name.startswith("ORF") for r in got)


def plain_statistics(a, b):
    """Score, identity and coverages by whole tables and the way back."""
    n, m, ninf = len(a), len(b), float("-inf")
    h, e, f = ([[x] * (m + 1) for _ in range(n + 1)] for x in (0.0, ninf, ninf))
    top = (0.0, 0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j], f[i][j] = max(h[i - 1][j] - 1, e[i - 1][j] - 0.5), max(h[i][j - 1] - 1, f[i][j - 1] - 0.5)
            h[i][j] = max(0.0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), e[i][j], f[i][j])
            if h[i][j] > top[0]:
                top = (h[i][j], i, j)
    score, i, j = top
    if not score:
        return 0.0, 0.0, 0.0, 0.0
    same = columns = 0
    state = "h"
    while state != "h" or h[i][j] > 0:
        if state == "h":
            if h[i][j] == h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
                same, columns, i, j = same + (a[i - 1] == b[j - 1]), columns + 1, i - 1, j - 1
            else:
                state = "e" if h[i][j] == e[i][j] else "f"
        elif state == "e":
            state, i, columns = "h" if h[i - 1][j] - 1 >= e[i - 1][j] - 0.5 else "e", i - 1, columns + 1
        else:
            state, j, columns = "h" if h[i][j - 1] - 1 >= f[i][j - 1] - 0.5 else "f", j - 1, columns + 1
    return score, round(same / columns * 100, 2), round((top[1] - i) / n * 100, 2), round((top[2] - j) / m * 100, 2)


def test_local_alignment_stats(spark, msa):
    first = {}
    for seq_id, (group, seq) in sorted(msa.items()):
        first.setdefault(group, seq)
    got = registry.QUERIES["local_alignment_stats"](spark, SF).collect()
    assert {r.seq_id for r in got} == set(msa)
    for r in got:
        group, seq = msa[r.seq_id]
        assert r.score == brute_local(seq, first[group])
        assert tuple(r)[1:] == plain_statistics(seq, first[group])


def test_greedy_clusters(spark, msa):
    comp = str.maketrans("ACGT", "TGCA")
    grams = lambda s, k=4: {s[i : i + k] for i in range(len(s) - k + 1)} if len(s) >= k else {s}
    seqs = {str(i): seq.replace("-", "").upper() for i, (_, seq) in msa.items()}
    order = sorted(seqs, key=lambda n: (-len(seqs[n]), n))
    plus = {n: grams(s) for n, s in seqs.items()}
    minus = {n: grams(s.translate(comp)[::-1]) for n, s in seqs.items()}
    heads, want = [], {}
    for name in order:
        for head in heads:
            shared = {"+": len(plus[head] & plus[name]), "-": len(plus[head] & minus[name])}
            fits = [(n, d) for d, n in shared.items() if n and n >= 0.3 * len(plus[name])]
            if fits:
                want[name] = (head, max(fits)[1])
                break
        else:
            heads.append(name)
            want[name] = (name, "+")
    got = registry.QUERIES["greedy_clusters_approximate"](spark, SF).collect()
    assert {r.name: (r.cluster, r.direction) for r in got} == want and len(set(h for h, _ in want.values())) < len(want)


def jaccard(a, b):
    x, y = ({s.upper()[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def matches(left, right, k=4):
    """Maximal runs of equal letters on each diagonal, positions from 1."""
    out = []
    for shift in range(-len(right), len(left)):
        run = 0
        for i in range(max(0, shift), min(len(left), len(right) + shift) + 1):
            if i < min(len(left), len(right) + shift) and left[i] == right[i - shift]:
                run += 1
                continue
            if run >= k:
                out.append((i - run + 1, i, i - shift - run + 1, i - shift, left[i - run : i]))
            run = 0
    return out


def test_site_duplications(spark):
    from strandwise.plans.sequence_queries import _flanks

    found = []
    for r in _flanks(spark, SF).collect():
        if len(r.left) >= 4 and len(r.right) >= 4:
            found += [(r.rec_id, *m) for m in matches(r.left, r.right)]
    found = [f for f in found if max(f[5].upper().count(c) for c in "ACGT") / len(f[5]) <= 0.8]
    longest = defaultdict(int)
    for f in found:
        longest[f[0], f[2], f[4]] = max(longest[f[0], f[2], f[4]], len(f[5]))
    places = defaultdict(list)
    for f in found:
        if len(f[5]) == longest[f[0], f[2], f[4]]:
            places[f[2], f[3]].append((f[0], f[5]))
    kept = {}
    for place, rows in places.items():
        values = [jaccard(a, b) for r, a in rows for q, b in rows if r < q]
        if not values or sum(values) / len(values) <= 0.9:
            kept[place] = rows
    sites = defaultdict(list)
    for (end, start), rows in kept.items():
        first, last = (max(sum(t.upper()[k] == c for _, t in rows) for c in {t.upper()[k] for _, t in rows}) / len(rows) >= 0.9 and len(rows) >= 5 for k in (0, -1))
        for rec, tsd in rows:
            tsd = tsd[1:] if last and len(tsd) > 1 else tsd
            tsd = tsd[:-1] if first and len(tsd) > 1 else tsd
            sites[end - last, start + first].append((rec, tsd))
    root = {p: p for p in sites}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for x, y in sites:
        for other in ((x + 1, y), (x, y + 1)):
            if other in sites:
                a, b = find((x, y)), find(other)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for p, rows in sites.items():
        groups[find(p)] += rows
    want = sorted((len({r for r, _ in rows}), ",".join(sorted({t for _, t in rows}))) for rows in groups.values())
    got = registry.QUERIES["site_duplications"](spark, SF).collect()
    assert sorted((r.records, r.tsds) for r in got) == want and len(want) > 5


def test_every_query_without_sql_is_here_or_tested_elsewhere():
    elsewhere = {"principal_components"}  # tests/test_operators.py
    elsewhere |= {"homology_search", "self_homology", "split_terminal_repeats"}  # tests/test_homology.py
    elsewhere |= {"extended_elements", "extension_sides", "progressive_alignments"}  # tests/test_extension.py
    elsewhere |= {"tree_distances_by_joining"}  # tests/test_trees.py
    here = {"feature_tracks", "orf_scan", "local_alignment_stats", "greedy_clusters_approximate", "site_duplications"}
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == here | elsewhere
    assert S.align_local("ACGT", "ACGT") == (8.0, 100.0, 100.0, 100.0)

"""The thin queries opN_<name>: each binds one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fillmiddle, licenses, mixing, pii, prefixtrie, quality, ruleledger, simhash, suffixdedup, suffixtree, topk, warc
from .common import table


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("vec_id") % 100 == 0)


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = (F.size(F.filter("base", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "block", "slot", "place", "release", "deadline", F.round("weight", 6).alias("weight"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("payload", "url")


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "scope", "license", F.round("dice", 6).alias("dice"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fillmiddle.transform(table(spark, sf_dir, "documents"))
    digests = [F.sha2(F.encode(x, "utf-8"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (fillmiddle.restore(F.col("output"), F.col("form")), "restored_sha256"))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ruleledger.verdicts(ruleledger.ledger(table(spark, sf_dir, "documents")), ruleledger.POLICIES["2026-strict"])
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"]
    return judged.select(*first, *(c for c in judged.columns if c not in first))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.nodes(prefixtrie.rebuild(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_topk": op1_pivot_topk,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_pii_bootstrap": op5_pii_bootstrap,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_warc_bundles": op7_warc_bundles,
    "op8_quality_qda": op8_quality_qda,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_fill_middle": op11_fill_middle,
    "op12_rule_ledger": op12_rule_ledger,
    "op13_prefix_trie": op13_prefix_trie,
}

_LICENSE_TEMPLATES = ", ".join(
    f"({i}, '{k}', '{s}', {len(licenses.template_words(t))}, [{', '.join(repr(x) for x in licenses.template_bigrams(t))}])" for i, k, s, t in licenses.template_rows()
)

_STRICT = ruleledger.POLICIES["2026-strict"]
_FAILURES = " + ".join(f"CASE WHEN {rule} THEN {ruleledger.BITS[name]} ELSE 0 END" for name, rule in ruleledger.RULES.items())

ORACLE_SQL: dict[str, str] = {
    "op1_pivot_topk": """
        WITH wide AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
        v AS (SELECT vec_id, list_transform(e, lambda x: floor(1024 * x)) AS v FROM wide
              WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
    "op2_spaced_seeds": """
        WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        words AS (SELECT kind, id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')),
                  '[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+', '', 'g'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM texts),
        starts AS (SELECT kind, id, w, CAST(p AS BIGINT) AS p FROM words, unnest(range(1, len(w) + 1)) AS u(p)),
        seeds AS (
            SELECT kind, id, p, 0 AS mask, concat_ws(' ', w[p], w[p+1], w[p+3], w[p+5], w[p+6], w[p+7]) AS seed
            FROM starts WHERE p + 7 <= len(w)
            UNION ALL
            SELECT kind, id, p, 1, concat_ws(' ', w[p], w[p+1], w[p+2], w[p+3], w[p+7], w[p+9]) FROM starts WHERE p + 9 <= len(w)
        ),
        hits AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.p AS p, i.p AS q
                 FROM seeds d JOIN seeds i ON d.kind = 'd' AND i.kind = 'i' AND d.mask = i.mask AND d.seed = i.seed),
        checked AS (
            SELECT doc_id, item_id, p, list_max(list_transform(range(-5, 1), lambda s: list_sum(list_transform(range(0, 13), lambda j:
                   CASE WHEN p + s + j >= 1 AND q + s + j >= 1 AND d.w[p + s + j] = i.w[q + s + j] THEN 1 ELSE 0 END)))) AS matched
            FROM hits JOIN words d ON d.kind = 'd' AND d.id = doc_id JOIN words i ON i.kind = 'i' AND i.id = item_id
        )
        SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(min(p) - 1 AS INTEGER) AS first_word
        FROM checked WHERE matched >= 11 GROUP BY doc_id, item_id
        UNION ALL
        SELECT s.id, i.id, CAST(len(i.w) AS INTEGER), CAST(min(s.p) - 1 AS INTEGER)
        FROM starts s JOIN words i ON s.kind = 'd' AND i.kind = 'i' AND len(i.w) BETWEEN 5 AND 10 AND s.w[s.p : s.p + len(i.w) - 1] = i.w
        GROUP BY s.id, i.id, len(i.w)
    """,
    "op6_pfair_mixing": """
        WITH RECURSIVE mass AS (SELECT coalesce(source, '') AS source, sqrt(count(*)) AS mass FROM documents GROUP BY 1),
        shares AS (SELECT source, CAST(greatest(1, floor(1000 * mass / sum(mass) OVER () + 0.5)) AS BIGINT) AS share FROM mass),
        held AS (SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS shares,
                        CAST(sum(share) AS BIGINT) AS total FROM shares),
        edf(t, done, k) AS (
            SELECT CAST(-1 AS BIGINT), list_transform(shares, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM held
            UNION ALL
            SELECT t + 1, list_transform(done, lambda n, i: CASE WHEN i = c THEN n + 1 ELSE n END), CAST(c AS BIGINT)
            FROM (SELECT t, done, total, list_min(list_filter(list_transform(shares, lambda s, i:
                      CASE WHEN done[i] * total // s <= t + 1 THEN ((done[i] + 1) * total + s - 1) // s * 100000 + i END),
                      lambda x: x IS NOT NULL)) % 100000 AS c
                  FROM edf, held WHERE t + 1 < total)
        ),
        cycle AS (SELECT names[k] AS source, shares[k] AS share, total, t AS slot,
                         row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS turn FROM edf, held WHERE t >= 0),
        ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY coalesce(source, '')
                          ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents),
        blocks AS (SELECT *, r // 16 AS b FROM ranked)
        SELECT d.doc_id, d.source, b + 1 AS block, b // c.share * total + c.slot AS slot, CAST(r % 16 AS INTEGER) AS place,
               b * total // c.share AS release, ((b + 1) * total + c.share - 1) // c.share AS deadline,
               round(c.share / total, 6) AS weight
        FROM blocks d JOIN cycle c ON coalesce(d.source, '') = c.source AND c.turn = b % c.share
    """,
    "op10_license_scan": f"""
        WITH known(template, license, scope, n, grams) AS (VALUES {_LICENSE_TEMPLATES}),
        units AS (
            SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, 'line' AS scope, lines[i] AS unit
            FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)
            UNION ALL SELECT doc_id, -1, 'text', text FROM documents
        ),
        words AS (SELECT doc_id, line_no, scope, list_filter(regexp_split_to_array(
                         translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'),
                         lambda w: w <> '') AS w FROM units),
        grams AS (SELECT doc_id, line_no, scope,
                         list_distinct(list_transform(range(2, len(w) + 1), lambda i: w[i - 1] || ' ' || w[i])) AS g FROM words),
        scored AS (SELECT doc_id, line_no, g.scope, license, template,
                          2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
                   FROM grams g JOIN known k ON g.scope = k.scope
                       AND len(g) BETWEEN len(grams) * 0.8 / 1.2 AND len(grams) * 1.2 / 0.8),
        texts AS (SELECT doc_id, list_transform(range(2, len(w) + 1), lambda i: w[i - 1] || ' ' || w[i]) AS g, len(w) AS words
                  FROM words WHERE scope = 'text'),
        starts AS (
            SELECT doc_id, template, license, n, grams, g, unnest(list_distinct(list_append(range(0, words - n + 1, greatest(1, n // 8)), words - n))) AS start
            FROM texts JOIN known ON scope = 'text' AND words > n
        ),
        tried AS (
            SELECT doc_id, template, license, n, start, len(list_distinct(g[start + 1 : start + n - 1])) AS own, len(grams) AS size,
                   len(list_intersect(list_distinct(g[start + 1 : start + n - 1]), grams)) AS shared
            FROM starts
        ),
        inside AS (
            SELECT doc_id, template, license, n, start, 2.0 * shared / (own + size) AS dice FROM tried WHERE 2.0 * shared / (own + size) >= 0.8
            QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY dice DESC, start) = 1
        )
        SELECT doc_id, line_no, scope, license, round(CAST(dice AS DOUBLE), 6) AS dice FROM scored WHERE dice >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, scope ORDER BY dice DESC, template) = 1
        UNION ALL
        SELECT doc_id, CAST(start AS INTEGER), 'window', license, round(CAST(dice AS DOUBLE), 6) FROM inside a
        WHERE NOT EXISTS (SELECT 1 FROM inside b WHERE a.doc_id = b.doc_id AND (b.dice > a.dice OR b.dice = a.dice AND b.template < a.template)
                          AND b.start < a.start + a.n AND a.start < b.start + b.n)
    """,
    "op7_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
                          min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT)
                             >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM p
    """,
    "op11_fill_middle": """
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
        units AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
                         list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(hex, i, 8) AS BIGINT)) AS h FROM texts),
        cuts AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
                        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain'
                             WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
        parts AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
                         array_to_string(u[b + 1:n], '') AS s FROM cuts)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
    "op12_rule_ledger": f"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        split AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
                         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
        windows AS (SELECT doc_id, p, w[p:p + 7] AS win FROM split, unnest(range(1, len(w) - 6)) AS u(p) WHERE len(w) >= 8),
        twice AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM twice, unnest(range(0, 8)) AS u(j) GROUP BY doc_id),
        measured AS (
            SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
                   CAST(coalesce(list_sum(list_transform(range(2, len(w) + 1), lambda i: CASE WHEN w[i] = w[i - 1] THEN 1 ELSE 0 END)), 0) AS BIGINT) AS n_adjacent,
                   CAST(coalesce(list_max(map_values(list_histogram(w))), 0) AS BIGINT) AS top_word,
                   length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
                   length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_letter_words,
                   len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullets,
                   len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipses
            FROM split LEFT JOIN covered USING (doc_id)
        ),
        judged AS (SELECT *, CAST({_FAILURES} AS BIGINT) AS failures FROM measured)
        SELECT *, failures & {ruleledger.BASE} <> 0 AS base_failed, failures & {ruleledger.BASE} = 0 AND failures & {_STRICT.hard} = 0
               AND bit_count(failures & {_STRICT.soft}) <= {_STRICT.most} AS kept, '{_STRICT.version}' AS policy
        FROM judged
    """,
    "op13_prefix_trie": """
        WITH said AS (SELECT conv_id, length(coalesce(text, '')) AS chars, sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) AS code,
                             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
                      FROM conversations WHERE conv_id IS NOT NULL),
        steps AS (SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS s FROM said),
        crc AS (SELECT conv_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], s), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 6 AS h FROM steps),
        rebuilt AS (SELECT c.conv_id, d, code, chars FROM crc c JOIN said s ON s.conv_id = c.conv_id - c.conv_id % 100 AND d <= h
                    UNION ALL SELECT c.conv_id, d, code, chars FROM crc c JOIN said s ON s.conv_id = c.conv_id AND d > h),
        paths AS (SELECT conv_id, list(code ORDER BY d) AS codes, list(chars ORDER BY d) AS chars FROM rebuilt GROUP BY conv_id
                  UNION ALL SELECT conv_id, [], [] FROM crc WHERE conv_id NOT IN (SELECT conv_id FROM rebuilt)),
        met AS (SELECT conv_id, CAST(d AS BIGINT) AS depth, codes[1:d] AS path, CASE WHEN d > 0 THEN codes[1:d - 1] END AS above, len(codes) = d AS ends, chars[d] AS text
                FROM paths, unnest(range(0, len(codes) + 1)) AS u(d)),
        nodes AS (SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(text), 0) AS text,
                         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM met GROUP BY depth, path),
        kids AS (SELECT above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * text AS saved FROM nodes LEFT JOIN kids USING (path)),
        sums AS (SELECT path[1:a] AS path, count_if(n_children = 0) AS n_leaves, sum(saved) AS saved FROM own, unnest(range(0, depth + 1)) AS u(a) GROUP BY 1)
        SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(o.ids) AS ends_sha256
        FROM own o JOIN sums s USING (path) LEFT JOIN nodes p ON o.above = p.path
    """,
}

"""Alignment queries over the embeddings' letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from . import views as V
from .registry import query


def _cells(spark, sf_dir):
    return A.cells(V.msa(spark, sf_dir))


def _counts(spark, sf_dir):
    return A.column_counts(_cells(spark, sf_dir))


_ACGT = "(a + c + g + t)"
_TOP = "greatest(a, c, g, t)"
_CONS = f"CASE WHEN {_ACGT} > 0 THEN {_TOP} / {_ACGT} ELSE 0 END"
_BASE = f"WITH {V.MSA}, {V.COLS}"


def _call(threshold: float) -> str:
    winner = f"CASE {_TOP} WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END"
    return f"CASE WHEN {_ACGT} > 0 AND {_TOP} / {_ACGT} >= {threshold} THEN {winner} ELSE 'N' END"


@query(f"{_BASE} SELECT * FROM cols")
def msa_column_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"{_BASE} SELECT msa_id, col, " + ", ".join(f"CASE WHEN {_ACGT} >= 5 THEN round_even({b} / {_ACGT}, 2) ELSE 0 END AS p_{b}" for b in "acgt") + " FROM cols")
def msa_proportions(spark, sf_dir):
    return A.proportions(_counts(spark, sf_dir), 5, 2)


@query(f"{_BASE} SELECT msa_id, string_agg({_call(0.35)}, '' ORDER BY col) AS consensus FROM cols GROUP BY msa_id")
def consensus_vote(spark, sf_dir):
    return A.consensus(_counts(spark, sf_dir), 0.35)


@query(f"{_BASE} SELECT msa_id, col, {_CONS} AS conservation FROM cols")
def conservation(spark, sf_dir):
    return _counts(spark, sf_dir).select("msa_id", "col", A.conservation().alias("conservation"))


@query(f"{_BASE}, s AS (SELECT msa_id, string_agg({_call(0.3)}, '' ORDER BY col) AS x FROM cols GROUP BY msa_id) SELECT msa_id, (length(x) - length(replace(x, 'N', ''))) / length(x) > 0.4 AS reject FROM s")
def ambiguous_consensus(spark, sf_dir):
    return A.consensus(_counts(spark, sf_dir), 0.3).select("msa_id", A.too_ambiguous(F.col("consensus")).alias("reject"))


_KEPT = f"""kept AS (SELECT msa_id, col FROM cols WHERE n - gaps >= 5 AND gaps / n <= 0.2 AND (gaps / n < 0.1 OR {_CONS} >= 0.32)),
    numbered AS (SELECT msa_id, CAST(row_number() OVER (PARTITION BY msa_id ORDER BY col) - 1 AS INTEGER) AS new_col, col AS old_col FROM kept)"""


def _kept(spark, sf_dir):
    return A.gap_filter(_counts(spark, sf_dir), 0.2, 0.1, 0.32)


@query(f"{_BASE}, {_KEPT} SELECT * FROM numbered UNION ALL SELECT msa_id, max(new_col) + 1, max(old_col) + 1 FROM numbered GROUP BY msa_id")
def msa_gap_filter(spark, sf_dir):
    return A.with_sentinel(_kept(spark, sf_dir))


@query(f"{_BASE}, {_KEPT} SELECT msa_id, count(*) >= 50 AS usable FROM numbered GROUP BY msa_id")
def msa_usable(spark, sf_dir):
    return A.usable(_kept(spark, sf_dir))


@query(f"{_BASE}, {_KEPT} SELECT c.msa_id, seq_id, string_agg(base, '' ORDER BY new_col) AS seq FROM cells c JOIN numbered k ON c.msa_id = k.msa_id AND c.col = k.old_col GROUP BY c.msa_id, seq_id")
def msa_filtered_rows(spark, sf_dir):
    return A.assemble(A.keep_columns(_cells(spark, sf_dir), _kept(spark, sf_dir)))


@query(
    f"""{_BASE} SELECT msa_id, seq_id, string_agg(CASE WHEN coalesce(CASE base WHEN 'a' THEN a WHEN 'c' THEN c WHEN 'g' THEN g WHEN 't' THEN t END / {_ACGT} < 0.2, FALSE)
        THEN '-' ELSE base END, '' ORDER BY col) AS seq FROM cells JOIN cols USING (msa_id, col) GROUP BY msa_id, seq_id"""
)
def rare_base_mask(spark, sf_dir):
    parts = _cells(spark, sf_dir)
    return A.assemble(A.mask_rare(parts, A.column_counts(parts), 0.2))


@query(
    f"""{_BASE}, d AS (SELECT msa_id, count(*) AS found FROM cols WHERE NOT {_CONS} > CASE WHEN n >= 90 THEN 0.34 ELSE 0.32 END GROUP BY msa_id)
        SELECT msa_id, coalesce(found, 0) > CASE WHEN l > 100 / 0.05 THEN 100 ELSE greatest(10, 0.05 * l) END AS cluster
        FROM (SELECT msa_id, count(*) AS l FROM cols GROUP BY msa_id) LEFT JOIN d USING (msa_id)"""
)
def divergent_columns(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return A.worth_clustering(A.divergent_columns(counts, 0.32, 0.34), counts, least=10)


def _crop_sql(value: str, width: int, extra: int, good_a: str, good_b: str, source: str) -> str:
    w = "PARTITION BY msa_id, seq_id ORDER BY col"
    return f"""v AS (SELECT msa_id, seq_id, col, {value} AS v FROM {source}),
        s AS (SELECT *, round(sum(v) OVER ({w} ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING), 9) AS a, count(*) OVER ({w} ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS na,
            round(sum(v) OVER ({w} ROWS BETWEEN {width - 1 + extra} PRECEDING AND CURRENT ROW), 9) AS b, count(*) OVER ({w} ROWS BETWEEN {width - 1 + extra} PRECEDING AND CURRENT ROW) AS nb FROM v),
        crop AS (SELECT msa_id, seq_id, coalesce(min(col) FILTER (na = {width} AND {good_a}), 0) AS start,
            coalesce(max(col + 1) FILTER (nb = {width + extra} AND {good_b}), 0) AS "end" FROM s GROUP BY msa_id, seq_id)"""


_OWN = f"coalesce(CASE base WHEN 'a' THEN a WHEN 'c' THEN c WHEN 'g' THEN g WHEN 't' THEN t END / nullif({_ACGT}, 0), 0)"
_DIV = _crop_sql(_OWN, 10, 1, "a > 2.75", "b > 2.75", "cells JOIN cols USING (msa_id, col)")


@query(f"{_BASE}, {_DIV} SELECT * FROM crop")
def end_crop_divergence(spark, sf_dir):
    parts = _cells(spark, sf_dir)
    return A.crop_divergence(parts, A.column_counts(parts), 2.75, 10)


_GAP = _crop_sql("CASE WHEN base = '-' THEN 1 ELSE 0 END", 12, 0, "a / 12 <= 0.05", "b / 12 <= 0.05", "cells")


@query(f"{_BASE}, {_GAP} SELECT msa_id, seq_id, start, greatest(start, \"end\") AS \"end\" FROM crop")
def end_crop_gap(spark, sf_dir):
    return A.crop_gaps(_cells(spark, sf_dir), 0.05, 12)


@query(
    f"""{_BASE}, {_DIV} SELECT c.msa_id, c.seq_id, string_agg(CASE WHEN col >= start AND col < "end" THEN base ELSE '-' END, '' ORDER BY col) AS seq,
        any_value(64 - ("end" - start) > 0.7 * 64) AS large FROM cells c JOIN crop USING (msa_id, seq_id) GROUP BY c.msa_id, c.seq_id"""
)
def cropped_rows(spark, sf_dir):
    parts = _cells(spark, sf_dir)
    crop = A.crop_divergence(parts, A.column_counts(parts), 2.75, 10)
    lengths = V.msa(spark, sf_dir).groupBy("msa_id").agg(F.max(F.length("seq")).alias("length"))
    return A.assemble(A.apply_crop(parts, crop)).join(A.large_crops(crop, lengths, 0.7), ["msa_id", "seq_id"])


@query(
    f"""{_BASE}, s AS (SELECT msa_id, col, sum({_CONS}) OVER (PARTITION BY msa_id ORDER BY col ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s,
        count(*) OVER (PARTITION BY msa_id ORDER BY col ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM cols),
        f AS (SELECT *, max(col) OVER (PARTITION BY msa_id) AS last FROM s WHERE n = 20)
        SELECT msa_id, round(avg(s) FILTER (col < 15), 9) AS "left", round(avg(s) FILTER (col > last - 15), 9) AS "right" FROM f GROUP BY msa_id"""
)
def crop_threshold(spark, sf_dir):
    parts = _cells(spark, sf_dir)
    return A.crop_threshold(parts, A.column_counts(parts), 20, 15).select("msa_id", F.round("left", 9).alias("left"), F.round("right", 9).alias("right"))


@query(
    f"""{_BASE}, v AS (SELECT msa_id, col, CASE WHEN {_call(0.33)} = 'N' THEN 1 ELSE 0 END AS v FROM cols),
        s AS (SELECT *, sum(v) OVER (PARTITION BY msa_id ORDER BY col ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS a, count(*) OVER (PARTITION BY msa_id ORDER BY col ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS na,
        sum(v) OVER (PARTITION BY msa_id ORDER BY col ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS b, count(*) OVER (PARTITION BY msa_id ORDER BY col ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS nb FROM v),
        o AS (SELECT msa_id, coalesce(min(col) FILTER (na = 8 AND a <= 0.5 * 8), count(*)) AS start, coalesce(max(col + 1) FILTER (nb = 8 AND b <= 0.5 * 8), 1) AS "end", count(*) AS n FROM s GROUP BY msa_id)
        SELECT msa_id, start, CAST("end" AS BIGINT) AS "end", start < "end" AND start <= 10 AS extend_left, start < "end" AND "end" >= n - 10 AS extend_right, start >= "end" AS stop FROM o"""
)
def consensus_boundary(spark, sf_dir):
    out = A.consensus_boundary(_counts(spark, sf_dir), 8, 0.5, 0.33)
    return out.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


_RUNS = f"""g AS (SELECT *, lag(col) OVER (PARTITION BY msa_id ORDER BY col) AS prev, lag(gaps) OVER (PARTITION BY msa_id ORDER BY col) AS pg FROM cols
        WHERE gaps / n >= 0.06 AND n - gaps >= 10 AND {_CONS} >= 0.2),
    r AS (SELECT *, sum(CASE WHEN prev IS NULL OR col - prev > 1 OR abs(gaps - pg) > 0.1 * n THEN 1 ELSE 0 END) OVER (PARTITION BY msa_id ORDER BY col) AS run FROM g),
    runs AS (SELECT msa_id, min(col) AS start, max(col) AS "end" FROM r GROUP BY msa_id, run HAVING max(col) - min(col) + 1 >= 3)"""


def _runs(spark, sf_dir):
    return A.gap_runs(_counts(spark, sf_dir), 0.06, 10, 0.2)


@query(f"{_BASE}, {_RUNS} SELECT * FROM runs")
def gap_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(
    f"""{_BASE}, {_RUNS}, m AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY msa_id ORDER BY start) > 2, TRUE) THEN 1 ELSE 0 END AS fresh FROM runs),
        k AS (SELECT *, sum(fresh) OVER (PARTITION BY msa_id ORDER BY start) AS run FROM m) SELECT msa_id, min(start) AS start, max("end") AS "end" FROM k GROUP BY msa_id, run"""
)
def merged_gap_runs(spark, sf_dir):
    return A.merge_runs(_runs(spark, sf_dir))


@query(
    f"""WITH {V.MSA}, l AS (SELECT *, row_number() OVER (PARTITION BY msa_id, seq_id ORDER BY col) AS i, sum(CASE WHEN col < 30 THEN 1 ELSE 0 END) OVER (PARTITION BY msa_id, seq_id) AS before FROM cells WHERE base <> '-')
        SELECT msa_id, seq_id, min(col) FILTER (col < 30 AND i > before - 10) AS "left", max(col) FILTER (col >= 30 AND i <= before + 10) AS "right" FROM l GROUP BY msa_id, seq_id"""
)
def nucleotide_radius(spark, sf_dir):
    return A.nucleotide_radius(_cells(spark, sf_dir), F.lit(30), 10)


_ROWS = "seqs AS (SELECT msa_id, seq_id, string_agg(base, '' ORDER BY col) AS seq FROM cells GROUP BY msa_id, seq_id)"


@query(f"WITH {V.MSA}, {_ROWS} SELECT * FROM seqs WHERE (length(seq) - length(replace(seq, '-', ''))) / length(seq) < 0.15 AND length(replace(seq, '-', '')) >= 0.8 * length(seq)")
def drop_gappy_rows(spark, sf_dir):
    return A.drop_short(A.drop_gappy(V.msa(spark, sf_dir), 0.15), 0.8)


@query(
    f"""WITH {V.MSA}, {_ROWS} SELECT msa_id, seq_id, substr(seq, 6, 30) || substr(seq, 1, 7) || '----------' || right(seq, 7) AS seq, 30 AS first, 24 AS second FROM seqs"""
)
def sliced_rows(spark, sf_dir):
    rows = V.msa(spark, sf_dir)
    left = rows.withColumn("seq", A.cut(F.col("seq"), F.lit(5), F.lit(35)))
    return A.beside(left, rows.withColumn("seq", A.ends_only(F.col("seq"), 7)))


@query(
    f"""WITH {V.MSA}, p AS (SELECT *, count(*) OVER (PARTITION BY msa_id, col, base) / count(*) OVER (PARTITION BY msa_id, col) AS p FROM cells), t AS (SELECT *, max(p) OVER (PARTITION BY msa_id, col) AS top FROM p)
        SELECT msa_id, seq_id, string_agg(CASE WHEN top < 0.3 OR p < 0.2 THEN base ELSE '.' END, '' ORDER BY col) AS seq FROM t GROUP BY msa_id, seq_id"""
)
def highlighted_rows(spark, sf_dir):
    return A.assemble(A.highlight(_cells(spark, sf_dir), 0.3).select("msa_id", "seq_id", "col", F.coalesce("shown", F.lit(".")).alias("base")))


@query(f"WITH {V.MSA} SELECT msa_id, col, CAST(sum(CASE base WHEN 'a' THEN 1 WHEN 'c' THEN 2 WHEN 'g' THEN 3 WHEN 't' THEN 4 WHEN '-' THEN 0 ELSE 5 END) AS BIGINT) AS code_sum FROM cells GROUP BY msa_id, col")
def base_codes(spark, sf_dir):
    return A.codes(_cells(spark, sf_dir)).groupBy("msa_id", "col").agg(F.sum("code").alias("code_sum"))


@query(
    f"""{_BASE}, p AS (SELECT msa_id, list_filter([a / {_ACGT}, c / {_ACGT}, g / {_ACGT}, t / {_ACGT}], lambda x: x > 0) AS p FROM cols)
        SELECT msa_id, round(avg(list_sum(p) / greatest(1, len(p))), 9) AS mean FROM p GROUP BY msa_id"""
)
def mean_proportions(spark, sf_dir):
    return A.mean_proportions(_counts(spark, sf_dir)).select("msa_id", F.round("mean", 9).alias("mean"))


@query(f"{_BASE}, {_KEPT} SELECT n.msa_id, new_col AS col, gaps AS value FROM numbered n JOIN cols k ON n.msa_id = k.msa_id AND n.old_col = k.col")
def column_lookup(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return A.lookup(A.gap_filter(counts, 0.2, 0.1, 0.32), counts.select("msa_id", "col", F.col("gaps").alias("value")))


@query("SELECT label AS msa_id, min(len(embedding)) <> max(len(embedding)) AS ragged FROM embeddings GROUP BY label")
def ragged_alignments(spark, sf_dir):
    return A.is_ragged(V.msa(spark, sf_dir))

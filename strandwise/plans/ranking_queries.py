"""Ranking, cluster and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hits as H
from ..operators import metrics as M
from ..operators import ranking as R
from . import interval_queries as Q
from . import views as V
from .registry import query

_TIE = "length DESC, ordinal, sseqid, qstart, pident, evalue"


@query(
    f"""WITH {V.M8}, r AS (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY {_TIE}) AS k FROM m8)
        SELECT qseqid, ordinal, length, qstart, pident FROM r WHERE k <= 10"""
)
def top_longest_per_query(spark, sf_dir):
    rows = V.m8(spark, sf_dir)
    return H.down_sample(rows, ["qseqid"], "length", ["ordinal", "sseqid", "qstart", "pident", "evalue"], most=10, top=10).select("qseqid", "ordinal", "length", "qstart", "pident")


@query(
    f"""WITH {V.M8}, r AS (SELECT *, row_number() OVER (PARTITION BY qseqid, sseqid, length ORDER BY ordinal, qstart, pident, evalue) AS k FROM m8)
        SELECT qseqid, sseqid, length, ordinal, qstart, pident FROM r WHERE k = 1"""
)
def distinct_first_row(spark, sf_dir):
    return H.first_of(V.m8(spark, sf_dir), ["qseqid", "sseqid", "length"], ["ordinal", "qstart", "pident", "evalue"]).select("qseqid", "sseqid", "length", "ordinal", "qstart", "pident")


_REP = """rep AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE evaluation WHEN 'Perfect' THEN 1 WHEN 'Good' THEN 2 WHEN 'Reco_check' THEN 3 ELSE 4 END,
    length DESC, name) AS k FROM graded WHERE evaluation IN ('Perfect', 'Good', 'Reco_check') OR low_copy)"""


@query(f"WITH {V.GRADED}, {_REP} SELECT cluster, name, evaluation, length, te_class, low_copy FROM rep WHERE k = 1")
def representative_per_cluster(spark, sf_dir):
    return R.representatives(V.graded(spark, sf_dir))


@query(
    f"""WITH {V.GRADED.replace("graded AS", "every AS", 1)}, graded AS (SELECT * REPLACE (CASE WHEN cluster % 3 = 0 THEN 'Need_check' ELSE evaluation END AS evaluation, low_copy AND cluster % 3 <> 0 AS low_copy) FROM every),
        {_REP} SELECT cluster, name FROM graded WHERE cluster NOT IN (SELECT cluster FROM rep)"""
)
def second_round_members(spark, sf_dir):
    """A third of the clusters has nothing better than Need_check."""
    third = F.col("cluster") % 3 == 0
    rows = V.graded(spark, sf_dir).withColumns({"evaluation": F.when(third, "Need_check").otherwise(F.col("evaluation")), "low_copy": F.col("low_copy") & ~third})
    return R.second_round(rows).select("cluster", "name")


_ROLL = """roll AS (SELECT cluster, max(length / 1e9) AS share, arg_min(te_class, (-length, name)) AS te_class,
    list_extract(['Perfect', 'Good', 'Reco_check', 'Need_check', 'Need_ext'], CAST(min(CASE evaluation WHEN 'Perfect' THEN 1 WHEN 'Good' THEN 2 WHEN 'Reco_check' THEN 3
        WHEN 'Need_check' THEN 4 ELSE 5 END) AS BIGINT)) AS evaluation FROM graded GROUP BY cluster)"""


def _rollup(spark, sf_dir):
    return R.cluster_rollup(V.graded(spark, sf_dir), F.col("length") / 1e9)


@query(f"WITH {V.GRADED}, {_ROLL} SELECT * FROM roll")
def cluster_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


@query(f"WITH {V.GRADED}, {_ROLL} SELECT *, row_number() OVER (ORDER BY share DESC, cluster) AS rank FROM roll")
def cluster_rank(spark, sf_dir):
    return R.rank_by_share(_rollup(spark, sf_dir))


@query(
    f"""WITH {V.GRADED}, {_ROLL}, c AS (SELECT row_number() OVER (ORDER BY share DESC, cluster) AS rank,
        round(sum(share) OVER (ORDER BY share DESC, cluster ROWS UNBOUNDED PRECEDING) / sum(share) OVER (), 9) AS c FROM roll)
        SELECT CAST(step AS DOUBLE) AS step, min(rank) AS rank FROM c JOIN (VALUES (0.1), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9), (0.95), (1.0)) AS s(step)
        ON CAST(step AS DOUBLE) <= c GROUP BY step"""
)
def cumulative_share_crossings(spark, sf_dir):
    return R.share_crossings(_rollup(spark, sf_dir))


@query(f"WITH {V.M8} SELECT qseqid, count(*) AS n FROM m8 GROUP BY qseqid ORDER BY n DESC, min(ordinal) LIMIT 5")
def most_common_clusters(spark, sf_dir):
    return R.most_common(V.m8(spark, sf_dir), "qseqid", 5, "ordinal")


@query(
    """WITH k AS (SELECT CASE WHEN l_discount > 0.05 THEN -1 ELSE l_suppkey END AS label, count(*) AS n FROM lineitem GROUP BY 1),
        kept AS (SELECT * FROM k WHERE label <> -1 AND n >= 300 ORDER BY n DESC, label LIMIT 60)
        SELECT * FROM kept UNION ALL SELECT * FROM k WHERE label = -1 AND n >= 12 AND n >= 0.4 * (SELECT sum(n) FROM k) AND (SELECT count(*) FROM kept) < 60"""
)
def clusters_kept(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_discount") > 0.05, -1).otherwise(F.col("l_suppkey")).alias("label"))
    return R.large_clusters(rows, "label", 300, 60, noise_share=0.4)


@query(
    """SELECT s_name FROM supplier ORDER BY list_transform(regexp_extract_all(s_name || '_' || s_nationkey, '\\d+'), lambda x: CAST(x AS BIGINT)), s_name OFFSET 10 LIMIT 40"""
)
def natural_order_page(spark, sf_dir):
    names = V.table(spark, sf_dir, "supplier").select("s_name", R.natural_key(F.concat_ws("_", "s_name", "s_nationkey")).alias("key"))
    return R.page(names, ["key", "s_name"], 10, 50).select("s_name")


@query(f"WITH {V.RM} SELECT query, arg_min('r' || CAST(repeat AS VARCHAR) || '#' || class, (perc_div, 'r' || CAST(repeat AS VARCHAR))) AS label FROM rm GROUP BY query")
def first_hit_label(spark, sf_dir):
    rows = V.rm(spark, sf_dir).withColumn("repeat", F.concat(F.lit("r"), F.col("repeat").cast("string")))
    return R.first_label(rows, "query", "perc_div", "repeat", "class")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return R.completed(V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id").subtract(V.table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id, source, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def facts_with_defaults(spark, sf_dir):
    return R.add_facts(V.table(spark, sf_dir, "documents").select("doc_id", "source"), V.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", {"quality": -1})


_SCORES = """, counts AS (SELECT class, CAST(coalesce(sum(length) FILTER (query = class AND reference = class), 0) AS BIGINT) AS tp,
        CAST(coalesce(sum(length) FILTER (query = class AND reference <> class), 0) AS BIGINT) AS fp,
        CAST(coalesce(sum(length) FILTER (query <> class AND reference = class), 0) AS BIGINT) AS fn,
        CAST(coalesce(sum(length) FILTER (query <> class AND reference <> class), 0) AS BIGINT) AS tn FROM scored, classes GROUP BY class),
    r AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
        coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision FROM counts)
    SELECT *, coalesce(2 * precision * sensitivity / nullif(precision + sensitivity, 0), 0) AS f1, 1 - precision AS fdr FROM r"""


@query(f"WITH {Q.CROSS}, scored AS (SELECT * FROM lengths), classes AS (SELECT DISTINCT query AS class FROM lengths WHERE query <> 'Not-TE'){_SCORES}")
def confusion_by_class(spark, sf_dir):
    return M.confusion(Q.cross(spark, sf_dir))


@query(
    f"""WITH {Q.CROSS}, scored AS (SELECT CASE WHEN query = 'Not-TE' THEN query ELSE 'All-TE' END AS query, CASE WHEN reference = 'Not-TE' THEN reference ELSE 'All-TE' END AS reference,
        length FROM lengths), classes AS (SELECT 'All-TE' AS class){_SCORES}"""
)
def confusion_all(spark, sf_dir):
    return M.confusion_all(Q.cross(spark, sf_dir))


_TYPES = ["click", "error", "purchase", "signup", "view", "Not-TE"]


@query(
    f"WITH {Q.CROSS}, t AS (SELECT query, "
    + ", ".join(f"coalesce(sum(length) FILTER (reference = '{c}'), 0) AS \"{c}\"" for c in _TYPES)
    + " FROM lengths GROUP BY query) SELECT query, "
    + ", ".join(f'coalesce("{c}" / nullif(sum("{c}") OVER (), 0), 0) AS "{c}"' for c in _TYPES)
    + " FROM t"
)
def crosstab_share(spark, sf_dir):
    return M.crosstab_share(Q.cross(spark, sf_dir), _TYPES)


@query(
    f"""WITH {Q.CROSS} SELECT 'query' AS side, query AS class, CAST(sum(length) AS BIGINT) AS length FROM lengths GROUP BY query
        UNION ALL SELECT 'reference', reference, CAST(sum(length) AS BIGINT) FROM lengths GROUP BY reference"""
)
def flow_totals(spark, sf_dir):
    return M.flow_totals(Q.cross(spark, sf_dir))


_LAND = """land AS (SELECT CAST(round_even(perc_div, 0) AS INTEGER) AS bin, list_extract(string_split(class, '/'), -1) AS family,
    CAST(sum(query_end - query_start) AS BIGINT) AS bases FROM rm GROUP BY 1, 2 HAVING bin <= 8)"""


@query(f"WITH {V.RM}, {_LAND} SELECT * FROM land")
def landscape_bins(spark, sf_dir):
    return M.landscape(V.rm(spark, sf_dir), 8)


_FAMILIES = ["STANDARD", "LARGE", "ECONOMY", "MEDIUM", "PROMO", "Unknown"]


@query(f"WITH {V.RM}, {_LAND} SELECT bin, " + ", ".join(f"CAST(coalesce(sum(bases) FILTER (family = '{f}'), 0) AS BIGINT) AS \"{f}\"" for f in _FAMILIES) + " FROM land GROUP BY bin")
def landscape_table(spark, sf_dir):
    return M.landscape_table(V.rm(spark, sf_dir), _FAMILIES, 8)


@query(
    f"""WITH {V.RM}, s AS (SELECT query, repeat, class, sum(abs(query_start - query_end)) AS span FROM rm WHERE perc_div <= 8 GROUP BY ALL HAVING span >= 80),
        b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY span DESC, repeat, class) AS k FROM s)
        SELECT query, class AS new_class FROM b JOIN orders ON o_orderkey = query AND o_orderstatus = 'F' WHERE k = 1 AND span / 200 >= 0.8"""
)
def reclassify_argmax(spark, sf_dir):
    sizes = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.lit(200).alias("length"), F.when(F.col("o_orderstatus") == "F", "LTR/Unknown").otherwise("LTR").alias("te_class"))
    return M.reclassify(V.rm(spark, sf_dir), sizes, identity=92)


@query(
    f"""WITH {V.RM} SELECT DISTINCT query FROM rm WHERE perc_div <= 5 AND perc_del <= 3 AND perc_ins <= 3
        AND abs(query_start - query_end) / (query_end + query_left) * 100 >= 20"""
)
def curated_matches(spark, sf_dir):
    return M.curated_matches(V.rm(spark, sf_dir), coverage=20)


@query(
    """SELECT count(DISTINCT doc_id) AS inputs, count(*) FILTER (quality = 0) AS skipped, count(*) FILTER (toxic = 1) AS low_copy,
        count(*) FILTER (lang IN ('fr', 'de')) AS unknown, count(*) FILTER (lang <> 'fr') AS classified,
        count(*) FILTER (lang <> 'fr') / (count(*) FILTER (lang <> 'fr') + count(*) FILTER (lang IN ('fr', 'de'))) AS classified_share
        FROM documents JOIN labels USING (doc_id)"""
)
def progress_counts(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id")
    te_class = F.when(F.col("lang") == "fr", "Unknown").when(F.col("lang") == "de", "LTR/Unknown").otherwise("LTR")
    return M.progress(d.select(F.col("doc_id").alias("input_name"), F.when(F.col("quality") == 0, "skipped").otherwise("processed").alias("status"), (F.col("toxic") == 1).alias("low_copy"), te_class.alias("te_class")))


@query(f"WITH {V.HITS} SELECT query, sum(CASE WHEN strand = '+' THEN abs(\"end\" - start) ELSE -abs(\"end\" - start) END) >= 0 AS keeps FROM (SELECT hit_id % 97 AS query, strand, start, \"end\" FROM hits) GROUP BY query")
def strand_vote(spark, sf_dir):
    return M.strand_vote(V.hits(spark, sf_dir).withColumn("query", F.col("hit_id") % 97), "query")

"""Sequence, clustering and curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import sequences as S
from ..operators import alignment as A
from ..operators import clustering as L
from ..operators import curation as U
from ..operators import intervals as I
from . import views as V
from .registry import query

_SEQS = "seqs AS (SELECT msa_id, seq_id, string_agg(base, '' ORDER BY col) AS seq FROM cells GROUP BY msa_id, seq_id)"
_WITH = f"WITH {V.MSA}, {_SEQS}"


@query(f"{_WITH} SELECT seq_id, translate(reverse(seq), 'acgt', 'tgca') AS seq, length(seq) - 40 AS start, length(seq) - 10 AS \"end\" FROM seqs")
def reverse_complement(spark, sf_dir):
    start, end = S.flipped(F.lit(10), F.lit(40), F.length("seq"))
    return V.msa(spark, sf_dir).select("seq_id", S.reverse_complement(F.col("seq")).alias("seq"), start.cast("long").alias("start"), end.cast("long").alias("end"))




def _headers(spark, sf_dir):
    header = F.concat("p_name", F.lit("-"), F.col("p_size").cast("string"), F.lit("#"), "p_type", F.lit("/"), "p_brand", F.lit(" some text"))
    return V.table(spark, sf_dir, "part").select("p_partkey", header.alias("header"))


@query(
    f"""WITH h AS (SELECT p_partkey, regexp_replace(p_name || '-' || CAST(p_size AS VARCHAR), '[ -]', '_', 'g') AS name, p_type || '/' || p_brand AS te_class FROM part),
        k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS k FROM h)
        SELECT p_partkey, CASE WHEN k > 1 THEN name || '_n' || k ELSE name END AS name, te_class FROM k"""
)
def header_parse(spark, sf_dir):
    rows = _headers(spark, sf_dir).select("p_partkey", S.header_name(F.col("header")).alias("name"), S.header_class(F.col("header")).alias("te_class"))
    return S.unique_names(rows, "name", "p_partkey")


@query(
    """SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[/\\\\]', '__', 'g').replace(' ', '_') AS shown, p_name || '_LTR#' || p_type AS header,
        replace('LTR/' || p_type, '/', '__') AS file FROM part"""
)
def display_names(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", S.display_name(F.concat_ws("/", "p_name", "p_type")).alias("shown"), S.header_suffix(F.concat_ws("#", "p_name", "p_type"), "LTR").alias("header"),
        S.file_class(F.concat(F.lit("LTR/"), "p_type")).alias("file"),
    )


_CLASS = "CASE p_size % 6 WHEN 0 THEN 'LTR/Gypsy' WHEN 1 THEN 'DNA/MULE-MuDR' WHEN 2 THEN 'LINE' WHEN 3 THEN 'MITE/x' WHEN 4 THEN NULL ELSE 'RC/Helitron' END"


def _class():
    size = F.col("p_size") % 6
    return F.when(size == 0, "LTR/Gypsy").when(size == 1, "DNA/MULE-MuDR").when(size == 2, "LINE").when(size == 3, "MITE/x").when(size == 5, "RC/Helitron")


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'LTR' WHEN 1 THEN 'DNA-TIR' WHEN 2 THEN 'LINE' WHEN 3 THEN 'MITE' WHEN 4 THEN 'Unknown' ELSE 'Helitron' END AS category,
        CASE p_size % 6 WHEN 0 THEN 'LTR' WHEN 1 THEN 'DNA-TIR' WHEN 2 THEN 'Non-LTR' WHEN 3 THEN 'DNA-TIR' WHEN 4 THEN 'Unknown' ELSE 'Helitron' END AS fewer FROM part"""
)
def class_map(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", C.category(_class()).alias("category"), C.category(_class(), True).alias("fewer"))


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN 500 WHEN 3 THEN 150 ELSE 1000 END AS ext_step, CASE p_size % 6 WHEN 3 THEN 1000 ELSE 7000 END AS max_ext,
        CASE p_size % 6 WHEN 3 THEN 50 ELSE 150 END AS min_blast_len, CASE p_size % 6 WHEN 1 THEN 100 WHEN 3 THEN 40 ELSE 250 END AS crop_end_gap_win,
        CASE WHEN p_size % 6 IN (1, 3) THEN 50 ELSE 150 END AS ext_check_win, CASE p_size % 6 WHEN 1 THEN 200 WHEN 3 THEN 80 ELSE 400 END AS buffer,
        CAST(CASE p_size % 6 WHEN 2 THEN 0.55 ELSE 0.65 END AS DOUBLE) AS ext_thr FROM part"""
)
def class_parameters(spark, sf_dir):
    te_class = F.coalesce(_class(), F.lit("Unknown"))
    rows = V.table(spark, sf_dir, "part").select("p_partkey", C.class_parameters(te_class).alias("p"), F.round(C.extension_threshold(te_class, 0.65), 6).alias("ext_thr"))
    return rows.select("p_partkey", "p.*", "ext_thr")


@query(
    f"""WITH p AS (SELECT p_brand, p_partkey, list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(upper(p_name), i, 2))) AS k FROM part)
        SELECT a.p_brand, round(avg(len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k)))), 9) AS similarity
        FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey GROUP BY a.p_brand"""
)
def kmer_jaccard_pairs(spark, sf_dir):
    found = L.jaccard_pairs(V.table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name")
    return found.select("p_brand", F.round("similarity", 9).alias("similarity"))


_K2P = """pairs AS (SELECT x.msa_id, x.seq_id AS a, y.seq_id AS b, count(*) AS n,
        count(*) FILTER (x.base <> y.base AND (x.base IN ('a', 'g')) = (y.base IN ('a', 'g'))) AS s, count(*) FILTER (x.base <> y.base AND (x.base IN ('a', 'g')) <> (y.base IN ('a', 'g'))) AS v
        FROM cells x JOIN cells y ON x.msa_id = y.msa_id AND x.col = y.col AND x.seq_id < y.seq_id AND x.base <> '-' AND y.base <> '-' GROUP BY ALL),
    xy AS (SELECT *, 1 - 2 * s / n - v / n AS x, 1 - 2 * v / n AS y FROM pairs),
    dist AS (SELECT msa_id, a, b, CASE WHEN x > 0 AND y > 0 THEN round(-0.5 * ln(CASE WHEN x > 0 THEN x END) - 0.25 * ln(CASE WHEN y > 0 THEN y END), 9) + 0.0 END AS d FROM xy)"""


@query(f"WITH {V.MSA}, {_K2P} SELECT msa_id, a, b, coalesce(d, -1) AS d FROM dist")
def k2p_distance(spark, sf_dir):
    return L.k2p(A.cells(V.msa(spark, sf_dir))).na.fill({"d": -1.0})


@query(
    f"""WITH RECURSIVE {V.MSA}, {_K2P}, near AS MATERIALIZED (SELECT a, b FROM dist WHERE d <= 0.55 UNION ALL SELECT b, a FROM dist WHERE d <= 0.55),
        core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= 3), inner_edges AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
        walk(id, seen) AS (SELECT id, id FROM core UNION SELECT walk.id, e.b FROM walk JOIN inner_edges e ON walk.seen = e.a),
        root AS (SELECT id, min(seen) AS root FROM walk GROUP BY id),
        border AS (SELECT a AS id, arg_min(root, b) AS border FROM near JOIN root ON b = root.id GROUP BY a)
        SELECT vec_id AS id, coalesce(root, border, -1) AS label FROM embeddings LEFT JOIN root ON vec_id = root.id LEFT JOIN border ON vec_id = border.id"""
)
def dbscan_labels(spark, sf_dir):
    msa = V.msa(spark, sf_dir)
    return L.dbscan(msa.select(F.col("seq_id").alias("id")), L.k2p(A.cells(msa), most=0.55).select("a", "b", "d"), eps=0.55)


_FLANKS = "flanks AS (SELECT seq_id AS rec_id, substr(seq, 1, 24) AS \"left\", substr(seq, 41, 24) AS \"right\" FROM seqs)"


def _flanks(spark, sf_dir):
    return V.msa(spark, sf_dir).select(F.col("seq_id").alias("rec_id"), F.substring("seq", 1, 24).alias("left"), F.substring("seq", 41, 24).alias("right"))


@query(
    f"""{_WITH}, {_FLANKS}, x AS (SELECT rec_id, i, substr("left", i, 4) AS s FROM flanks, unnest(range(1, 22)) AS u(i)), y AS (SELECT rec_id, j, substr("right", j, 4) AS s FROM flanks, unnest(range(1, 22)) AS u(j)),
        k AS (SELECT rec_id, i, j, i - row_number() OVER (PARTITION BY rec_id, i - j ORDER BY i) AS run FROM x JOIN y USING (rec_id, s)),
        r AS (SELECT rec_id, i - j AS diagonal, min(i) AS i, max(i) AS l, min(j) AS j FROM k GROUP BY rec_id, i - j, run)
        SELECT r.rec_id, CAST(i AS INTEGER) AS left_start, CAST(l + 3 AS INTEGER) AS left_end, CAST(j AS INTEGER) AS right_start, CAST(j + l - i + 3 AS INTEGER) AS right_end, substr("left", i, l - i + 4) AS tsd
        FROM r JOIN flanks USING (rec_id)"""
)
def flank_matches(spark, sf_dir):
    out = L.flank_matches(_flanks(spark, sf_dir))
    return out.select("rec_id", *(F.col(c).cast("int").alias(c) for c in ("left_start", "left_end", "right_start", "right_end")), "tsd")


@query()
def site_duplications(spark, sf_dir):
    found = L.site_duplications(_flanks(spark, sf_dir), similarity=0.9)
    return found.select("label", "records", F.array_join("tsds", ",").alias("tsds"))


@query(
    f"""{_WITH} SELECT seq_id, substr(seq, CAST(1 + seq_id % 20 AS BIGINT), 30) AS plus,
        CASE WHEN seq_id % 2 = 0 THEN regexp_replace(substr(seq, CAST(1 + seq_id % 20 AS BIGINT), 30), '[^acgt]', '', 'g')
        ELSE regexp_replace(translate(reverse(substr(seq, CAST(1 + seq_id % 20 AS BIGINT), 30)), 'acgt', 'tgca'), '[^acgt]', '', 'g') END AS seq FROM seqs"""
)
def interval_fetch(spark, sf_dir):
    msa = V.msa(spark, sf_dir)
    genome = msa.select(F.col("seq_id").alias("chrom"), "seq")
    start = F.col("seq_id") % 20
    places = msa.select(F.col("seq_id").alias("chrom"), "seq_id", start.alias("start"), (start + 30).alias("end"), F.when(F.col("seq_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    both = I.fetch(places, genome, tile=16)
    plus = I.fetch(places.withColumn("strand", F.lit("+")), genome, tile=16, drop_other=False).select("seq_id", F.col("seq").alias("plus"))
    return both.select("seq_id", "seq").join(plus, "seq_id")


_MOTIF = """CASE WHEN substr(seq, 21, 2) = 'tg' OR contains(substr(seq, 6, 30), 'tg') THEN 'tg' WHEN substr(seq, 21, 2) = 'ca' THEN 'ca' ELSE 'False' END AS start_pattern,
    CASE WHEN substr(seq, 21, 2) = 'tg' THEN 20 WHEN contains(substr(seq, 6, 30), 'tg') THEN 5 + instr(substr(seq, 6, 30), 'tg') - 1 ELSE 20 END AS start,
    CASE WHEN substr(seq, 43, 2) = 'ca' OR contains(substr(seq, 30, 30), 'ca') THEN 'ca' ELSE 'False' END AS end_pattern,
    CASE WHEN substr(seq, 43, 2) = 'ca' THEN 44 WHEN contains(substr(seq, 30, 30), 'ca') THEN 29 + 30 - instr(reverse(substr(seq, 30, 30)), 'ac') + 1 ELSE 44 END AS \"end\""""


@query(f"{_WITH} SELECT seq_id, {_MOTIF} FROM seqs")
def end_motifs(spark, sf_dir):
    seq = F.col("seq")
    rows = V.msa(spark, sf_dir).select("seq_id", S.start_motif(seq, F.lit(20), ["tg", "ca"]).alias("s"), S.end_motif(seq, F.lit(44), ["ca"]).alias("e"))
    return rows.select("seq_id", F.col("s.pattern").alias("start_pattern"), F.col("s.position").cast("long").alias("start"), F.col("e.pattern").alias("end_pattern"), F.col("e.position").cast("long").alias("end"))


@query(
    f"""{_WITH} SELECT seq_id, greatest(length(seq) - length(replace(seq, 'a', '')), length(seq) - length(replace(seq, 'c', '')), length(seq) - length(replace(seq, 'g', '')),
        length(seq) - length(replace(seq, 't', ''))) / length(seq) AS top_share, substr(seq, 1, 25) AS head FROM seqs"""
)
def base_shares(spark, sf_dir):
    return V.msa(spark, sf_dir).select("seq_id", S.top_base_share(F.upper("seq")).alias("top_share"), S.clipped(F.col("seq"), F.lit(-5), F.lit(25)).alias("head"))


@query(
    """SELECT o_orderkey, CASE WHEN k < 1000 THEN k || ' bp' WHEN k < 1000000 THEN printf('%.1f Kbp', k / 1000) WHEN k < 1000000000 THEN printf('%.1f Mbp', k / 1000000) ELSE printf('%.1f Gbp', k / 1000000000) END AS size,
        CASE WHEN s < 40 THEN '<40' WHEN s < 50 THEN '40-50' WHEN s < 80 THEN '50-80' WHEN s < 200 THEN '80-200' ELSE '>=200' END AS bucket
        FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 40 AS k, o_orderkey % 300 AS s FROM orders)"""
)
def shown_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", S.size_text(k * k * 40).alias("size"), S.score_bucket(k % 300).alias("bucket"))


@query(
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey * 3 AS s, l_partkey * 3 + 300 AS e, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS d, l_suppkey % 30 + 1 AS a, l_suppkey % 30 + 40 AS b FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN d = '-' THEN e - 3 * b + 1 ELSE s + 3 * a - 3 END AS domain_start, CASE WHEN d = '-' THEN e - 3 * a + 3 ELSE s + 3 * b - 1 END AS domain_end,
        s + 3 * (a - 1) AS hit_start, s + 3 * (b - 1) AS hit_end FROM o"""
)
def domain_spans(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    s, a, b = F.col("l_partkey") * 3, F.col("l_suppkey") % 30 + 1, F.col("l_suppkey") % 30 + 40
    d = F.when(F.col("l_linestatus") == "O", "+").otherwise("-")
    start, end = S.domain_span(s, s + 300, d, a, b)
    low, high = S.protein_hit_span(s, s + 300, a, b)
    return li.select("l_orderkey", "l_linenumber", start.alias("domain_start"), end.alias("domain_end"), low.alias("hit_start"), high.alias("hit_end"))


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linestatus = 'F' THEN (abs(e - l) + 1) / (e + s) * 100 ELSE (abs(e - s) + 1) / (e + l) * 100 END, 6) AS coverage,
        CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand FROM (SELECT *, l_suppkey + 1 AS s, l_suppkey + CAST(l_quantity AS BIGINT) * 4 AS e, l_linenumber AS l FROM lineitem)"""
)
def repeat_coverage(spark, sf_dir):
    strand = F.when(F.col("l_linestatus") == "F", "C").otherwise("+")
    start, end = F.col("l_suppkey") + 1, F.col("l_suppkey") + F.col("l_quantity").cast("long") * 4
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.repeat_coverage(strand, start, end, F.col("l_linenumber")), 6).alias("coverage"), S.plain_strand(strand).alias("strand"))


_ELEMENTS = """e AS (SELECT o_orderkey AS name, o_custkey % 60 AS s, 1000 - o_orderkey % 70 AS e, o_custkey % 60 + o_orderkey % 25 AS ms, 1000 - o_orderkey % 70 - o_custkey % 13 AS me,
    o_orderkey % 5 AS f, o_orderkey % 4 AS p, o_custkey % 40 AS n, o_orderkey % 3 = 0 AS t, o_custkey % 60 + o_orderkey % 90 AS ts, 900 + o_custkey % 60 AS te FROM orders)"""


@query(
    f"""WITH {_ELEMENTS}, g AS (SELECT *, CASE WHEN abs(s - ms) <= 15 AND abs(e - me) <= 15 AND s >= 40 AND e <= 960 AND f >= 3 THEN 'Perfect'
        WHEN s >= 40 AND e <= 960 AND (f >= 2 OR (t AND ts - s <= 40 AND te - e <= 40)) THEN 'Good' WHEN n >= 20 AND s >= 40 AND e <= 960 AND p >= 2 THEN 'Reco_check' ELSE 'Need_check' END AS evaluation FROM e),
        h AS (SELECT name, CASE WHEN name % 11 = 0 THEN 'Need_ext' WHEN evaluation = 'Need_check' AND s >= 40 AND abs(1000 - e) >= 40 AND n % 7 >= 3 THEN 'Reco_check' ELSE evaluation END AS evaluation FROM g)
        SELECT name, evaluation, evaluation AS folder FROM h"""
)
def element_grades(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start, end = c % 60, 1000 - k % 70
    level = U.grade(start, end, start + k % 25, end - c % 13, F.lit(1000), k % 5, k % 4, c % 40, k % 3 == 0, start + k % 90, 900 + c % 60)
    final = U.promoted(level, start, end, F.lit(1000), c % 40 % 7, k % 11 != 0)
    return V.table(spark, sf_dir, "orders").select(k.alias("name"), final.alias("evaluation")).withColumn("folder", U.folder(F.col("evaluation")))


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_custkey % 90 >= 50 THEN 700 ELSE 900 END AS "end",
        o_custkey % 3 <> 0 AND (o_custkey % 70 >= 30 OR o_orderkey % 70 >= 30) AS again FROM orders"""
)
def boundary_arbitration(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    te_class = F.when(c % 3 == 0, "LINE/L1").otherwise("LTR")
    tail = F.when(k % 2 == 0, 700)
    _, end = U.final_boundary(te_class, F.lit(10), F.lit(900), tail, c % 90)
    again = U.recompute_coverage(te_class, c % 70, F.lit(900), F.lit(0), 900 + k % 70)
    return V.table(spark, sf_dir, "orders").select("o_orderkey", end.alias("end"), again.alias("again"))


@query(
    """SELECT 'p' || p_partkey AS name, p_type AS te_class, 'accepted' AS provenance FROM part WHERE p_size > 20
        UNION ALL SELECT 'p' || p_partkey, p_type, 'low_copy' FROM part WHERE p_size % 7 = 0
        UNION ALL SELECT 'p' || p_partkey, p_type, 'input' FROM part WHERE p_size % 7 <> 0 AND p_partkey % 5 >= 2 AND p_size <= 20"""
)
def curated_library(spark, sf_dir):
    rows = V.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("te_class"), F.col("p_name").alias("seq"), (F.col("p_size") % 7 == 0).alias("low_copy"),
        (F.col("p_partkey") % 5).alias("full_hits"), "p_size",
    )
    return U.library(rows.where("p_size > 20"), rows).select("name", "te_class", "provenance")


@query(f"{_WITH} SELECT CAST(seq_id AS VARCHAR) AS name, CASE WHEN seq_id % 3 = 0 THEN translate(reverse(seq), 'acgt', 'tgca') ELSE seq END AS seq, CASE WHEN seq_id % 3 = 0 THEN length(seq) - 50 ELSE 5 END AS start, CASE WHEN seq_id % 3 = 0 THEN length(seq) - 5 ELSE 50 END AS \"end\" FROM seqs")
def redirected_rows(spark, sf_dir):
    rows = V.msa(spark, sf_dir).select(F.col("seq_id").cast("string").alias("name"), "seq", F.lit(5).alias("start"), F.lit(50).alias("end"), "seq_id")
    out = U.redirected(rows.drop("seq_id"), rows.select("name", (F.col("seq_id") % 3 != 0).alias("keeps")))
    return out.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


@query(
    f"""WITH {V.HITS}, {V.CHROM_LEN} SELECT chrom, CAST(sum("end" - start) AS BIGINT) AS covered, round(sum("end" - start) / (SELECT sum(length) FROM chrom_len), 9) AS share FROM hits GROUP BY chrom"""
)
def genome_shares(spark, sf_dir):
    covered = V.hits(spark, sf_dir).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return U.genome_shares(covered, V.chrom_lengths(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("SELECT c_name || ' x' AS chrom, 'chr_' || row_number() OVER (ORDER BY c_custkey) AS new_name FROM customer")
def chromosome_names(spark, sf_dir):
    genome = V.table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(" x")).alias("chrom"), F.col("c_custkey").alias("ordinal"))
    return U.chromosome_names(genome)


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS input_name, coalesce(CAST(o_orderkey AS VARCHAR), 'NaN') AS output_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'"""
)
def summary_rows(spark, sf_dir):
    inputs = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_name"))
    return U.summary_rows(inputs, V.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("input_name"), F.col("o_orderkey").alias("output_name")))


@query()
def feature_tracks(spark, sf_dir):
    rows = V.hits(spark, sf_dir).select(F.col("query").alias("name"), "start", "end", F.col("hit_id").cast("string").alias("feature"))
    return U.pack_tracks(rows)


@query()
def greedy_clusters_approximate(spark, sf_dir):
    rows = V.msa(spark, sf_dir).select(F.col("seq_id").cast("string").alias("name"), F.replace(F.col("seq"), F.lit("-"), F.lit("")).alias("seq"))
    return L.greedy_clusters_approximate(rows, k=4, share=0.3)


@query()
def local_alignment_stats(spark, sf_dir):
    msa = V.msa(spark, sf_dir)
    firsts = msa.groupBy("msa_id").agg(F.min_by("seq", "seq_id").alias("first"))
    return msa.join(firsts, "msa_id").select("seq_id", S.local_alignment(F.col("seq"), F.col("first")).alias("x")).select("seq_id", "x.*")


@query()
def orf_scan(spark, sf_dir):
    rows = V.msa(spark, sf_dir).groupBy(F.col("msa_id").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))), lambda x: F.replace(x["seq"], F.lit("-"), F.lit(""))), "").alias("seq"))
    return S.orfs(rows, least=60)


@query(
    f"""WITH {V.MSA}, s AS (SELECT seq_id, reverse(upper(right(seq, CAST(floor(length(seq) / 2.5) AS BIGINT)))) AS tail, length(seq) AS n
            FROM (SELECT seq_id, string_agg(base, '' ORDER BY col) AS seq FROM cells GROUP BY seq_id)),
        f AS (SELECT seq_id, n, regexp_extract(tail, '^(.*?)(A{{4,}})[^A]', 2) <> '' AS one, length(regexp_extract(tail, '^(.*?)(A{{4,}})[^A]', 1)) AS p,
                     regexp_extract(tail, '^(.*?)((GC){{4}})', 2) <> '' AS two, length(regexp_extract(tail, '^(.*?)((GC){{4}})', 1)) AS q FROM s)
        SELECT seq_id, CAST(CASE WHEN one THEN n - p - 1 WHEN two THEN n - q - 6 ELSE -1 END AS INTEGER) AS tail_end FROM f"""
)
def poly_tails(spark, sf_dir):
    return V.msa(spark, sf_dir).select("seq_id", F.coalesce(S.poly_tail(F.col("seq"), ("A", "CG"), 4), F.lit(-1)).alias("tail_end"))

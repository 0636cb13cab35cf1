"""Sources and sinks as queries: the driver's tables are written in the formats of the field, into the folder that all
executors share, and read back; and the small operators around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import alignment as A
from ..operators import clustering as L
from ..operators import curation as U
from ..operators import hits as H
from ..operators import metrics as M
from ..operators import principal as P
from ..operators import ranking as R
from ..sources import readers, tiled, writers
from . import ranking_queries as RQ
from . import views as V
from . import workflows as W
from .registry import query


def _lines(rows: DataFrame, line: Column, compression: str = "none") -> str:
    """A folder of text files with a line for each row."""
    path = L.shared_folder(rows.sparkSession)
    rows.select(line.alias("value")).write.option("compression", compression).text(path)
    return path


def _tabbed(*columns: str | Column) -> Column:
    return F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns))


def _ungapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.msa(spark, sf_dir).withColumn("seq", F.upper(F.replace("seq", F.lit("-"), F.lit(""))))


_UNGAPPED = f"""{V.MSA}, ungapped AS (SELECT msa_id, seq_id, upper(replace(string_agg(base, '' ORDER BY col), '-', '')) AS seq FROM cells GROUP BY msa_id, seq_id)"""


@query(
    f"""WITH {_UNGAPPED} SELECT 'fam_' || seq_id % 400 || CASE WHEN k > 1 THEN '_n' || k ELSE '' END AS name, 'LTR/' || msa_id AS te_class, 'row ' || seq_id AS description, seq
        FROM (SELECT *, row_number() OVER (PARTITION BY seq_id % 400 ORDER BY seq_id) AS k FROM ungapped)"""
)
def library_file(spark, sf_dir):
    """Wrapped FASTA, compressed, in one file, as names are numbered in the file's order."""
    rows = _ungapped(spark, sf_dir).orderBy("seq_id").coalesce(1)
    wrapped = F.regexp_replace("seq", "(.{20})", "$1\n")
    text = F.concat(F.lit(">fam-"), (F.col("seq_id") % 400).cast("string"), F.lit("#LTR/"), F.col("msa_id").cast("string"), F.lit(" row "), F.col("seq_id").cast("string"), F.lit("\n"), wrapped)
    return readers.library(spark, _lines(rows, text, "gzip")).select("name", "te_class", "description", "seq")


@query(f"WITH {_UNGAPPED} SELECT 's' || seq_id AS header, seq FROM ungapped")
def fasta_files(spark, sf_dir):
    """Many files, as the sink writes them."""
    rows = _ungapped(spark, sf_dir).repartition(5)
    path = L.shared_folder(spark)
    writers.to_fasta(rows, path, F.concat(F.lit("s"), F.col("seq_id").cast("string")), wrap=30)
    return readers.fasta(spark, path).select("header", "seq")


@query(f"WITH {_UNGAPPED} SELECT 'k' || seq_id % 50 AS key, arg_max(seq, seq_id) AS seq FROM ungapped GROUP BY 1")
def later_records(spark, sf_dir):
    rows = _ungapped(spark, sf_dir).orderBy("seq_id").coalesce(1)
    path = _lines(rows, F.concat(F.lit(">k"), (F.col("seq_id") % 50).cast("string"), F.lit("#x\n"), F.col("seq")))
    return readers.first_by_name(readers.fasta(spark, path)).select("key", "seq")


@query(f"""WITH {V.MSA}, g AS (SELECT seq_id, regexp_replace(upper(string_agg(base, '' ORDER BY col)), '[^ACGT]', 'N', 'g') AS seq FROM cells GROUP BY seq_id)
           SELECT 'chr' || seq_id AS chrom, CAST(length(seq) AS BIGINT) AS length, CAST(length(seq) - length(replace(seq, 'N', '')) AS BIGINT) AS ambiguous FROM g""")
def genome_file(spark, sf_dir):
    path = _lines(V.msa(spark, sf_dir), F.concat(F.lit(">chr"), F.col("seq_id").cast("string"), F.lit(" some words\n"), F.replace("seq", F.lit("-"), F.lit("r"))))
    genome = readers.genome(spark, path)
    ambiguous = (F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))).cast("long")
    return readers.lengths_of(genome).join(genome.select("chrom", ambiguous.alias("ambiguous")), "chrom")


@query(f"""WITH {_UNGAPPED}, g AS (SELECT 'chr' || msa_id AS chrom, string_agg(replace(seq, 'T', 'N'), '' ORDER BY seq_id) AS seq FROM ungapped GROUP BY 1)
           SELECT chrom, CAST(length(seq) AS BIGINT) AS length, i AS tile, i * 500 AS first, substr(seq, CAST(i * 500 + 1 AS BIGINT), 500) AS part FROM g, unnest(range(0, (length(seq) + 499) // 500)) AS u(i)""")
def genome_tiles(spark, sf_dir):
    """Records of wrapped lines, in tiles."""
    seq = F.array_join(F.array_sort(F.collect_list(F.struct("seq_id", F.replace(F.col("seq"), F.lit("T"), F.lit("y")).alias("s"))))["s"], "")
    rows = _ungapped(spark, sf_dir).groupBy("msa_id").agg(seq.alias("seq"))
    path = _lines(rows, F.concat(F.lit(">chr"), F.col("msa_id").cast("string"), F.lit(" some words\n"), F.regexp_replace("seq", "(.{60})", "$1\n")))
    return tiled.genome_tiles(spark, path, tile=500)


@query(f"WITH {V.HITS}, {V.CHROM_LEN} SELECT chrom, length FROM chrom_len")
def length_file(spark, sf_dir):
    path = L.shared_folder(spark)
    writers.to_tsv(V.chrom_lengths(spark, sf_dir).select("chrom", "length"), path)
    return readers.lengths(spark, path)


def _hit_line() -> Column:
    return _tabbed("qseqid", "sseqid", "pident", "length", F.lit(0), F.lit(1), "qstart", "qend", "sstart", "send", "sstrand", "evalue", F.lit(88))


_HIT_SQL = f"""WITH {V.M8} SELECT CAST(qseqid AS VARCHAR) AS qseqid, sseqid, pident, length, CAST(1 AS BIGINT) AS gapopen, qstart, qend, sstart, send, sstrand, evalue, CAST(88 AS BIGINT) AS qcovhsp FROM m8"""


@query(_HIT_SQL)
def hit_file(spark, sf_dir):
    return readers.hits(spark, _lines(V.m8(spark, sf_dir), _hit_line())).drop("mismatch")


@query(_HIT_SQL)
def hit_file_between_blanks(spark, sf_dir):
    """Any blanks between columns, and lines that do not fit."""
    rows = V.m8(spark, sf_dir).select(F.regexp_replace(F.concat(F.lit("  "), _hit_line()), "\t", "   ").alias("value"))
    extra = spark.sql("SELECT * FROM VALUES ('qseqid sseqid pident'), ('cut short'), ('') AS t(value)")
    path = L.shared_folder(spark)
    rows.unionByName(extra).write.text(path)
    return readers.hits_by_blanks(spark, path).drop("mismatch")


@query(f"""WITH {V.HITS} SELECT chrom, start, "end", CAST(hit_id AS VARCHAR) AS name, '0' AS score, strand FROM hits""")
def bed_file(spark, sf_dir):
    return readers.bed(spark, _lines(V.hits(spark, sf_dir), _tabbed("chrom", "start", "end", "hit_id", F.lit(0), "strand")))


@query(f"""WITH {V.HITS} SELECT chrom, start, "end", hit_id, pident, strand, "end" - start AS alnlen, CAST(query AS VARCHAR) AS query, CAST(1 AS BIGINT) AS qstart, "end" - start AS qend FROM hits""")
def hit_bed_file(spark, sf_dir):
    n = F.col("end") - F.col("start")
    return readers.hit_bed(spark, _lines(V.hits(spark, sf_dir), _tabbed("chrom", "start", "end", "hit_id", "pident", "strand", n, "query", F.lit(1), n)))


_REPEATS = """rep AS (SELECT 'q' || query AS query_name, perc_div, query_start, query_end, query_left, class, repeat, query % 2 = 0 AS c, query % 90 AS score FROM rm)"""


def _repeat_file(spark, sf_dir):
    minus = F.col("query") % 2 == 0
    paren = lambda c: F.concat(F.lit("("), c.cast("string"), F.lit(")"))
    body = F.concat_ws(
        "  ", F.lit(""), (F.col("query") % 90).cast("string"), F.col("perc_div").cast("string"), F.lit("0.5"), F.lit("1.5"), F.concat(F.lit("q"), F.col("query").cast("string")),
        F.col("query_start").cast("string"), F.col("query_end").cast("string"), paren(F.col("query_left")), F.when(minus, "C").otherwise("+"), F.col("repeat").cast("string"), "class",
        F.when(minus, F.lit("(7)")).otherwise("1"), F.lit("40"), F.when(minus, "3").otherwise(F.lit("(5)")), F.lit("1"),
    )
    head = spark.sql("SELECT * FROM VALUES ('   SW   perc perc perc  query'), ('score   div. del. ins.  sequence'), ('') AS t(value)")
    path = L.shared_folder(spark)
    head.unionByName(V.rm(spark, sf_dir).select(body.alias("value"))).write.text(path)
    return readers.repeats(spark, path)


@query(f"""WITH {V.RM}, {_REPEATS} SELECT CAST(score AS BIGINT) AS score, perc_div, query_name, query_left, CASE WHEN c THEN '-' ELSE '+' END AS strand, CAST(repeat AS VARCHAR) AS repeat_name,
           class AS repeat_class, CAST(CASE WHEN c THEN 7 ELSE 1 END AS BIGINT) AS repeat_start, CAST(CASE WHEN c THEN 3 ELSE 5 END AS BIGINT) AS repeat_left FROM rep""")
def repeat_file(spark, sf_dir):
    return _repeat_file(spark, sf_dir).select("score", "perc_div", "query_name", "query_left", "strand", "repeat_name", "repeat_class", "repeat_start", "repeat_left")


@query(f"""WITH {V.RM}, {_REPEATS} SELECT query_name AS chrom, query_start AS start, query_end AS "end", class AS type, query_end - query_start AS length, CASE WHEN c THEN '-' ELSE '+' END AS strand
           FROM rep WHERE query_start < query_end""")
def repeat_track(spark, sf_dir):
    return readers.track(_repeat_file(spark, sf_dir), F.col("repeat_class"))


@query(f"""WITH {V.GRADED}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY length DESC, name) AS k FROM graded)
           SELECT 'Cluster' || cluster AS cluster, length, 'el_' || name AS name, CASE WHEN k = 1 THEN 'standard' ELSE printf('%.2f%%', CAST(90 + name % 10 AS DOUBLE)) END AS identity,
                  CASE WHEN k = 1 OR name % 2 = 0 THEN '+' ELSE '-' END AS direction FROM r""")
def cluster_file(spark, sf_dir):
    """Cluster files: a heading line, then a line for each member."""
    first = H.first_of(V.graded(spark, sf_dir).withColumn("_l", -F.col("length")), ["cluster"], ["_l", "name"]).select("cluster", F.col("name").alias("head"))
    rows = V.graded(spark, sf_dir).join(first, "cluster")
    at = F.concat(F.lit("... at 1:9:1:9/"), F.when(F.col("name") % 2 == 0, "+").otherwise("-"), F.lit("/"), F.format_string("%.2f%%", (90 + F.col("name") % 10).cast("double")))
    line = F.concat(F.lit("0\t"), F.col("length").cast("string"), F.lit("nt, >el_"), F.col("name").cast("string"), F.lit("#x"), F.when(F.col("name") == F.col("head"), "... *").otherwise(at))
    groups = rows.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    path = _lines(groups, F.concat(F.lit(">Cluster "), F.col("cluster").cast("string"), F.lit("\n"), F.col("lines")))
    return readers.clusters(spark, path)


@query(f"""WITH {V.MSA} SELECT 'all' AS msa_id, 's' || seq_id AS seq_id, upper(string_agg(base, '' ORDER BY col)) AS seq FROM cells GROUP BY seq_id""")
def alignment_file(spark, sf_dir):
    path = _lines(V.msa(spark, sf_dir), F.concat(F.lit(">s"), F.col("seq_id").cast("string"), F.lit(" x\n"), F.replace("seq", F.lit("-"), F.lit("."))))
    return readers.alignment(spark, path, "all").select("msa_id", "seq_id", "seq")


@query("""WITH leaf AS (SELECT n_name AS name, n_regionkey AS r, CAST(1 + n_nationkey % 7 AS DOUBLE) AS far FROM nation)
          SELECT a.name AS a, b.name AS b, CASE WHEN a.r = b.r THEN a.far + b.far ELSE a.far + b.far + 2.0 + 0.5 * (a.r + b.r) END AS d FROM leaf a JOIN leaf b ON a.name < b.name""")
def tree_file_distances(spark, sf_dir):
    """A tree of the nations inside their regions; trees are small, and given as text."""
    rows = V.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("n_name", F.lit(":"), (1 + F.col("n_nationkey") % 7).cast("string")))), ",").alias("leaves"))
    branch = F.concat(F.lit("("), "leaves", F.lit("):"), (1 + 0.5 * F.col("n_regionkey")).cast("string"))
    text = rows.agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(branch)), ","), F.lit(");"))).first()[0]
    return readers.tree_distances(spark, text)


@query("""SELECT DISTINCT 'te' || l_partkey AS TE_name, l_suppkey AS orf_start, l_suppkey + 300 AS orf_end, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS direction,
                 'ORF' || l_linenumber AS orf_name FROM lineitem""")
def orf_file(spark, sf_dir):
    """A table with a header, rows written twice."""
    li = V.table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.concat(F.lit("te"), F.col("l_partkey").cast("string")).alias("TE_name"), F.col("l_suppkey").alias("orf_start"), (F.col("l_suppkey") + 300).alias("orf_end"),
        F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("direction"), F.concat(F.lit("ORF"), F.col("l_linenumber").cast("string")).alias("orf_name"),
    )
    path = L.shared_folder(spark)
    writers.to_tsv(rows.unionByName(rows), path, header=True)
    return readers.table(spark, path, readers.ORFS)


@query(f"""WITH {V.GRADED} SELECT CAST(name AS VARCHAR) AS input_name, CASE WHEN name % 3 > 0 THEN te_class END AS output_TE_type, length AS input_length, low_copy, evaluation,
           CASE WHEN name % 4 > 0 THEN CAST(name % 100 AS DOUBLE) END AS input_coverage FROM graded""")
def summary_file(spark, sf_dir):
    """All 29 columns, the text NaN for what is missing."""
    g = V.graded(spark, sf_dir)
    known = {
        "input_name": F.col("name"), "output_TE_type": F.when(F.col("name") % 3 > 0, F.col("te_class")), "input_length": F.col("length"), "low_copy": F.col("low_copy"),
        "evaluation": F.col("evaluation"), "input_coverage": F.when(F.col("name") % 4 > 0, (F.col("name") % 100).cast("double")),
    }
    names = [f.split()[0] for f in readers.SUMMARY.split(", ")]
    path = L.shared_folder(spark)
    writers.to_summary(g.select(*(known.get(n, F.lit(None).cast("string")).cast("string").alias(n) for n in names)), path)
    return readers.summary(spark, path).select(*known)


@query(f"""WITH {V.HITS} SELECT DISTINCT chrom || ':x' AS chrom, start, "end", '.' AS name, '0' AS score, strand FROM hits""")
def header_intervals(spark, sf_dir):
    text = F.concat("chrom", F.lit(":x:"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("("), "strand", F.lit(")"))
    rows = V.hits(spark, sf_dir).select(text.alias("header"))
    return readers.headers_to_bed(rows.unionByName(rows).unionByName(spark.sql("SELECT 'no interval' AS header")))


@query(f"""WITH {_UNGAPPED} SELECT substr(seq, CAST(i AS INTEGER), 11) AS gram, 's' || seq_id AS chrom, CAST(i - 1 AS INTEGER) AS pos FROM ungapped, unnest(range(1, length(seq) - 9)) AS u(i)""")
def kmer_table(spark, sf_dir):
    return readers.kmer_index(_ungapped(spark, sf_dir).select(F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("chrom"), "seq"))


@query(f"""WITH {V.GRADED} SELECT evaluation, count(*) AS n, sum(length) AS bases FROM graded GROUP BY evaluation""")
def graded_folders(spark, sf_dir):
    path = L.shared_folder(spark)
    g = V.graded(spark, sf_dir)
    writers.to_folders(g.withColumn("evaluation", U.folder(F.col("evaluation"))), path)
    return spark.read.parquet(path).groupBy("evaluation").agg(F.count("*").alias("n"), F.sum("length").alias("bases"))


@query(f"""WITH {V.HITS} SELECT query % 20 AS q, min(start) AS start, max("end") AS "end", list(pident ORDER BY hit_id) AS coverage FROM hits GROUP BY 1""")
def coverage_export(spark, sf_dir):
    h = V.hits(spark, sf_dir).withColumn("q", F.col("query") % 20)
    bounds = h.groupBy("q").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cells = h.select("q", F.col("hit_id").alias("pos"), F.col("pident").alias("depth")).join(bounds, "q")
    return cells.groupBy("q").agg(writers.coverage_struct().alias("c")).select("q", "c.*")


@query("SELECT c_name AS original, replace(replace(c_name, '#', '_'), ' ', '_') AS name FROM customer")
def name_maps(spark, sf_dir):
    path = L.shared_folder(spark)
    c = V.table(spark, sf_dir, "customer").select("c_name", F.replace(F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(" "), F.lit("_")).alias("new"))
    writers.to_tsv(writers.name_map(c, "c_name", "new"), path, header=True)
    return spark.read.csv(path, sep="\t", header=True, schema="original string, name string")


@query(f"""WITH {V.M8}, r AS (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY pident DESC, ordinal, qstart, evalue) AS k FROM m8)
           SELECT p_partkey AS orf, ordinal, pident FROM part LEFT JOIN r ON p_partkey = qseqid AND k = 1""")
def orfs_with_best_hit(spark, sf_dir):
    """A left join of reading frames to their best protein hit."""
    best = H.best_protein_hits(V.m8(spark, sf_dir), "qseqid", "pident", ["ordinal", "qstart", "evalue"]).select(F.col("qseqid").alias("orf"), "ordinal", "pident")
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("orf")).join(best, "orf", "left")


@query(f"""WITH {V.M8} SELECT ordinal, CASE WHEN (qend - qstart) * (CASE WHEN sstrand = 'minus' THEN sstart - send ELSE send - sstart END) >= 0 THEN 'direct' ELSE 'inverted' END AS orientation FROM m8""")
def dot_plot_segments(spark, sf_dir):
    minus = F.col("sstrand") == "minus"
    rows = V.m8(spark, sf_dir).withColumns({"_s": F.when(minus, F.col("send")).otherwise(F.col("sstart")), "_e": F.when(minus, F.col("sstart")).otherwise(F.col("send"))})
    rows = rows.select("ordinal", "qstart", "qend", F.col("_s").alias("sstart"), F.col("_e").alias("send"))
    return H.dot_segments(rows).select("ordinal", "orientation")


@query(f"""WITH {V.GRADED}, s AS (SELECT cluster, avg(CASE WHEN te_class <> 'Unknown' THEN 1.0 ELSE 0.0 END) AS share, bool_or(low_copy) AS compressed FROM graded GROUP BY cluster)
           SELECT cluster, share >= 0.3 AND share < 0.99 AND NOT compressed AS wanted FROM s""")
def classification_gate(spark, sf_dir):
    rows = V.graded(spark, sf_dir).groupBy("cluster").agg(F.avg((F.col("te_class") != "Unknown").cast("double")).alias("share"), F.bool_or("low_copy").alias("compressed"))
    return rows.select("cluster", M.wants_classification(F.col("share"), F.col("compressed")).alias("wanted"))


@query(f"""WITH {V.GRADED} SELECT name, CASE WHEN te_class IS NULL OR te_class = 'NaN' OR lower(te_class) LIKE '%unknown%' THEN 'DNA/x' ELSE te_class END AS te_class, replace(te_class, '/', '__') AS file_class,
           TRY_CAST(replace(replace('(' || name || ')', '(', ''), ')', '') AS BIGINT) AS number FROM graded""")
def final_classes(spark, sf_dir):
    number = S.plain_int(F.concat(F.lit("("), F.col("name").cast("string"), F.lit(")")))
    return V.graded(spark, sf_dir).select("name", S.final_class(F.col("te_class"), F.lit("DNA/x")).alias("te_class"), S.file_class(F.col("te_class")).alias("file_class"), number.alias("number"))


@query(f"WITH {V.GRADED}, {RQ._ROLL}, r AS (SELECT *, row_number() OVER (ORDER BY share DESC, cluster) AS rank FROM roll) SELECT cluster, rank, evaluation, te_class FROM r")
def curation_cluster_folders(spark, sf_dir):
    """Clusters of a library by coverage, as they are laid out for curation."""
    return W.curation_clusters(V.graded(spark, sf_dir), F.col("length") / 1e9).select("cluster", F.col("rank").cast("long").alias("rank"), "evaluation", "te_class")


@query(
    f"""WITH {V.GRADED}, g AS (SELECT * REPLACE (CASE WHEN cluster % 3 = 0 THEN 'Need_check' ELSE evaluation END AS evaluation, low_copy AND cluster % 3 <> 0 AS low_copy) FROM graded),
        rep AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE evaluation WHEN 'Perfect' THEN 1 WHEN 'Good' THEN 2 WHEN 'Reco_check' THEN 3 ELSE 4 END, length DESC, name) AS k
                FROM g WHERE evaluation IN ('Perfect', 'Good', 'Reco_check') OR low_copy),
        rest AS (SELECT * FROM g WHERE cluster NOT IN (SELECT cluster FROM rep))
        SELECT name FROM rep WHERE k = 1 UNION ALL SELECT arg_max(name, (length, name)) FROM rest GROUP BY name % 40"""
)
def merged_library(spark, sf_dir):
    """Representatives of a first clustering, and those of a second one for what had none."""
    g = V.graded(spark, sf_dir)
    third = F.col("cluster") % 3 == 0
    g = g.withColumns({"evaluation": F.when(third, "Need_check").otherwise(F.col("evaluation")), "low_copy": F.col("low_copy") & ~third})
    return W.merge_library(g, g.select("name", (F.col("name") % 40).alias("cluster")))


@query(f"""WITH {V.HITS}, u AS (SELECT chrom, 1 AS side, hit_id FROM hits WHERE hit_id % 3 = 0 UNION ALL SELECT strand, 2, hit_id FROM hits WHERE hit_id % 5 = 0),
           f AS (SELECT chrom AS value, min(side) AS side, arg_min(hit_id, (side, hit_id)) AS first FROM u GROUP BY chrom) SELECT value, row_number() OVER (ORDER BY side, first) AS place FROM f""")
def ordered_union(spark, sf_dir):
    """A union without duplicates, in order of first occurrence."""
    h = V.hits(spark, sf_dir)
    a, b = h.where("hit_id % 3 = 0").select(F.col("chrom").alias("value"), "hit_id"), h.where("hit_id % 5 = 0").select(F.col("strand").alias("value"), "hit_id")
    return R.ordered_union([a, b], "value", "hit_id")


@query(f"""WITH {V.HITS}, n AS (SELECT chrom, start, "end", hit_id, row_number() OVER (ORDER BY chrom, start, "end", hit_id) - 1 AS place FROM hits) SELECT * FROM n""")
def genome_order(spark, sf_dir):
    """Intervals with their places in genome order."""
    return R.placed(V.hits(spark, sf_dir).select("chrom", "start", "end", "hit_id"), "chrom", ["start", "end", "hit_id"])


@query("""SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CAST(floor(value) AS BIGINT) // 3600 || ':' || lpad(CAST(CAST(floor(value) AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' ||
                 lpad(CAST(CAST(floor(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration FROM events""")
def run_stamps(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", S.run_stamp(F.col("ts")).alias("stamp"), S.duration_text(F.floor("value")).alias("duration"))


@query()
def principal_components(spark, sf_dir):
    """Two coordinates for each row of each alignment, from its distances to the others."""
    return P.principal_components_aligned(V.msa(spark, sf_dir))

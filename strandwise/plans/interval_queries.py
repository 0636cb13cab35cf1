"""Interval and hit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hits as H
from ..operators import intervals as I
from . import views as V
from .registry import query

_ISLANDS = """marked AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom, strand ORDER BY start, "end"
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    merged AS (SELECT chrom, strand, min(start) AS start, max("end") AS "end", count(*) AS n FROM numbered GROUP BY chrom, strand, island)"""


@query(f'WITH {V.HITS}, {_ISLANDS} SELECT chrom, strand, CAST(sum("end" - start) AS BIGINT) AS covered FROM merged GROUP BY chrom, strand')
def interval_union_length(spark, sf_dir):
    return I.union_length(V.hits(spark, sf_dir), ["chrom", "strand"])


@query(f"WITH {V.HITS}, {_ISLANDS} SELECT * FROM merged")
def interval_merge(spark, sf_dir):
    return I.merge(V.hits(spark, sf_dir), ["chrom", "strand"])


@query(
    f"""WITH {V.M8}, hits AS (SELECT sseqid AS chrom, sstrand AS strand, least(sstart, send) AS start, greatest(sstart, send) AS "end" FROM m8
        WHERE pident >= 92 AND evalue <= 0.05), {_ISLANDS} SELECT chrom, strand, CAST(sum("end" - start) AS BIGINT) AS covered FROM merged GROUP BY chrom, strand"""
)
def hit_union_length(spark, sf_dir):
    hits = V.m8(spark, sf_dir).select(F.col("sseqid").alias("chrom"), F.col("sstrand").alias("strand"), F.col("sstart").alias("start"), F.col("send").alias("end"), "pident", "evalue")
    return I.hit_union_length(hits, ["chrom", "strand"], 92, 0.05)


@query(
    f"""WITH {V.HITS}, {_ISLANDS}, plain AS (SELECT * FROM numbered) SELECT chrom, strand, min(start) AS start, max("end") AS "end",
        array_to_string(list(CAST(query % 4 AS VARCHAR) ORDER BY start, "end", query % 4), ',') AS types,
        array_to_string(list_sort(list_distinct(list(CAST(query % 4 AS VARCHAR)))), ',') AS distinct_types FROM plain GROUP BY chrom, strand, island"""
)
def interval_merge_collect(spark, sf_dir):
    rows = V.hits(spark, sf_dir).withColumn("type", (F.col("query") % 4).cast("string"))
    return I.merge_collect(rows, ["chrom", "strand"]).select("chrom", "strand", "start", "end", F.array_join("types", ",").alias("types"), F.array_join("distinct_types", ",").alias("distinct_types"))


_COMPLEMENT = """allm AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 0 ELSE 1 END AS fresh FROM hits), alln AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM allm),
    whole AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM alln GROUP BY chrom, island UNION ALL SELECT chrom, length, length FROM chrom_len),
    gaps AS (SELECT chrom, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY start, "end"), 0) AS start, start AS "end" FROM whole)"""


@query(f'WITH {V.HITS}, {V.CHROM_LEN}, {_COMPLEMENT} SELECT chrom, start, "end" FROM gaps WHERE start < "end"')
def interval_complement(spark, sf_dir):
    return I.complement(V.hits(spark, sf_dir), V.chrom_lengths(spark, sf_dir))


_OVER = 'greatest(a.start, b.start) < least(a."end", b."end")'


@query(
    f"""WITH {V.HITS}, {V.TRACKS} SELECT a.chrom, a.start, a."end", a.type, coalesce(b.start, -1) AS b_start, coalesce(b."end", -1) AS b_end, coalesce(b.type, '.') AS b_type,
        CASE WHEN b.start IS NULL THEN 0 ELSE least(a."end", b."end") - greatest(a.start, b.start) END AS overlap
        FROM (SELECT * FROM tracks WHERE side = 0) a LEFT JOIN (SELECT * FROM tracks WHERE side = 1) b ON a.chrom = b.chrom AND {_OVER}"""
)
def interval_overlap_wao(spark, sf_dir):
    a, b = V.tracks(spark, sf_dir)
    return I.overlap_join(a, b, left_outer=True).drop("b_chrom").na.fill({"b_start": -1, "b_end": -1, "b_type": "."})


_CROSS = """lens AS (SELECT chrom, max("end") + 1000 AS length FROM tracks GROUP BY chrom),
    sided AS (SELECT t.chrom, t.side, t.start, t."end" FROM tracks t UNION ALL SELECT chrom, s, length, length FROM lens, (VALUES (0), (1)) AS v(s)),
    reach AS (SELECT chrom, side, coalesce(max("end") OVER (PARTITION BY chrom, side ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        start AS "end" FROM sided),
    tagged AS (SELECT chrom, side, start, "end", type FROM tracks UNION ALL SELECT chrom, side, start, "end", 'Not-TE' FROM reach WHERE start < "end"),
    lengths AS (SELECT a.type AS query, b.type AS reference, CAST(sum(least(a."end", b."end") - greatest(a.start, b.start)) AS BIGINT) AS length
        FROM tagged a JOIN tagged b ON a.side = 0 AND b.side = 1 AND a.chrom = b.chrom AND greatest(a.start, b.start) < least(a."end", b."end") GROUP BY ALL)"""
CROSS = f"{V.HITS}, {V.TRACKS}, {_CROSS}"


def cross(spark, sf_dir):
    a, b = V.tracks(spark, sf_dir)
    sizes = a.unionByName(b).groupBy("chrom").agg((F.max("end") + 1000).alias("length"))
    return I.cross_lengths(a, b, sizes)


@query(f"WITH {CROSS} SELECT * FROM lengths")
def track_cross_lengths(spark, sf_dir):
    return cross(spark, sf_dir)


@query(
    f"""WITH {V.HITS}, marks AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        max("end") OVER (PARTITION BY chrom, start) AS same, count(*) OVER (PARTITION BY chrom, start, "end") AS copies FROM hits)
        SELECT chrom, start, "end", strand, query, hit_id, pident FROM marks
        WHERE NOT (coalesce(before, "end" - 1) >= "end" OR same > "end") AND copies = 1"""
)
def interval_drop_contained(spark, sf_dir):
    return I.drop_contained(V.hits(spark, sf_dir), ["chrom"])


@query(
    f"""WITH {V.HITS}, m AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        max("end") OVER (PARTITION BY chrom, start) AS same, count(*) OVER (PARTITION BY chrom, start, "end") AS copies FROM hits),
        k AS (SELECT chrom, start, "end" FROM m WHERE NOT (coalesce(before, "end" - 1) >= "end" OR same > "end") AND copies = 1)
        SELECT chrom, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY start, "end") + 1, start) AS start, "end" FROM k"""
)
def interval_chain_starts(spark, sf_dir):
    return I.chain_starts(I.drop_contained(V.hits(spark, sf_dir), ["chrom"]), ["chrom"]).select("chrom", "start", "end")


@query(
    f"""WITH {V.HITS}, {V.CHROM_LEN} SELECT chrom, greatest(0, start - CASE WHEN strand = '-' THEN 50 ELSE 300 END) AS start,
        least(length, "end" + CASE WHEN strand = '-' THEN 300 ELSE 50 END) AS "end", strand, query, hit_id, pident FROM hits JOIN chrom_len USING (chrom)"""
)
def slop_clamped(spark, sf_dir):
    return I.slop(V.hits(spark, sf_dir), V.chrom_lengths(spark, sf_dir), 300, 50)


@query(
    f"""WITH {V.HITS} SELECT hit_id, CASE WHEN strand = '+' THEN "end" - 1 ELSE start END AS start, CASE WHEN strand = '+' THEN "end" ELSE start + 1 END AS "end" FROM hits"""
)
def terminal_base_right(spark, sf_dir):
    return I.terminal_base(V.hits(spark, sf_dir), "right").select("hit_id", "start", "end")


_DEPTH = """edges AS (SELECT query, start AS pos, 1 AS d FROM hits UNION ALL SELECT query, "end", -1 FROM hits),
    steps AS (SELECT query, pos, sum(d) AS d FROM edges GROUP BY query, pos HAVING sum(d) <> 0),
    runs AS (SELECT query, pos AS start, lead(pos) OVER (PARTITION BY query ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY query ORDER BY pos) AS depth FROM steps)"""


@query(f'WITH {V.HITS}, {_DEPTH} SELECT query, start, "end", CAST(depth AS BIGINT) AS depth FROM runs WHERE depth > 0')
def depth_profile(spark, sf_dir):
    return I.depth_runs(V.hits(spark, sf_dir), ["query"])


_TOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY "end" - start DESC, hit_id) AS r FROM hits),
    weighted AS (SELECT *, CASE WHEN r <= 10 THEN 3 ELSE 1 END AS weight FROM ranked)"""


@query(
    f"""WITH {V.HITS}, {_TOP}, edges AS (SELECT query, start AS pos, weight AS d FROM weighted UNION ALL SELECT query, "end", -weight FROM weighted),
    steps AS (SELECT query, pos, sum(d) AS d FROM edges GROUP BY query, pos HAVING sum(d) <> 0),
    runs AS (SELECT query, pos AS start, lead(pos) OVER (PARTITION BY query ORDER BY pos) AS "end", sum(d) OVER (PARTITION BY query ORDER BY pos) AS depth FROM steps)
    SELECT query, start, "end", CAST(depth AS BIGINT) AS depth FROM runs WHERE depth > 0"""
)
def weighted_top10_depth(spark, sf_dir):
    rows = V.hits(spark, sf_dir).withColumn("_len", F.col("end") - F.col("start"))
    return I.depth_runs(I.longest_weighted(rows, ["query"], "_len", ["hit_id"]), ["query"], weight=F.col("weight"))


_POS = """pos AS (SELECT query, p AS pos, CAST(count(*) AS BIGINT) AS depth FROM (SELECT query, unnest(range(start // 600, ("end" - 1) // 600 + 1)) AS p FROM hits) GROUP BY query, p)"""


def positions(spark, sf_dir):
    """Depth by blocks of ten minutes, a sequence of positions for each query."""
    blocks = F.sequence(F.floor(F.col("start") / 600), F.floor((F.col("end") - 1) / 600))
    return V.hits(spark, sf_dir).select("query", F.explode(blocks).alias("pos")).groupBy("query", "pos").agg(F.count("*").alias("depth"))


_BOUND = """w AS (SELECT *, sum(depth) OVER (PARTITION BY query ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS a,
        count(*) OVER (PARTITION BY query ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS na,
        sum(depth) OVER (PARTITION BY query ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS b,
        count(*) OVER (PARTITION BY query ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS nb FROM pos),
    e AS (SELECT query, min(pos) FILTER (na = 20 AND a > 30) AS f, max(pos) FILTER (nb = 20 AND b > 30) AS l FROM w GROUP BY query),
    bound AS (SELECT query, min(pos) FILTER (pos BETWEEN f AND f + 19 AND depth >= 3) AS start, max(pos) FILTER (pos BETWEEN l - 19 AND l AND depth >= 3) + 1 AS "end"
        FROM pos JOIN e USING (query) GROUP BY query)"""


@query(f"WITH {V.HITS}, {_POS}, {_BOUND} SELECT * FROM bound")
def coverage_boundary(spark, sf_dir):
    return I.coverage_boundary(positions(spark, sf_dir), mass=30, least=3)


@query(
    f"""WITH {V.HITS}, {_POS}, {_BOUND}, j AS (SELECT query, pos, greatest(1, depth) / greatest(1, lag(depth) OVER (PARTITION BY query ORDER BY pos)) AS up,
        greatest(1, depth) / greatest(1, lead(depth) OVER (PARTITION BY query ORDER BY pos)) AS down FROM pos)
        SELECT query, coalesce(min(pos) FILTER (pos > start AND pos <= start + 20 AND up >= 2), min(start)) AS start,
        coalesce(max(pos + 1) FILTER (pos < "end" - 1 AND pos >= "end" - 11 AND down >= 2), min("end")) AS "end" FROM j JOIN bound USING (query) GROUP BY query"""
)
def jump_refine(spark, sf_dir):
    depth = positions(spark, sf_dir)
    return I.refine_boundary(depth, I.coverage_boundary(depth, mass=30, least=3), step=2)


@query(
    f"""WITH {V.HITS}, bound AS (SELECT user_id AS query, CAST(min(event_id) * 200 AS BIGINT) AS s, CAST(min(event_id) * 200 + 2000 AS BIGINT) AS e FROM events GROUP BY user_id)
        SELECT query, count(*) FILTER (start <= s + 20 AND "end" >= e - 20) AS full_hits,
        count(*) FILTER (start <= s + greatest(20, 0.15 * (e - s)) AND "end" >= e - greatest(20, 0.15 * (e - s))) AS partial_hits
        FROM bound LEFT JOIN hits USING (query) GROUP BY query"""
)
def spanning_hits(spark, sf_dir):
    bound = V.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query")).agg((F.min("event_id") * 200).alias("start"))
    return I.spanning_counts(V.hits(spark, sf_dir).select("query", "start", "end"), bound.withColumn("end", F.col("start") + 2000))


@query(
    f"""WITH {V.HITS}, r AS (SELECT chrom, "end" - start AS n, row_number() OVER (PARTITION BY chrom ORDER BY "end" - start DESC, hit_id) AS k FROM hits)
        SELECT chrom, avg(n) AS mean_length FROM r WHERE k BETWEEN 3 AND 40 GROUP BY chrom"""
)
def average_length_of_ranks(spark, sf_dir):
    return I.average_length(V.hits(spark, sf_dir), ["chrom"], 3, 40, ["hit_id"])


@query(
    f"""WITH {V.HITS}, {_POS}, c AS (SELECT query, quantile_cont(depth, 0.95) AS cut FROM pos GROUP BY query),
        l AS (SELECT query, pos, pos - row_number() OVER (PARTITION BY query ORDER BY pos) AS run FROM pos JOIN c USING (query) WHERE depth < cut)
        SELECT query, min(pos) AS start, max(pos) + 1 AS "end" FROM l GROUP BY query, run"""
)
def low_coverage_runs(spark, sf_dir):
    return I.low_coverage_runs(positions(spark, sf_dir), quantile=0.95)


@query(f"WITH {V.HITS} SELECT chrom AS type, CAST(sum(\"end\" - start) AS BIGINT) AS bases FROM hits WHERE start < \"end\" GROUP BY chrom")
def bases_per_class(spark, sf_dir):
    return V.hits(spark, sf_dir).where("start < end").groupBy(F.col("chrom").alias("type")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query(
    f"""WITH {V.M8} SELECT sseqid AS chrom, least(sstart, send) AS start, greatest(sstart, send) AS "end",
        CAST(row_number() OVER (PARTITION BY qseqid ORDER BY ordinal, qstart, length, pident, evalue) AS INTEGER) AS hit_id, pident, CASE WHEN contains(sstrand, 'plus') THEN '+' ELSE '-' END AS strand,
        length AS alnlen, qseqid AS query, qstart, qend FROM m8 WHERE length > 150"""
)
def bed_from_hits(spark, sf_dir):
    return H.to_bed(H.longer_than(V.m8(spark, sf_dir)), order=["ordinal", "qstart", "length", "pident", "evalue"])


_FULL = """full_counts AS (SELECT query, count(length) AS hits, count(*) FILTER (pident > 92 AND length / query_length >= 0.9 AND length > 100) AS full_hits
    FROM query_len LEFT JOIN m8 ON qseqid = query GROUP BY query)"""


def _counts(spark, sf_dir):
    return H.full_length_counts(V.m8(spark, sf_dir), V.query_lengths(spark, sf_dir), identity=92)


@query(f"WITH {V.M8}, {V.QUERY_LEN}, {_FULL} SELECT * FROM full_counts")
def full_length_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


_TERMINAL = "CASE query % 3 WHEN 0 THEN 'LTR' WHEN 1 THEN 'TIR' ELSE 'False' END"


@query(
    f"""WITH {V.M8}, {V.QUERY_LEN}, {_FULL} SELECT query, full_hits >= 1 AND ((query % 3 = 0 AND full_hits >= 2) OR query % 3 = 1) AS low_copy FROM full_counts"""
)
def low_copy_flag(spark, sf_dir):
    terminal = F.when(F.col("query") % 3 == 0, "LTR").when(F.col("query") % 3 == 1, "TIR").otherwise("False")
    return _counts(spark, sf_dir).select("query", H.low_copy(F.col("full_hits"), terminal).alias("low_copy"))


@query(
    f"""WITH {V.M8}, {V.QUERY_LEN} SELECT query, CASE WHEN abs(qstart - qend) >= 0.9 * query_length THEN 'full' WHEN abs(qstart - qend) >= 0.5 * query_length THEN 'half' ELSE 'grey' END AS bucket,
        count(*) AS n, round(avg(100 - pident), 6) AS divergence FROM m8 JOIN query_len ON qseqid = query GROUP BY ALL"""
)
def hit_buckets(spark, sf_dir):
    met = V.m8(spark, sf_dir).withColumnRenamed("qseqid", "query").join(V.query_lengths(spark, sf_dir), "query")
    return met.groupBy("query", H.hit_bucket(F.col("query_length")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(H.divergence()), 6).alias("divergence"))


@query(
    f"""WITH {V.M8}, {V.QUERY_LEN}, s AS (SELECT qseqid AS query, qstart, qend, CASE WHEN ordinal % 2 = 0 THEN sstart ELSE send END AS sstart,
        CASE WHEN ordinal % 2 = 0 THEN send ELSE sstart END AS send, ordinal FROM m8),
        k AS (SELECT query, qstart AS start, ordinal, CASE WHEN qstart <> sstart AND qend <> send AND send > sstart AND qend - qstart >= 150 AND sstart > qstart THEN 'LTR'
        WHEN qstart <> sstart AND qend <> send AND send < sstart AND qend - qstart >= 50 AND send > qstart THEN 'TIR' END AS kind, CASE WHEN send > sstart THEN send ELSE sstart END AS "end" FROM s),
        b AS (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY start - "end", ordinal) AS r FROM k WHERE kind IS NOT NULL),
        c AS (SELECT *, max(CAST(kind = 'LTR' AS INTEGER)) OVER (PARTITION BY query) AS direct FROM b WHERE r = 1),
        d AS (SELECT q.query, kind, start, "end", "end" - start >= q.query_length * 100 - CASE WHEN kind = 'LTR' THEN 3000 ELSE 2000 END AS holds
        FROM query_len q LEFT JOIN (SELECT * FROM c WHERE kind = 'LTR' OR direct = 0) c ON c.query = q.query)
        SELECT query, CASE WHEN holds THEN kind ELSE 'False' END AS terminal, CASE WHEN holds THEN start - 1 END AS start, CASE WHEN holds THEN "end" END AS "end" FROM d"""
)
def terminal_repeats(spark, sf_dir):
    flip = F.col("ordinal") % 2 == 0
    hits = V.m8(spark, sf_dir).select(F.col("qseqid").alias("query"), "qstart", "qend", F.when(flip, F.col("sstart")).otherwise(F.col("send")).alias("sstart"), F.when(flip, F.col("send")).otherwise(F.col("sstart")).alias("send"), "ordinal")
    sizes = V.query_lengths(spark, sf_dir).select("query", (F.col("query_length") * 100).alias("length"))
    return H.terminal_repeat(hits, sizes)

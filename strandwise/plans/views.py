"""Deterministic domain views of the driver's tables, as DataFrames and as SQL for the oracle.

hits: events as intervals; tracks: two annotation tracks; m8: line items as search hits; rm: repeat annotations;
msa: embeddings as alignments of 64 columns; graded: orders as graded consensus sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.expr(EPOCH)
    return e.select(
        F.col("event_type").alias("chrom"), start.alias("start"), (start + 1 + F.floor(F.col("value") * 60)).alias("end"),
        F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("user_id").alias("query"), F.col("event_id").alias("hit_id"),
        (70 + F.col("event_id") % 31).cast("double").alias("pident"),
    )


HITS = """hits AS (SELECT event_type AS chrom, s AS start, s + 1 + CAST(floor(value * 60) AS BIGINT) AS "end",
    CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END AS strand, user_id AS query, event_id AS hit_id, CAST(70 + event_id % 31 AS DOUBLE) AS pident
    FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS s FROM events))"""


def chrom_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).groupBy("chrom").agg((F.max("end") + 1000).alias("length"))


CHROM_LEN = """chrom_len AS (SELECT chrom, max("end") + 1000 AS length FROM hits GROUP BY chrom)"""


def tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = hits(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("query") % 3).cast("string")).alias("chrom"), "start", "end", F.col("chrom").alias("type"), "query")
    return h.where("query % 2 = 0").drop("query"), h.where("query % 2 = 1").drop("query")


TRACKS = """tracks AS (SELECT 'u' || CAST(query % 3 AS VARCHAR) AS chrom, start, "end", chrom AS type, query % 2 AS side FROM hits)"""


def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    return li.select(
        F.col("l_partkey").alias("qseqid"), F.col("l_returnflag").alias("sseqid"), (100 - 100 * F.col("l_discount")).alias("pident"), (q * 10).alias("length"),
        F.col("l_suppkey").alias("qstart"), (F.col("l_suppkey") + q * 10 - 1).alias("qend"), F.col("l_orderkey").alias("sstart"), (F.col("l_orderkey") + q * 10 - 1).alias("send"),
        F.when(F.col("l_linestatus") == "O", "plus").otherwise("minus").alias("sstrand"), F.col("l_tax").alias("evalue"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
    )


M8 = """m8 AS (SELECT l_partkey AS qseqid, l_returnflag AS sseqid, 100 - 100 * l_discount AS pident, q * 10 AS length, l_suppkey AS qstart,
    l_suppkey + q * 10 - 1 AS qend, l_orderkey AS sstart, l_orderkey + q * 10 - 1 AS send, CASE WHEN l_linestatus = 'O' THEN 'plus' ELSE 'minus' END AS sstrand,
    l_tax AS evalue, l_orderkey * 8 + l_linenumber AS ordinal FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem))"""


def query_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), (200 + F.col("p_size") * 5).cast("long").alias("query_length"))


QUERY_LEN = "query_len AS (SELECT p_partkey AS query, CAST(200 + p_size * 5 AS BIGINT) AS query_length FROM part)"


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msa_id, seq_id, seq): one letter a component; small values are gaps."""
    base = lambda x: F.when(F.abs(x) < 0.02, "-").when(x < -0.1, "a").when(x < 0, "c").when(x < 0.1, "g").otherwise("t")
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("msa_id"), F.col("vec_id").alias("seq_id"), F.array_join(F.transform("embedding", lambda x: base(x.cast("double"))), "").alias("seq"))


MSA = """cells AS (SELECT label AS msa_id, vec_id AS seq_id, CAST(i - 1 AS INTEGER) AS col,
    CASE WHEN abs(x) < 0.02 THEN '-' WHEN x < -0.1 THEN 'a' WHEN x < 0 THEN 'c' WHEN x < 0.1 THEN 'g' ELSE 't' END AS base
    FROM (SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS u(i)))"""

COLS = """cols AS (SELECT msa_id, col, count(*) AS n, count(*) FILTER (base = 'a') AS a, count(*) FILTER (base = 'c') AS c,
    count(*) FILTER (base = 'g') AS g, count(*) FILTER (base = 't') AS t, count(*) FILTER (base = '-') AS gaps FROM cells GROUP BY msa_id, col)"""


def rm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat annotations: order keys as queries, part types as families."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    q = F.col("l_quantity").cast("long")
    family = F.when(F.col("p_type").isin("STANDARD", "LARGE"), F.concat(F.lit("LTR/"), "p_type")).when(F.col("p_type") == "SMALL", "Unknown").otherwise(F.concat(F.lit("DNA/"), "p_type"))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("repeat"), family.alias("class"), (F.col("l_discount") * 100).alias("perc_div"), (F.col("l_tax") * 100).alias("perc_del"),
        F.col("l_linenumber").cast("double").alias("perc_ins"), (F.col("l_suppkey") * 10).alias("query_start"), (F.col("l_suppkey") * 10 + q * 4).alias("query_end"), (q % 7 * 20).alias("query_left"),
    )


RM = """rm AS (SELECT l_orderkey AS query, l_partkey AS repeat, CASE WHEN p_type IN ('STANDARD', 'LARGE') THEN 'LTR/' || p_type
    WHEN p_type = 'SMALL' THEN 'Unknown' ELSE 'DNA/' || p_type END AS class, l_discount * 100 AS perc_div, l_tax * 100 AS perc_del,
    CAST(l_linenumber AS DOUBLE) AS perc_ins, l_suppkey * 10 AS query_start, l_suppkey * 10 + CAST(l_quantity AS BIGINT) * 4 AS query_end,
    CAST(l_quantity AS BIGINT) % 7 * 20 AS query_left FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    grade = {"1-URGENT": "Perfect", "2-HIGH": "Good", "3-MEDIUM": "Reco_check", "4-NOT SPECIFIED": "Need_check", "5-LOW": "Need_ext"}
    level = F.create_map(*(F.lit(x) for kv in grade.items() for x in kv))[F.col("o_orderpriority")]
    return o.select(
        F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("name"), level.alias("evaluation"), F.floor("o_totalprice").alias("length"),
        F.when(F.col("o_orderstatus") == "F", "Unknown").otherwise(F.concat(F.lit("LTR/"), "o_orderstatus")).alias("te_class"), (F.col("o_orderkey") % 5 == 0).alias("low_copy"),
    )


GRADED = """graded AS (SELECT o_custkey AS cluster, o_orderkey AS name, CASE o_orderpriority WHEN '1-URGENT' THEN 'Perfect' WHEN '2-HIGH' THEN 'Good'
    WHEN '3-MEDIUM' THEN 'Reco_check' WHEN '4-NOT SPECIFIED' THEN 'Need_check' ELSE 'Need_ext' END AS evaluation, CAST(floor(o_totalprice) AS BIGINT) AS length,
    CASE WHEN o_orderstatus = 'F' THEN 'Unknown' ELSE 'LTR/' || o_orderstatus END AS te_class, o_orderkey % 5 = 0 AS low_copy FROM orders)"""


def _letters(key: Column, n: int) -> Column:
    """``n`` letters that a key stands for."""
    digests = [F.sha2(F.concat_ws("/", key.cast("string"), F.lit(str(i))), 256) for i in range(-(-n // 64))]
    return F.substring(F.translate(F.concat(*digests), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, n)


#: Letters of a planted element, of the flanks of its copies, and of a copy: five lost, seven gained.
ELEMENT, FLANK, COPY = 320, 300, 322


def element(key: Column) -> Column:
    """The letters of a planted element."""
    return _letters(F.concat(F.lit("e"), key.cast("string")), ELEMENT)


def planted_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seq): an element for each supplier."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.cast("long").alias("name"), element(key).alias("seq"))


def planted_copies(spark: SparkSession, sf_dir: str, rate: int = 2, foreign: int = 0, by: str = "name") -> DataFrame:
    """(copy, name, chrom, start, end, strand, seq): a copy for each part, of an element that supplies it: ``rate`` of 16
    letters changed, five letters lost and seven gained; every third copy is on the minus strand, and the first 110
    letters of each ``foreign``-th are not the element's.  ``start`` and ``end`` are its place in the genome, ``seq`` is
    that of the plus strand with its flanks.  Rows are dealt by the column ``by``, before they have letters."""
    part = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("copy")).agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber")).cast("long").alias("name"))
    part = part.join(planted_elements(spark, sf_dir).select("name"), "name").withColumn("chrom", F.concat(F.lit("chr"), F.floor((F.col("copy") - 1) / 50).cast("string")))
    # rows are few bytes here and long sequences later, so tasks are not fitted to their size
    rows = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by).withColumn("seq", element(F.col("name")))
    key = F.concat(F.lit("c"), F.col("copy").cast("string"))
    digits = F.split(F.concat(*(F.sha2(F.concat_ws("/", key, F.lit(f"m{i}")), 256) for i in range(-(-ELEMENT // 64)))), "")
    changed = F.zip_with(F.split("seq", ""), F.slice(digits, 1, ELEMENT), lambda x, d: F.when(d.isin(*[f"{v:x}" for v in range(rate)]), F.translate(x, "ACGT", "CGTA")).otherwise(x))
    rows = rows.withColumn("seq", F.array_join(changed, ""))
    lost, gained = 60 + F.col("copy") % 100, 200 + F.col("copy") % 80
    body = F.concat(
        F.substring("seq", F.lit(1), lost.cast("int")), F.substring("seq", (lost + 6).cast("int"), (gained - lost - 5).cast("int")), _letters(F.concat(key, F.lit("g")), 7),
        F.substring("seq", (gained + 1).cast("int"), F.lit(ELEMENT)),
    )
    if foreign:
        body = F.when(F.col("copy") % foreign == 0, F.concat(_letters(F.concat(key, F.lit("f")), 110), F.substring(body, 111, ELEMENT))).otherwise(body)
    minus = F.col("copy") % 3 == 0
    body = F.when(minus, F.reverse(F.translate(body, "ACGT", "TGCA"))).otherwise(body)
    slot, block = (F.col("copy") - 1) % 50, COPY + 2 * FLANK
    return rows.select(
        "copy", "name", "chrom", (slot * block + FLANK).alias("start"), (slot * block + FLANK + COPY).alias("end"),
        F.when(minus, "-").otherwise("+").alias("strand"), F.concat(_letters(F.concat(key, F.lit("l")), FLANK), body, _letters(F.concat(key, F.lit("r")), FLANK)).alias("seq"),
    )


def planted_genome(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """(chrom, seq): the copies with their flanks, fifty to a chromosome; the place of an absent one is N."""
    rows = planted_copies(spark, sf_dir, by="chrom", **options).select("chrom", F.floor(F.col("start") / (COPY + 2 * FLANK)).cast("int").alias("slot"), "seq")
    held = rows.groupBy("chrom").agg(F.map_from_entries(F.collect_list(F.struct("slot", "seq"))).alias("m"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("N" * (COPY + 2 * FLANK))))
    return held.select("chrom", F.array_join(blocks, "").alias("seq"))

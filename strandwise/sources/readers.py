"""Scans of the text formats of the field.  All are Spark text or CSV scans: compressed files and any Hadoop file
system work, columns are typed by explicit schemas, and nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import header_class, header_name, plain_int, plain_strand, unique_names
from ..operators.scratch import dealt

# The column layouts of the formats.
HITS = (
    "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, "
    "sstrand string, evalue double, qcovhsp long"
)
HITS_BITSCORE = HITS.replace("qcovhsp long", "bitscore double")
HIT_BED = "chrom string, start long, end long, hit_id long, pident double, strand string, alnlen long, query string, qstart long, qend long"
BED = "chrom string, start long, end long, name string, score string, strand string"
LENGTHS = "chrom string, length long"
ORFS = "TE_name string, orf_start long, orf_end long, direction string, orf_name string"
DOMAINS = ORFS + ", domain_start long, domain_end long, domain_name string, domain_reference string"
REPEATS = (
    "score", "perc_div", "perc_del", "perc_ins", "query_name", "query_start", "query_end", "query_left", "strand", "repeat_name", "repeat_class",
    "repeat_start", "repeat_end", "repeat_left", "id",
)
SUMMARY = (
    "input_name string, output_name string, input_TE_type string, output_TE_type string, status string, input_blast_n long, input_full_blast_n long, "
    "output_blast_n long, output_full_blast_n long, input_genome_cov_len long, output_genome_cov_len long, output_MSA_seq_n long, input_length long, "
    "output_length long, raw_start long, raw_end long, in_out_identify double, input_coverage double, output_coverage double, input_terminal_repeat string, "
    "output_terminal_repeat string, TSD string, start_pattern string, end_pattern string, database_hit string, low_copy boolean, evaluation string, "
    "cluster string, cluster_identity string"
)


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Records between separators with their file and an ordinal that follows the file's order."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("ordinal"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq, file, ordinal) of multi-record FASTA; wrapped lines are joined, blank records skipped."""
    text = F.regexp_replace(F.col("value"), r"^>", "")
    rows = _records(spark, path, "\n>").select(text.alias("t"), "file", "ordinal").where(F.trim("t") != "")
    head = F.rtrim(F.regexp_extract("t", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("t", r"^[^\n]*\n?", ""), r"[\s>]", "")
    return rows.select(head.alias("header"), body.alias("seq"), "file", "ordinal")


def library(spark: SparkSession, path: str) -> DataFrame:
    """(name, te_class, description, seq, ordinal) of a sequence library: names sanitised, later copies of a name
    numbered."""
    rows = fasta(spark, path).select(
        header_name(F.col("header")).alias("name"), header_class(F.col("header")).alias("te_class"),
        F.regexp_extract("header", r"^\S+\s+(.*)$", 1).alias("description"), "seq", "ordinal",
    )
    return unique_names(rows, "name", "ordinal")


def first_by_name(records: DataFrame) -> DataFrame:
    """Records keyed by the part of the header in front of #; of equal keys the last record stays."""
    key = F.split_part(F.col("header"), F.lit("#"), F.lit(1))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.col("ordinal").desc()))
    return records.withColumn("key", key).withColumn("_n", last).where("_n = 1").drop("_n")


def genome(spark: SparkSession, path: str, sanitise: bool = True) -> DataFrame:
    """(chrom, seq, ordinal): upper case, anything but ACGT as N."""
    rows = fasta(spark, path).select(F.regexp_extract("header", r"^(\S*)", 1).alias("chrom"), F.upper("seq").alias("seq"), "ordinal")
    return rows.withColumn("seq", F.regexp_replace("seq", "[^ACGT]", "N")) if sanitise else rows


def lengths_of(sequences: DataFrame) -> DataFrame:
    return sequences.select("chrom", F.length("seq").cast("long").alias("length"))


def lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=LENGTHS)


def hits(spark: SparkSession, path: str, schema: str = HITS) -> DataFrame:
    """Tabular hits, tab-separated, without header."""
    return spark.read.csv(path, sep="\t", schema=schema)


def hits_by_blanks(spark: SparkSession, path: str, schema: str = HITS) -> DataFrame:
    """The variant with a header row and any blanks between columns."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.get("p", F.lit(0)) != "qseqid")
    fields = [f.split() for f in schema.split(", ")]
    return parts.where(F.size("p") >= len(fields)).select(*(F.get("p", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)))


def hit_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=HIT_BED)


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Six columns; shorter lines are skipped."""
    parts = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 6)
    fields = [f.split() for f in BED.split(", ")]
    return parts.select(*(F.get("p", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)))


def repeats(spark: SparkSession, path: str) -> DataFrame:
    """Repeat annotation tables: three header lines, fifteen columns between blanks; lines that do not fit are skipped.
    Header lines are told by their first word, which is no number, so files can be split."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 14)
    parts = parts.where(F.get("p", F.lit(0)).rlike(r"^[0-9]+$"))
    text = {n: F.get("p", F.lit(i)) for i, n in enumerate(REPEATS)}
    kinds = dict.fromkeys(("score", "query_start", "query_end"), "bigint") | dict.fromkeys(("perc_div", "perc_del", "perc_ins"), "double")
    out = []
    for n in REPEATS:
        c = text[n].try_cast(kinds[n]) if n in kinds else plain_int(text[n]) if n in ("query_left", "repeat_start", "repeat_end", "repeat_left") else text[n]
        out.append((plain_strand(c) if n == "strand" else c).alias(n))
    return parts.select(*out)


def track(annotation: DataFrame, category: Column) -> DataFrame:
    """(chrom, start, end, type, length, strand) of the rows whose start is before their end."""
    rows = annotation.where(F.col("query_start") < F.col("query_end"))
    return rows.select(
        F.col("query_name").alias("chrom"), F.col("query_start").alias("start"), F.col("query_end").alias("end"), category.alias("type"),
        (F.col("query_end") - F.col("query_start")).alias("length"), "strand",
    )


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, length, name, identity, direction) of cluster files: ``... *`` marks the representative (standard, +),
    ``... at a:b:c:d/+/pct%`` others; what fits neither has nulls."""
    rows = spark.read.option("lineSep", "\n>Cluster ").text(path).select(F.regexp_replace("value", r"^>Cluster ", "").alias("v"))
    members = rows.select(F.regexp_extract("v", r"^(\d+)", 1).alias("k"), F.explode(F.split("v", "\n")).alias("line")).where(F.col("line").contains(">"))
    at = r"\.\.\. at (?:[\d:]+/)?([+-])/([\d.]+%)"
    head = F.col("line").rlike(r"\.\.\. \*")
    return members.select(
        F.concat(F.lit("Cluster"), "k").alias("cluster"), F.regexp_extract("line", r"\t(\d+)nt", 1).try_cast("bigint").alias("length"),
        F.split_part(F.regexp_extract("line", r">(.*?)\.\.\.", 1), F.lit("#"), F.lit(1)).alias("name"),
        F.when(head, "standard").when(F.col("line").rlike(at), F.regexp_extract("line", at, 2)).alias("identity"),
        F.when(head, "+").when(F.col("line").rlike(at), F.regexp_extract("line", at, 1)).alias("direction"),
    )


def alignment(spark: SparkSession, path: str, msa_id: str | None = None) -> DataFrame:
    """(msa_id, seq_id, seq_ord, seq) of aligned FASTA, one alignment a file; letters other than ACGTN are gaps."""
    rows = fasta(spark, path)
    name = F.lit(msa_id) if msa_id else F.element_at(F.split("file", "/"), -1)
    seq = F.regexp_replace(F.upper("seq"), "[^AGCTN-]", "-")
    return rows.select(name.alias("msa_id"), F.regexp_extract("header", r"^(\S*)", 1).alias("seq_id"), F.row_number().over(Window.partitionBy("file").orderBy("ordinal")).alias("seq_ord"), seq.alias("seq"))


def tree_distances(spark: SparkSession, newick: str) -> DataFrame:
    """(a, b, d): distances between the leaves of one Newick tree.  A tree of one alignment is small: it is parsed where
    it is given, and pairs come from a join of root paths."""
    parent, names, length, stack, at, current = {}, {}, {}, [], 0, 0
    count = 1
    text = newick.strip().rstrip(";")
    while at < len(text):
        c = text[at]
        if c in "(,":
            if c == "(":
                stack.append(current)
            parent[count], current = stack[-1], count
            count += 1
            at += 1
        elif c == ")":
            current = stack.pop()
            at += 1
        else:
            end = at
            while end < len(text) and text[end] not in "(),":
                end += 1
            label, _, size = text[at:end].partition(":")
            names[current], length[current] = label.strip(), float(size or 0)
            at = end
    inner = set(parent.values())
    paths = []
    for leaf in (n for n in parent if n not in inner):
        node, far = leaf, 0.0
        while True:
            paths.append((names.get(leaf, ""), node, far))
            if node not in parent:
                break
            far += length.get(node, 0.0)
            node = parent[node]
    up = spark.createDataFrame(paths or [("", 0, 0.0)], "leaf string, node long, far double").where(F.lit(bool(paths)))
    a, b = (up.select("node", F.col("leaf").alias(n), F.col("far").alias(f"f{n}")) for n in "ab")
    return a.join(b, "node").where("a < b").groupBy("a", "b").agg(F.min(F.col("fa") + F.col("fb")).alias("d"))


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated with a header; whole rows that repeat are dropped, by tasks whose number follows the rows."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return dealt(rows, rows.columns).distinct()


def summary(spark: SparkSession, path: str, keep_text: bool = False) -> DataFrame:
    """The run summary; the text NaN is null, or stays if ``keep_text``, all columns then being text."""
    if keep_text:
        return spark.read.csv(path, header=True)
    return spark.read.csv(path, header=True, schema=SUMMARY, nullValue="NaN")


def headers_to_bed(headers: DataFrame) -> DataFrame:
    """Distinct six-column intervals from headers chrom:start-end(strand); the chromosome may hold colons."""
    p = r"^(.*):(\d+)-(\d+)\(([+-])\)"
    part = lambda k: F.regexp_extract("header", p, k)
    rows = headers.where(F.col("header").rlike(p))
    return rows.select(part(1).alias("chrom"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"), F.lit(".").alias("name"), F.lit("0").alias("score"), part(4).alias("strand")).distinct()


def kmer_index(sequences: DataFrame, k: int = 11) -> DataFrame:
    """(gram, chrom, pos): what stands in for a search tool's index files."""
    grams = F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substring(F.col("seq"), i, F.lit(k)))
    return sequences.where(F.length("seq") >= k).select("chrom", F.posexplode(grams).alias("pos", "gram"))

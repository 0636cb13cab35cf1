"""Sinks: every one is a single atomic Spark write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_fasta(rows: DataFrame, path: str, header: Column | None = None, wrap: int | None = None) -> None:
    """FASTA text of (name, te_class, seq): headers name#class, sequences on one line or wrapped."""
    head = F.concat_ws("#", "name", "te_class") if header is None else header
    seq = F.rtrim(F.regexp_replace("seq", f"(.{{{wrap}}})", "$1\n")) if wrap else F.col("seq")
    rows.select(F.concat(F.lit(">"), head, F.lit("\n"), seq).alias("value")).write.mode("overwrite").text(path)


def library_header(tag: str, level: Column) -> Column:
    """name#class, a tool's tag and the level, between tabs."""
    return F.concat_ws("\t", F.concat_ws("#", "name", "te_class"), F.lit(tag), level)


def to_tsv(rows: DataFrame, path: str, header: bool = False) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=header)


def to_summary(rows: DataFrame, path: str) -> None:
    """The run summary as CSV with the text NaN for what is missing."""
    rows.write.mode("overwrite").csv(path, header=True, nullValue="NaN")


def to_folders(rows: DataFrame, path: str, by: str = "evaluation") -> None:
    """Parquet partitioned by grade: the curation folders."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def coverage_struct() -> Column:
    """struct(start, end, coverage) for each alignment, from (start, end) and cells (pos, depth)."""
    depth = F.array_sort(F.collect_list(F.struct("pos", "depth")))
    return F.struct(F.first("start").alias("start"), F.first("end").alias("end"), F.transform(depth, lambda x: x["depth"]).alias("coverage"))


def name_map(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.select(F.col(old).alias("original"), F.col(new).alias("name"))

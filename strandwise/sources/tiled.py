"""FASTA whose records span file splits: a chromosome is read by many tasks, into tiles of one size.

Lines are the unit of a split.  A kernel walks through a split's lines and sends pieces of sequence with the number of
the header that they follow in the split; 0 is what belongs to the last record of an earlier split.  How many headers
and letters earlier splits hold, a row each split and record, turns that into places.  Pieces are then cut at the tiles'
bounds and joined, at most a tile in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scratch import written

_PIECES = "file string, block long, local long, header string, at long, piece string"
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("header", pa.string()), ("at", pa.int64()), ("piece", pa.string())])
_BLANKS = str.maketrans("", "", " \t\r\v\f")


def _walk(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(value, file, block) lines in order to pieces of at least ``size`` letters, but for the last of a record."""
    place, local, at, held, letters, out = None, 0, 0, [], 0, []

    def send(header: str | None = None) -> None:
        nonlocal at, held, letters
        if letters or header is not None:
            out.append((*place, local, header, at, "".join(held)))
        at, held, letters = at + letters, [], 0

    for batch in batches:
        for value, file, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != place:
                if place is not None:
                    send()
                place, local, at = (file, block), 0, 0
            if value.startswith(">"):
                send()
                local, at = local + 1, 0
                send(value[1:].rstrip())
                continue
            line = value.translate(_BLANKS)
            held.append(line)
            letters += len(line)
            if letters >= size:
                send()
        if len(out) > 64:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)
            out.clear()
    if place is not None:
        send()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def fasta_tiles(spark: SparkSession, path: str, tile: int = 1 << 16) -> DataFrame:
    """(file, record, header, length, tile, first, part) of multi-record FASTA: ``part`` is the record's letters from
    ``first`` on, ``tile`` of them but for the last; ``record`` counts from 0 in a file.

    A record without letters has one row with an empty part.  Letters before a file's first header are no record.  A
    line is read by one task, so sequences must be wrapped to be split; compressed files are one split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = written(lines.mapInArrow(lambda batches: _walk(batches, tile), _PIECES))
    splits = pieces.groupBy("file", "block").agg(F.max("local").alias("headers"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("_before"))
    # what a split holds of a record; a record has as many rows as splits that it spans
    held = pieces.groupBy("file", "block", "local").agg(F.sum(F.length("piece")).alias("letters"), F.max("header").alias("header"))
    held = held.join(splits, ["file", "block"]).withColumn("record", F.col("_before") + F.col("local") - 1).where("record >= 0")
    record, earlier = Window.partitionBy("file", "record"), Window.partitionBy("file", "record").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = written(held.select(
        "file", "block", "local", "record", F.coalesce(F.sum("letters").over(earlier), F.lit(0)).alias("_so_far"), F.sum("letters").over(record).alias("length"), F.max("header").over(record).alias("header"),
    ))
    placed = pieces.where("length(piece) > 0").select("file", "block", "local", "at", "piece").join(held, ["file", "block", "local"]).withColumn("at", F.col("at") + F.col("_so_far"))
    last = F.col("at") + F.length("piece") - 1
    cut = placed.withColumn("tile", F.explode(F.sequence(F.floor(F.col("at") / tile), F.floor(last / tile))))
    low = F.greatest(F.lit(0), F.col("tile") * tile - F.col("at"))
    high = F.least(F.length("piece"), (F.col("tile") + 1) * tile - F.col("at"))
    cut = cut.select("file", "record", "header", "length", "tile", (F.col("at") + low).alias("_at"), F.substring("piece", (low + 1).cast("int"), (high - low).cast("int")).alias("_piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda x: x["_piece"]), "")
    tiles = cut.groupBy("file", "record", "header", "length", "tile").agg(whole.alias("part"))
    zero = F.lit(0).cast("long")
    empty = held.where("length = 0").select("file", "record", "header", "length", zero.alias("tile"), zero.alias("first"), F.lit("").alias("part")).distinct()
    return tiles.select("file", "record", "header", "length", "tile", (F.col("tile") * tile).alias("first"), "part").unionByName(empty)


def genome_tiles(spark: SparkSession, path: str, tile: int = 1 << 16) -> DataFrame:
    """(chrom, length, tile, first, part): upper case, anything but ACGT as N; names are headers up to a blank."""
    rows = fasta_tiles(spark, path, tile)
    return rows.select(F.regexp_extract("header", r"^(\S*)", 1).alias("chrom"), "length", "tile", "first", F.regexp_replace(F.upper("part"), "[^ACGT]", "N").alias("part"))

"""Shared plumbing: tables, lineage cuts in the shared folder, and word splitting."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir (tests, notebooks on one machine).
FALLBACK_DIR = "file:///tmp/checkpoints"

#: Spark's setting that deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Settings for tables of few large binary rows that are compressed already: small Arrow batches, no codec.
BLOBS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64", "spark.sql.parquet.compression.codec": "uncompressed"}

#: What separates words: the characters \x20 and \x09-\x0D, which are those of bytes.split().
SPACE = "[\\x20\\x09-\\x0D]"
_SPACE_BYTES = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables inside the shared one; :func:`clean_up` deletes it."""
    return f"{shared_dir(spark)}/strandwise-{spark.sparkContext.applicationId}"


_SCOPES: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_SCOPES[-1] if _SCOPES else run_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end, but for those with ``keep``."""
    _SCOPES.append(f"{run_dir(spark)}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, _SCOPES.pop())


def materialize(df: DataFrame, label: str, settings: dict[str, str] | None = None, keep: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet into the shared folder and read it back.

    A lost executor costs a later stage no more than a reread, as all executors see the folder.  The shuffle files of
    the write are deleted when it ends.  ``settings`` hold during the write; ``keep`` puts the table outside any scope.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}" if keep else scratch_path(spark, label)
    wanted = {CLEANUP: "true", "spark.sql.parquet.compression.codec": "zstd"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind materialized tables that no later plan reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/strandwise-" in path:
                _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder; results that are not written
    elsewhere can't be read afterwards."""
    _delete(spark, run_dir(spark))


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], spread: Column, bound: int, salts: int = 16) -> DataFrame:
    """``rows`` left-joined with ``few``, which has one row a key: broadcast if it has at most ``bound`` rows, else both
    are dealt in ``salts`` shares by ``spread``, so a key that a third of all rows have is not one task.  ``few`` is
    counted first and should be cheap to read again."""
    if few.count() <= bound:
        return rows.join(F.broadcast(few), keys, "left")
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def row_key() -> Column:
    """A hash of a row's id and text: what tells rows apart whose id is null or repeated."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    while name in df.columns:
        name += "_"
    return name


def keep_first(docs: DataFrame, members: DataFrame, bound: int = 1 << 20) -> DataFrame:
    """One row of ``docs`` for each root of ``members`` (doc_id, key, root; one row a row of docs): that with the
    smallest doc_id (null ids last), and of rows that repeat both id and text any one.

    Only the keys of rows that go are joined with docs, broadcast up to ``bound``, so texts are not shuffled.
    """
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("key"))
    groups = members.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("root", F.col("first.key").alias("kept")), "groups")
    placed = join_few(members, groups, ["root"], F.col("key"), bound).where(F.col("kept").isNotNull())
    # a kept key that occurs again is that of a repeated row
    marks = placed.groupBy("key", "kept").agg(F.count("*").alias("n")).select("key", (F.col("key") != F.col("kept")).alias("_goes"), "n")
    key_name, goes_name = free_name(docs, "_key"), free_name(docs, "_goes")
    goes = F.col(goes_name)
    marks = materialize(marks.where(F.col("_goes") | (F.col("n") > 1)).select(F.col("key").alias(key_name), F.col("_goes").alias(goes_name)), "marks")
    hint = F.broadcast if marks.count() <= bound else (lambda df: df)
    met = docs.withColumn(key_name, row_key()).join(hint(marks), key_name, "left")
    once = met.where(goes.isNull()).select(*docs.columns)
    if marks.where(~goes).isEmpty():
        return once
    return once.unionByName(met.where(~goes).dropDuplicates([key_name]).select(*docs.columns))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """The words of a text, in order; an empty array for null, empty and blank texts."""
    return F.array_remove(F.split(lower_ascii(text), SPACE + "+"), "")


def word_chunks(data: bytes, step: int = 1 << 18) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words of a text in order, some ``step`` bytes at a time, so that a very long text
    never becomes one list of words."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + step)
        if end < n:
            cut = _SPACE_BYTES.search(data, end)
            end = cut.start() if cut else n
        yield data[at:end].lower().split()
        at = end


def running(values: Column, step: Callable[[Column, Column], Column], first: Column) -> Column:
    """The results of folding ``step`` over an array up to each of its values, from ``first``.

    A fold whose state is the array of results copies it for each value; here values are folded in some sqrt(n) pieces
    of some sqrt(n) values, so the copies of n values together are n^1.5.  ``step`` must be associative.
    """

    def scan(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))

    def pieces(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(xs), size), lambda i: F.slice(xs, i, size))

    def spread(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: F.aggregate(p, first, step)), first)
        each = F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: F.slice(scan(p, b), 2, F.size(p)))
        return F.flatten(each)

    once = lambda x, use: F.transform(F.array(x), use)[0]
    return F.when(F.size(values) == 0, values).otherwise(once(values, lambda xs: once(pieces(xs), spread)))

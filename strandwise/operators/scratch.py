"""Tables in the folder that the driver and all executors share, which cut lineage, and tasks whose number follows the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's tables; :func:`clean_up` deletes it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or 'file:///tmp/checkpoints').rstrip('/')}/strandwise-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A folder with a name of its own for each use."""
    return f"{run_folder(spark)}/core-{uuid.uuid4().hex}"


#: For tables that are read back: shuffle files go with the write, as no later plan reads them.
KEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
#: For tables of few large binary rows, besides: small Arrow batches and no codec.
BLOBS = KEPT | {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.parquet.compression.codec": "uncompressed"}


def written(df: DataFrame, blobs: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` once and read it back, so a lost executor costs no more than a reread.  The shuffle files
    of the write are deleted when it ends."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    wanted = BLOBS if blobs else KEPT
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of written tables that no later plan reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/strandwise-" in path:
                where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Rows that a task sorts or makes distinct.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as its rows need, so that a task's memory does not grow with the table.
    It is counted first, and should be cheap to read again."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // TASK_ROWS)), *keys)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder.  Results that are not written elsewhere
    can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

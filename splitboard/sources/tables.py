"""Reading the given tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a given table that a task sorts at a time: some 50 MB as they are, a few hundred when they have become lines of text.
ROWS_A_TASK = 200_000


def dealt(rows: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as counted (a table that only footers are read of) has portions, the session's number at least.

    What follows by these keys needs no other shuffle, and a task's memory does not grow with the table.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // ROWS_A_TASK))
    return rows.repartition(tasks, *keys)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, which the optimizer knows to be empty: joins and unions with it are planned away, and no Python runs for it."""
    return spark.range(1).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset (local tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: How tables are packed: texts, hashes and JSON take much less room than with Parquet's default, for little time.
PACKED = "zstd"


def stage(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    The written table survives lost executors, cuts the lineage and gives the
    planner true sizes. Each call writes a folder of its own; it is added to made, for ``discard``.
    """
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    if made is not None:
        made.append(path)
    df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Take staged tables away that nothing reads any more."""
    for path in made:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is written inside sends its Python functions at most so many rows at a time: whole texts are held as Arrow on both sides, and
    idle workers keep what they once took. The session's own setting is back afterwards; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def local_session(cpus: int | str = 8, memory: str = "8g", more: dict[str, str] | None = None) -> SparkSession:
    """Session for tests and the bench on one machine, with more settings."""
    return (
        SparkSession.builder.config(map=more or {})
        .master(f"local[{cpus}]")
        .appName("splitboard")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )

"""Document sets, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.sources.schemas import DISCOVERY, MANIFEST


def document_set(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """(filename, content, ord) of the files below a folder, ordered by name; archive leftovers are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(F.lower("path").endswith(suffix) & ~F.col("path").contains("__MACOSX"))
    return kept.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("path").alias("ord"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source_page, ord, url, filename, category, sha256, …) of manifest files; fields that an older kind lacks are null."""
    read = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    return read.select("source_page", F.posexplode("files").alias("ord", "file")).select("source_page", "ord", "file.*")


def report_header(rows: DataFrame, status: str, title: str) -> DataFrame:
    """One row: a title, the number of rows and the counts by status."""
    counts = rows.groupBy(status).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(status, "n")))
    return counts.agg(F.lit(title).alias("title"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(entries).alias("counts"))


def write_report(rows: DataFrame, status: str, title: str, path: str) -> None:
    """A report as JSON: its header in one file under header, its rows, a line each, under rows."""
    report_header(rows, status, title).coalesce(1).write.mode("overwrite").json(f"{path}/header")
    rows.write.mode("overwrite").json(f"{path}/rows")


def discovered_events(spark: SparkSession, path: str) -> DataFrame:
    """(ord, title, url, page_title, status, pdf_count, pdfs) of discovery files, one row per event."""
    read = spark.read.schema(DISCOVERY).option("multiLine", "true").json(path)
    return read.select(F.posexplode("events").alias("ord", "event")).select("ord", "event.*")

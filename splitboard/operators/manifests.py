"""Manifests: lists of archived files (ord, url, filename, category, sha256, saved) and how two of them differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitboard.functions.documents import importable

IDENTITY = ["url", "filename", "category"]


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def last_of(files: DataFrame, keys: list[str]) -> DataFrame:
    """The last file of each key; null keys are equal."""
    others = [c for c in files.columns if c not in (*keys, "ord")]
    return files.groupBy(*keys).agg(F.max(F.struct("ord", *others)).alias("l")).select(*keys, "l.*")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change_type, url, filename, category, old_category, old_sha256, new_sha256, importable).

    added and removed compare (url, filename, category); changed is another hash under one identity; category
    compares every new file with the last old one of its url and filename, and such a file is added and removed as well.
    Files without a hash do not count.
    """
    hashed = lambda df: df.where(F.col("sha256").isNotNull() & (F.col("sha256") != ""))
    old, new = hashed(old), hashed(new)
    a = last_of(old, IDENTITY).select(*[F.col(c).alias(f"o_{c}") for c in (*IDENTITY, "sha256")])
    b = last_of(new, IDENTITY).select(*IDENTITY, F.col("sha256").alias("new_sha256"))
    both = b.join(a, null_safe(b, a, [(c, f"o_{c}") for c in IDENTITY]), "full_outer")
    kind = F.when(F.col("o_sha256").isNull(), "added").when(F.col("new_sha256").isNull(), "removed").when(F.col("o_sha256") != F.col("new_sha256"), "changed")
    gone = F.col("new_sha256").isNull()
    shown = [F.when(gone, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in IDENTITY]
    compared = both.select(kind.alias("change_type"), *shown, F.lit(None).cast("string").alias("old_category"), F.col("o_sha256").alias("old_sha256"), "new_sha256").where("change_type IS NOT NULL")
    before = last_of(old, ["url", "filename"]).select(F.col("url").alias("o_url"), F.col("filename").alias("o_filename"), F.col("category").alias("old_category"))
    moved = new.join(before, null_safe(new, before, [("url", "o_url"), ("filename", "o_filename")])).where(~F.col("category").eqNullSafe(F.col("old_category")))
    moved = moved.select(F.lit("category").alias("change_type"), *IDENTITY, "old_category", F.lit(None).cast("string").alias("old_sha256"), F.col("sha256").alias("new_sha256"))
    return compared.unionByName(moved).withColumn("importable", importable(F.col("category")))


def summary(changes: DataFrame) -> DataFrame:
    """One row of counters."""
    count = lambda kind, extra=None: F.count_if((F.col("change_type") == kind) & (F.lit(True) if extra is None else extra))
    ok = F.col("importable")
    return changes.agg(
        count("added").alias("added"), count("removed").alias("removed"), count("changed").alias("changed_same_identity"), count("category").alias("category_changes"),
        count("added", ok).alias("importable_added"), count("changed", ok).alias("importable_changed_same_identity"),
    )


def build(fetched: DataFrame, previous: DataFrame, root: str) -> DataFrame:
    """Manifest rows of fetched (ord, url, filename, category, content): hash, place, and whether a name was seen with another hash before.

    Such a file is kept under a name with the start of its hash.
    """
    rows = fetched.withColumn("sha256", F.sha2("content", 256)).withColumn("bytes", F.octet_length("content").cast("long")).drop("content")
    known = last_of(previous.where("sha256 IS NOT NULL").select("ord", "category", "filename", "sha256"), ["category", "filename"]).select(F.col("category").alias("k_category"), F.col("filename").alias("k_filename"), F.col("sha256").alias("k_sha256"))
    joined = rows.join(known, null_safe(rows, known, [("category", "k_category"), ("filename", "k_filename")]), "left")
    reused = F.coalesce(F.col("k_sha256") != F.col("sha256"), F.lit(False))
    versioned = F.concat(F.regexp_replace("filename", r"(?i)\.pdf$", ""), F.lit("-"), F.substring("sha256", 1, 8), F.lit(".pdf"))
    name = F.when(reused, versioned).otherwise(F.col("filename"))
    return joined.select("ord", "url", "filename", "category", "sha256", "bytes", name.alias("filename_saved"), F.concat_ws("/", F.lit(root), "category", name).alias("saved"), reused.alias("filename_reused_with_new_hash"))

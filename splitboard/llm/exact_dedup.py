"""Exact dedup by progressive refinement: groups by length, then by a hash of the beginning, then by the digest of the whole text.

Each step looks only at what the one before left in groups of two or more:

1. one scan writes a narrow table, the length and the hash of the first PREFIX code points of each row, 16 bytes a row; its lengths are counted;
2. rows whose length is shared are counted by (length, beginning);
3. a second scan digests the whole text (SHA-256) of the rows whose (length, beginning) is shared, and of no other row, and
   writes what identifies a row, never its text. Equal digests are a group.

The shared keys of step 2 travel to the second scan: as a broadcast up to BROADCAST_KEYS rows; beyond that as a bit map of
2^MAP_BITS bits at most, a broadcast of fixed size, which lets a few other rows pass. These are digested in vain and form groups of
their own, so results are the same either way.

A group may hold a third of all rows: counts, minima and maxima are partial aggregates, so each task sends one row per
group, and groups go back to their rows by ``attach``: those that hold over one row in HOT_SHARE (HOT_SHARE at most, by count)
are broadcast, all others are joined by key.

Defined cases: a null text is an empty one and equal to it; a null doc_id is smaller than any other; of rows that share text and
doc_id one, drawn when the narrow table is written, stands for the group; an empty table gives an empty result; very long
texts are digested whole; further columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.llm.text import fresh, lower_ascii
from splitboard.sources import load, stage

PREFIX = 128
BROADCAST_KEYS = 400_000
MAP_BITS = 26
HOT_SHARE = 20_000
HOT_ROWS = 100
KEY = ["length", "beginning"]


def normal_text(text: Column, fold: bool = True) -> Column:
    """The text that is compared: null is empty; with fold A-Z are lower-cased, and nothing else."""
    whole = F.coalesce(text, F.lit(""))
    return lower_ascii(whole) if fold else whole


def first_keys(text: Column, fold: bool) -> tuple[Column, Column]:
    """(length, beginning): the octets of the text and the hash of its first code points; neither reads on."""
    whole = F.coalesce(text, F.lit(""))
    return F.octet_length(whole).cast("long").alias("length"), F.xxhash64(normal_text(F.substring(whole, 1, PREFIX), fold)).alias("beginning")


def shared_keys(docs: DataFrame, fold: bool) -> DataFrame:
    """(length, beginning) of two rows or more; beginnings are looked at where lengths are shared."""
    narrow = stage(docs.select(*first_keys(F.col("text"), fold)), "lengths")
    lengths = stage(narrow.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length"), "shared-lengths")
    if lengths.count() <= BROADCAST_KEYS:  # beyond that the next count alone decides, with the same result
        narrow = narrow.join(F.broadcast(lengths), "length", "left_semi")
    return stage(narrow.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "shared-beginnings")


def marked(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """rows (with KEY) and one more column: true for keys of the table keys, beyond the broadcast for some others, too; else null."""
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys.withColumn(name, F.lit(True))), KEY, "left")
    place = F.xxhash64(*KEY)
    word = F.shiftrightunsigned(place, 64 - MAP_BITS + 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words, bits = fresh(rows, "word"), fresh(rows, "bits")
    full = keys.select(word.alias(words), bit.alias("bit")).groupBy(words).agg(F.bit_or("bit").alias(bits))
    held = rows.withColumn(words, word).join(F.broadcast(full), words, "left")
    return held.withColumn(name, F.when(F.col(bits).bitwiseAND(bit) != 0, True)).drop(words, bits)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows (a written table) with the columns of their group, null where they have none; groups has one row for each key.

    size counts a group's rows. No more than HOT_SHARE groups can hold over one row in HOT_SHARE, so these are broadcast.
    """
    bound = max(HOT_ROWS, rows.count() // HOT_SHARE)
    groups = stage(groups, "groups")
    hot = groups.where(F.col(size) > bound)
    marked = rows.join(F.broadcast(hot), keys, "left")
    more = [c for c in groups.columns if c not in keys]
    rest = marked.where(F.col(size).isNull()).drop(*more).join(groups.where(F.col(size) <= bound).hint("shuffle_hash"), keys, "left")
    return marked.where(F.col(size).isNotNull()).unionByName(rest)


def digests(docs: DataFrame, carry: dict[str, Column] | None = None, fold: bool = True, lone: bool = False) -> DataFrame:
    """(row, doc_id, length, digest, carry): one written row per document; the digest is null where the first steps left the row alone.

    carry: further columns that the second scan computes, by name. lone: one more column of that name has the digest of the other rows.
    """
    keys = shared_keys(docs, fold)
    rows = docs.select("doc_id", "text", *[c.alias(n) for n, c in (carry or {}).items()])
    keyed = marked(rows.select("*", *first_keys(F.col("text"), fold)), keys, "shared")
    whole = F.sha2(normal_text(F.col("text"), fold), 256)
    more = [F.when(F.col("shared").isNull(), whole).alias("lone")] if lone else []
    return stage(keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "length", F.when(F.col("shared"), whole).alias("digest"), *more, *(carry or {})), "digests")


def grouped(docs: DataFrame, carry: dict[str, Column] | None = None, fold: bool = True, lone: bool = False) -> DataFrame:
    """(row, doc_id, length, digest, carry, group_size, least_id, last) for each document: its group's size, smallest doc_id and
    largest (doc_id, row). The three last are null for rows alone in their group.
    """
    rows = digests(docs, carry, fold, lone)
    sizes = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("group_size"), F.min("doc_id").alias("least_id"), F.max(F.struct("doc_id", "row")).alias("last")
    )
    shared = attach(rows.where("digest IS NOT NULL"), sizes.where("group_size > 1"), ["digest"], "group_size")
    return shared.unionByName(rows.where("digest IS NULL"), allowMissingColumns=True)  # which are not sent anywhere


def one_of_each(docs: DataFrame, fold: bool = True) -> DataFrame:
    """docs without the copies: of equal texts a row with the largest doc_id stays, whole.

    Only rows that the first steps leave in groups are grouped, each task sending one of each; all others stay where they are.
    """
    length, beginning, shared = "length", "beginning", fresh(docs, "shared")
    inner = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text")
    keyed = marked(inner.select("*", *first_keys(F.col("text"), fold)), shared_keys(docs, fold), shared)
    copies = keyed.where(shared).groupBy(length, beginning, F.sha2(normal_text(F.col("text"), fold), 256)).agg(
        F.max_by("whole", F.struct("doc_id", F.xxhash64("text"))).alias("whole")
    )
    return keyed.where(F.col(shared).isNull()).select("whole.*").unionByName(copies.select("whole.*"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: the row that stays of its group, the group's size and the digest of its text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    # The result names the digest of every text, so the query takes those of lone texts, too; the search does without them.
    found = grouped(docs, lone=True)
    return found.select(
        "doc_id",
        F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("last").isNull() | (F.col("last.row") == F.col("row"))).alias("kept"),
        F.coalesce("digest", "lone").alias("text_sha256"),
    )


OP11_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""

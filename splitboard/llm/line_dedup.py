"""Line dedup: which lines of each document repeat lines of other documents.

Only DataFrame operations. The search sends lines as 128-bit hashes, never as text:

1. each document gives its distinct long keys as (hash, document, positions);
2. these are range-partitioned by (hash, slice) with a secondary sort by document,
   the last first, so that a window streams the occurrences of a key without
   holding them. ``slice`` is a fixed function of the document: a key that a third
   of all documents hold is dealt over SLICES ranges instead of landing in one;
3. each (hash, slice) sends one row on; their sums show the keys with at least
   ``min_docs`` documents and the last document of each, which keeps its lines;
4. those keys go back to the other occurrences, and each document with losses gets
   its keep bitmap, coded as runs of dropped lines. ``keep_bitmaps`` returns these alone, without any text;
   ``with_bitmaps`` joins them to the documents, for callers that want the remaining text, and that join sends the rows.

Defined cases: null or empty text is one empty line; rows without a doc_id lose
nothing and make no key common; rows that share a doc_id count as one document,
and each of them loses the same keys; an empty table gives an empty result;
further columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitboard.llm.text import ASCII_SPACE, fresh, let, lower_ascii
from splitboard.sources import load, stage

MIN_CHARS = 20
MIN_DOCS = 3
SLICES = 64
#: Repeated keys are broadcast up to this many rows (40 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 400_000


def lines_of(text: Column) -> Column:
    """The text split at \\n; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(ASCII_SPACE)))


def text_id(text: Column) -> Column:
    """Tells apart the rows that share a doc_id; equal rows get equal results anyway."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_id, at): one row per document row and distinct long key, with its line numbers."""

    def numbered(line: Column, at: Column) -> Column:
        return let(
            key_of(line),
            lambda key: F.when(
                F.length(key) >= min_chars,
                F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), at.alias("at")),
            ),
        )

    rows = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", text_id(F.col("text")).alias("text_id"), F.array_compact(F.transform(lines_of(F.col("text")), numbered)).alias("keys")
    )
    return rows.select("doc_id", "text_id", F.explode("keys").alias("k")).select("k.h1", "k.h2", "doc_id", "text_id", "k.at")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_id, dropped): for each document with losses the runs (first, length) of lines that go.

    Keys of at least min_chars code points in at least min_docs documents keep
    their lines only in the largest doc_id that holds them.
    """
    found = stage(occurrences(docs, min_chars), "line-keys")
    slices = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).alias("slice")
    dealt = found.select("*", slices).repartitionByRange("h1", "h2", "slice").sortWithinPartitions("h1", "h2", "slice", F.desc("doc_id"), "at")
    last_first = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc("doc_id"))
    ranked = dealt.withColumn("rank", F.dense_rank().over(last_first))
    of_slices = ranked.groupBy("h1", "h2", "slice").agg(F.max("rank").alias("n"), F.max("doc_id").alias("last_doc"))
    common = of_slices.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last_doc").alias("last_doc")).where(F.col("n") >= min_docs)
    common = stage(common.select("h1", "h2", "last_doc"), "common-keys")
    common = common.hint("broadcast" if common.count() <= BROADCAST_KEYS else "merge")
    lost = found.join(common, ["h1", "h2"]).where(F.col("doc_id") < F.col("last_doc"))
    return (
        lost.groupBy("doc_id", "text_id")
        .agg(F.sort_array(F.collect_set("at")).alias("at"))
        .select("doc_id", "text_id", runs_of(F.col("at")).alias("dropped"))
    )


def runs_of(at: Column) -> Column:
    """Sorted numbers as runs (first, length)."""
    firsts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    lasts = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("length")))


def n_dropped(dropped: Column) -> Column:
    """Lines that a bitmap drops; a null bitmap drops none."""
    return F.coalesce(F.aggregate(dropped, F.lit(0).cast("long"), lambda n, run: n + run["length"]), F.lit(0).cast("long"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The text without the lines that its bitmap drops."""

    def joined(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda run: run["first"] + run["length"]))
        ends = F.concat(F.transform(dropped, lambda run: run["first"]), F.array(F.size(lines)))
        kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
        return F.array_join(kept, "\n")

    whole = F.coalesce(text, F.lit(""))
    return F.when(dropped.isNull(), whole).otherwise(let(lines_of(text), joined))


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, name: str = "dropped") -> DataFrame:
    """docs with one more column, the bitmap; null where a document keeps all lines."""
    bitmaps = keep_bitmaps(docs, min_chars, min_docs)
    own_doc, own_text = fresh(docs, "own_doc"), fresh(docs, "own_text")
    bitmaps = bitmaps.select(F.col("doc_id").alias(own_doc), F.col("text_id").alias(own_text), F.col("dropped").alias(name))
    same = (docs["doc_id"] == bitmaps[own_doc]) & (text_id(docs["text"]) == bitmaps[own_text])
    return docs.join(bitmaps.hint("shuffle_hash"), same, "left").drop(own_doc, own_text)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many lines it has and loses, and the digest of what stays."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    kept = with_bitmaps(docs)
    return kept.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        n_dropped(F.col("dropped")).alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("dropped")), 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.pos, a.line, c.k IS NOT NULL AND a.doc_id < c.last_doc AS gone
  FROM keyed a LEFT JOIN common c ON a.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

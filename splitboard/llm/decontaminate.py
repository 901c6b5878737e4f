"""Benchmark decontamination: short test items found inside long documents.

Only DataFrame operations. Sets are the distinct shingles of five words (an item of fewer words is
one shingle of all of them). The containment of an item Q in a document X is |Q & X| / |Q|.

Size partitions: items are partitioned by the power of two p below their number of shingles. Each partition has its own
MinHash sketch, the m = min(p, SKETCH) shingles smallest under a second hash, and its own bound of hits. Since the
sketch is a subset of Q and a document's shingles are all probed, sketches need not shrink the long side. In a
partition with p <= SKETCH items have at most u = 2p - 1 shingles, of which one contained to the degree t lacks at
most (1 - t)u, so m - (1 - t)u hits are sure: the search misses none there. In those above the hits are a
draw with mean tm, and the bound lies DEVIATIONS standard deviations below it. A document with fewer than tn shingles is
left out by its size.

Candidates are verified: all shingles of the candidate documents are held against all shingles
of their items, and the exact containment decides.

Tables of item shingles are broadcast while they have at most BROADCAST_ROWS rows. Beyond that the documents'
shingles first pass a bit map of the items' (FILTER_WORDS words of 64 bits at most, whatever the benchmark, so it is broadcast),
and what is left is shuffled by shingle and one of SALTS parts of the documents, so a shingle that a third of
all documents hold is dealt over as many tasks. Documents send nothing but their hits; those are counted with a partial
aggregate, so a passage that many hold meets in no task.

Defined cases: null texts are empty; texts without words contain nothing and are contained in nothing; rows
without a doc_id are searched like others and reported with a null id; repeated rows are reported once; an
empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitboard.llm.text import let, sized
from splitboard.sources import load, stage

WORDS = 5
THRESHOLD = 0.8
SKETCH = 128
DEVIATIONS = 5
BROADCAST_ROWS = 400_000
FILTER_WORDS = 1 << 18
SALTS = 16

#: Whatever is ASCII but no letter and no digit parts words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP, -1), lambda w: w != "")


def shingles(words: Column, width: int) -> Column:
    """Distinct hashes of the word sequences of this width."""

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(width)])

    at = F.sequence(F.lit(0), F.size(words) - width)
    return F.when(F.size(words) >= width, F.array_distinct(F.transform(at, hashed))).otherwise(F.array().cast("array<long>"))


def item_shingles(benchmark: DataFrame, threshold: float) -> DataFrame:
    """(item, item_id, width, n, hash, n_sketch, needed_hits, in_sketch): one row per shingle of each item."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    worded = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(WORDS))
    sets = F.when(F.size("words") >= WORDS, shingles(F.col("words"), WORDS))
    for w in range(1, WORDS):
        sets = sets.when(F.size("words") == w, shingles(F.col("words"), w))
    flat = worded.select("item", "item_id", width.alias("width"), sets.alias("set"))
    flat = flat.select("item", "item_id", "width", F.size("set").alias("n"), F.explode("set").alias("hash"))
    partition = F.pow(F.lit(2), F.floor(F.log2("n") + 1e-9)).cast("int")
    drawn = threshold * SKETCH - DEVIATIONS * (threshold * (1 - threshold) * SKETCH) ** 0.5
    sure = partition - F.floor((1 - threshold) * (2 * partition - 1) + 1e-9)
    flat = flat.withColumns({"n_sketch": F.least(partition, F.lit(SKETCH)), "needed_hits": F.greatest(F.when(partition <= SKETCH, sure).otherwise(int(drawn)), F.lit(1))})
    smallest_first = Window.partitionBy("item").orderBy(F.xxhash64(F.lit(7), "hash"), "hash")
    return flat.withColumn("in_sketch", F.row_number().over(smallest_first) <= F.col("n_sketch"))


def doc_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, text_id, width, size, hash) of docs (doc_id, text): the shingles of every width."""

    def of_width(words: Column, width: int) -> Column:
        return F.struct(F.lit(width).alias("width"), shingles(words, width).alias("set"))

    sets = let(words_of(F.col("text")), lambda words: F.array(*[of_width(words, w) for w in widths]))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), F.explode(sets).alias("s"))
    return rows.select("doc_id", "text_id", F.col("s.width").alias("width"), F.size("s.set").alias("size"), F.explode("s.set").alias("hash"))


def probed(shingles: DataFrame, items: DataFrame) -> DataFrame:
    """Shingles of documents that are shingles of items (a written table), with both sides' columns."""
    if items.count() <= BROADCAST_ROWS:
        return shingles.join(F.broadcast(items), ["width", "hash"])
    place = F.xxhash64(F.lit(3), "width", "hash")
    word, bit = F.pmod(place, F.lit(FILTER_WORDS)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(place, 40), F.lit(64)).cast("int"))
    bits = items.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    left = shingles.withColumns({"word": word, "bit": bit}).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "bits")
    salted = left.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_id"), F.lit(SALTS)).cast("int"))
    every = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every.hint("shuffle_hash"), ["width", "hash", "salt"]).drop("salt")


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_id, item_id, n_shingles, n_shared, containment) for every pair at or above the threshold."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be over 0.5")
    docs = docs.select("doc_id", "text")
    items = stage(item_shingles(benchmark, threshold), "item-shingles")
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    if not widths:
        widths = [WORDS]
    large_enough = F.col("size") >= F.ceil(threshold * F.col("n") - 1e-9)
    pair = ["doc_id", "text_id", "item", "item_id", "n"]

    sketches = stage(items.where("in_sketch").select("item", "item_id", "width", "n", "needed_hits", "hash"), "item-sketches")
    hits = probed(doc_shingles(docs, widths), sketches).where(large_enough)
    near = hits.groupBy(*pair, "needed_hits").agg(F.count_distinct("hash").alias("hits")).where("hits >= needed_hits")
    near = stage(near.select("doc_id", "text_id", "item"), "candidates")

    # The exact check reads the candidate documents again, whole, and the candidate items.
    found = sized(stage(near.select(F.col("doc_id").alias("c_doc"), F.col("text_id").alias("c_text")).distinct(), "candidate-docs"), BROADCAST_ROWS)
    again = docs.join(found, docs["doc_id"].eqNullSafe(found["c_doc"]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == found["c_text"]), "left_semi")
    every = stage(items.select("item", "item_id", "width", "n", "hash").join(near.select("item").distinct(), "item", "left_semi"), "item-sets")
    shared = probed(doc_shingles(again, widths), every).where(large_enough).groupBy(*pair).agg(F.count_distinct("hash").alias("n_shared"))
    wanted = near.select(F.col("doc_id").alias("c_doc"), F.col("text_id").alias("c_text"), F.col("item").alias("c_item"))
    same = shared["doc_id"].eqNullSafe(wanted["c_doc"]) & (shared["text_id"] == wanted["c_text"]) & (shared["item"] == wanted["c_item"])
    exact = shared.join(wanted.hint("merge"), same, "left_semi").where(F.col("n_shared") >= F.ceil(threshold * F.col("n") - 1e-9))
    return exact.select(
        "doc_id", "text_id", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("containment")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that contain an item."""
    leaks = stage(contained(docs, benchmark, threshold).select(F.col("doc_id").alias("c_doc"), F.col("text_id").alias("c_text")).distinct(), "leaks")
    leaks = sized(leaks, BROADCAST_ROWS)
    same = docs["doc_id"].eqNullSafe(leaks["c_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == leaks["c_text"])
    return docs.join(leaks, same, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it contains."""
    return contained(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_id")


OP2_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT *, least(len(w), {WORDS}) AS width FROM (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM iw
), ds AS (
  SELECT DISTINCT doc_id, width, list_aggregate(w[i : i + width - 1], 'string_agg', ' ') AS s FROM dw, widths, unnest(range(1, len(w) - width + 2)) AS r(i)
), its AS (
  SELECT DISTINCT item_id, width, list_aggregate(w[i : i + width - 1], 'string_agg', ' ') AS s FROM iw, unnest(range(1, len(w) - width + 2)) AS r(i)
), sizes AS (SELECT item_id, width, count(*) AS n FROM its GROUP BY item_id, width)
SELECT doc_id, item_id, any_value(n) AS n_shingles, count(*) AS n_shared, round(count(*) / any_value(n), 6) AS containment
FROM ds JOIN its USING (s, width) JOIN sizes USING (item_id, width)
GROUP BY doc_id, item_id HAVING count(*) >= ceil({THRESHOLD} * any_value(n) - 1e-9)
"""

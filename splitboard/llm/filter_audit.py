"""Filter interaction audit: what any order of five filters keeps, removes and repeats, from one pass over the texts.

A document fails some of the filters A to E. Of the 32 subsets of filters it survives those that hold none of these; its
truth-table survival word has a bit for each subset, set where it survives. The sum over documents of each bit
is the number of survivors of each subset, and all orders follow from these 32 numbers:

1. one scan gives each document's failures (built-in functions); whether its text repeats one of a smaller doc_id
   comes from the progressive refinement of ``exact_dedup``, case-sensitive, whose second scan it is;
2. tasks turn failures into words and count set bits per position with carry-save adders (numpy): sixteen words become five
   words of weights 1 to 16, three bitwise operations an adder, so most words are never taken apart;
3. a row per task and part holds 32 sums for all documents, for good and for toxic ones; Spark adds them up, and a part
   that holds a third of all rows sends no more than any other;
4. kept, removed, redundant, unique and Shapley numbers are sums and differences of survivors, exact in longs.

Defined cases: a null text is empty; a null lang is the part of the empty string; rows with a null doc_id have no label and
repeat nothing, and nothing repeats them; rows that share doc_id and text do not repeat each other; a document is good (toxic) if any of
its labels says so; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.llm import exact_dedup
from splitboard.llm.text import let
from splitboard.sources import load, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Parts that a task holds sums of before it sends them on.
MOST_PARTS = 4096
SUMS = "part string, survivors array<long>, good array<long>, toxic array<long>"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    capitals = F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def failed(w: Column) -> Column:
        tests = [F.size(w) < 100, 100 * F.size(F.array_distinct(w)) < 80 * F.size(w), 100 * capitals > 10 * F.length(whole), whole.rlike(r"[#$%&*|]")]
        return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))

    return let(words, failed)


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, the lowest first."""
    if len(words) < 64:
        bits = np.unpackbits(np.ascontiguousarray(words, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)
    lanes = np.zeros((16, -(-len(words) // 16)), np.uint32)
    lanes.reshape(-1)[: len(words)] = words
    # Level by level: three words of one weight become one of it and one of the double weight.
    weights: list[list[np.ndarray]] = [list(lanes), [], [], [], []]
    for i in range(4):
        while len(weights[i]) > 1:
            a, b, c = weights[i].pop(), weights[i].pop(), weights[i].pop() if weights[i] else np.zeros_like(lanes[0])
            half = a ^ b
            weights[i].append(half ^ c)
            weights[i + 1].append((a & b) | (half & c))
    return sum((1 << i) * sum(positional_popcounts(w) for w in level) for i, level in enumerate(weights) if level)


def survivor_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (part, failed, good, toxic) as SUMS, one row per part and task."""
    subsets = np.arange(SUBSETS, dtype=np.uint32)
    survives = np.array([((subsets & m) == 0) @ (np.uint64(1) << subsets.astype(np.uint64)) for m in range(SUBSETS)]).astype(np.uint32)
    sums: dict[str, np.ndarray] = {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(part, *n) for part, n in sums.items()], columns=["part", "survivors", "good", "toxic"])

    for batch in batches:
        if batch.empty:
            continue
        words = survives[batch["failed"].to_numpy()]
        labelled = [np.ones(len(words), bool), batch["good"].to_numpy(bool), batch["toxic"].to_numpy(bool)]
        codes, parts = pd.factorize(batch["part"])
        order = np.argsort(codes, kind="stable")
        for part, at in zip(parts, np.split(order, np.cumsum(np.bincount(codes))[:-1]), strict=True):
            sums[part] = sums.get(part, 0) + np.array([positional_popcounts(words[at[kind[at]]]) for kind in labelled])
        if len(sums) > MOST_PARTS:
            yield rows()
            sums = {}
    yield rows()


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SUMS of docs (doc_id, text, lang): for each part 32 numbers of survivors, the subset of no filter first, A in the lowest bit."""
    carry = {"part": F.coalesce("lang", F.lit("")), "failed": failures(F.col("text"))}
    found = exact_dedup.grouped(docs.select("doc_id", "text", "lang"), carry, fold=False)
    repeats = F.coalesce(F.col("doc_id") > F.col("least_id"), F.lit(False))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    narrow = found.select("doc_id", "part", (F.col("failed") + F.when(repeats, 16).otherwise(0)).alias("failed"))
    rows = narrow.join(marks.hint("shuffle_hash"), "doc_id", "left").select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    each = rows.mapInPandas(survivor_sums, SUMS)
    numbered = each.select("part", F.posexplode(F.arrays_zip("survivors", "good", "toxic")).alias("subset", "n"))
    summed = numbered.groupBy("part", "subset").agg(*[F.sum(f"n.{c}").alias(c) for c in ("survivors", "good", "toxic")])
    in_order = F.array_sort(F.collect_list(F.struct("subset", "survivors", "good", "toxic")))
    return summed.groupBy("part").agg(in_order.alias("n")).select("part", *[F.col(f"n.{c}").alias(c) for c in ("survivors", "good", "toxic")])


def shapley_weights(f: int) -> list[int]:
    """For filter f by subset: in how many orders just that subset comes before f, negative for the subset with f."""
    n = len(FILTERS)

    def weight(subset: int) -> int:
        before = (subset & ~(1 << f)).bit_count()
        return (-1 if subset >> f & 1 else 1) * factorial(before) * factorial(n - 1 - before)

    return [weight(s) for s in range(1 << n)]


def audited(sums: DataFrame) -> DataFrame:
    """(part, filter_order, step, …): what each step of all 120 orders keeps and removes, from the survivors of subsets."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = sums.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def subset(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))

    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    rows = rows.withColumns({"before": subset(F.substring("filter_order", F.lit(1), F.col("step") - 1)), "own": subset(letter)})
    after, everything = F.col("before") + F.col("own"), F.lit(SUBSETS - 1)
    n = lambda s, of="survivors": F.get(of, s)
    removed = n(F.col("before")) - n(after)
    weights = F.element_at(F.array(*[F.lit(shapley_weights(f)) for f in range(len(FILTERS))]), F.instr(F.lit(FILTERS), letter))
    shapley = F.aggregate(F.zip_with("survivors", weights, lambda x, w: x * w), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part", "filter_order", "step", n(after).alias("kept"), removed.alias("removed"),
        (n(F.lit(0)) - n(F.col("own")) - removed).alias("redundant"),
        (n(everything - F.col("own")) - n(everything)).alias("unique_fails"),
        (n(F.col("before"), "good") - n(after, "good")).alias("good_lost"),
        (n(F.col("before"), "toxic") - n(after, "toxic")).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, order and step: what the step keeps and removes, and its filter's share over all orders."""
    sums = stage(survivors(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")), "survivors")
    return audited(sums)


OP13_SQL = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(x) WHERE NOT contains(o, x) AND length(o) < 5
), t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first_id FROM t GROUP BY t
), marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM t JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), steps AS (SELECT o AS filter_order, k::INTEGER AS step, o[k] AS x, o[1 : k - 1] AS earlier FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5
), kinds AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), each AS (
  SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS failing, fails = x AS alone,
    len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone FROM kinds, steps
), counted AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND toxic), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM counted
"""

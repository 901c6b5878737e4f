"""Counts, bests and series per athlete, competition or event.

All of these take DataFrames and column names. Bests and series summaries are grouped minima over
structs, so each task sends one row per key, however many performances a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_counts(dim: DataFrame, facts: DataFrame, key: str, fact_key: str, counts: dict[str, Column]) -> DataFrame:
    """dim with aggregates of its facts, grouped before the join; integer aggregates of no facts are 0."""
    grouped = facts.groupBy(F.col(fact_key).alias("__key")).agg(*[c.alias(n) for n, c in counts.items()])
    joined = dim.join(grouped, dim[key] == grouped["__key"], "left").drop("__key")
    whole = {f.name for f in grouped.schema.fields if f.dataType.typeName() in ("long", "integer")}
    return joined.select(*dim.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) if n in whole else F.col(n) for n in counts])


def best_marks(facts: DataFrame, keys: list[str], seconds: str, date: str, row_key: str, keep: list[str]) -> DataFrame:
    """The row with the lowest mark for each key; ties go to the earliest date, then the smallest row_key."""
    row = F.struct(F.col(seconds).alias("s"), F.col(date).alias("d"), F.col(row_key).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    best = facts.groupBy(*keys).agg(F.min(row).alias("b"))
    return best.select(*keys, F.col("b.s").alias(seconds), F.col("b.d").alias(date), F.col("b.k").alias(row_key), *[F.col(f"b.c{i}").alias(c) for i, c in enumerate(keep)])


def series(facts: DataFrame, keys: list[str], seconds: str, date: str, row_key: str) -> DataFrame:
    """Each key's marks in order, numbered, with the difference to the one before and the best so far."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(date), row_key)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return facts.select(
        "*",
        F.row_number().over(order).alias("nth"),
        (F.col(seconds) - F.lag(seconds).over(order)).alias("change"),
        F.min(seconds).over(so_far).alias("best_so_far"),
    )


def series_summary(facts: DataFrame, keys: list[str], seconds: str, date: str, row_key: str) -> DataFrame:
    """Per key: points, best and its date (the earliest of equals), first mark, improvement (two points at least) and its percent."""
    by_mark = F.struct(F.col(seconds).alias("s"), F.col(date).alias("d"), F.col(row_key).alias("k"))
    by_date = F.struct(F.col(date).isNull().alias("n"), F.col(date).alias("d"), F.col(row_key).alias("k"), F.col(seconds).alias("s"))
    found = facts.groupBy(*keys).agg(F.count("*").alias("points"), F.min(by_mark).alias("b"), F.min(by_date).alias("f"))
    gain = F.when(F.col("points") >= 2, F.col("f.s") - F.col("b.s"))
    share = F.when(F.col("f.s") != 0, F.round(gain / F.col("f.s") * 100, 2))
    return found.select(*keys, "points", F.col("b.s").alias("best"), F.col("b.d").alias("best_date"), F.col("f.s").alias("first"), gain.alias("improvement"), share.alias("improvement_percent"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, number: str = "nth") -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(number) <= n)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "__nth").drop("__nth")


def histogram(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per key a map from value to count, in the order of the values."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value), F.col("__n").cast("int"))))
    return counts.groupBy(*keys).agg(F.map_from_entries(pairs).alias(name))


def head_and_tail(df: DataFrame, keys: list[str], order: list[str], head: int = 10, tail: int = 3) -> DataFrame:
    """All rows of a key with at most head + tail rows, else the first head and the last tail.

    Both ends are limited ranks, so a task sends no more than head + tail rows of a key on, however many it has; the counts that tell
    whether the ends overlap are a partial aggregate. Equal orders are told apart by a hash of the row.
    """
    whole = F.xxhash64(*df.columns)
    ahead, back = [F.asc(c) for c in order] + [whole.asc()], [F.desc(c) for c in order] + [whole.desc()]
    first = top_per_key(df, keys, ahead, head, "__at").drop("__at")
    counts = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__n"))
    last = top_per_key(df, keys, back, tail, "__at")
    same = [last[k].eqNullSafe(counts[f"__{k}"]) for k in keys]
    behind = last.join(counts.hint("shuffle_hash"), same).where(F.col("__n") - F.col("__at") >= head)
    return first.unionByName(behind.select(*df.columns))


def nested(children: DataFrame, key: str, fields: list[str | Column], name: str) -> DataFrame:
    """Per key its children as an array of structs, ordered by the first field."""
    return children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

"""Optional filters. An argument that is None (or empty, where it says so) filters nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Case-insensitive substring; % and _ of the text are wildcards. Empty text filters nothing."""
    return df.where(F.col(column).ilike(f"%{text}%")) if text else df


def equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """Equality; a false value (None, 0, empty) filters nothing."""
    return df.where(F.col(column) == F.lit(value)) if value else df


def flag(df: DataFrame, column: str, value: bool | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == F.lit(value))


def between(df: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    """Inclusive range, open where a bound is None."""
    df = df if low is None else df.where(F.col(column) >= F.lit(low))
    return df if high is None else df.where(F.col(column) <= F.lit(high))


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or empty."""
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() & (F.col(c) != "") for c in columns]))


def selected(df: DataFrame, columns: list[str], selectors: list[str], status: str | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Rows of which some selector is a substring of the columns' joined text, and whose status is listed. No selectors take all."""
    text = F.lower(F.concat_ws(" ", *columns))
    if selectors:
        df = df.where(reduce(Column.__or__, [text.contains(s.lower()) for s in selectors]))
    return df.where(F.col(status).isin(statuses)) if status and statuses else df


def valid_marks(df: DataFrame, is_dq: str, seconds: str) -> DataFrame:
    """Rows with a readable mark that were not disqualified."""
    return df.where(~F.coalesce(F.col(is_dq), F.lit(False)) & F.col(seconds).isNotNull())


def might_be_in(rows: DataFrame, keys: DataFrame, columns: list[str], size: int | None = None) -> DataFrame:
    """The rows whose columns may be in keys, decided by a bit map of the keys' hashes that is broadcast; none that is in keys is lost.

    The map has 16 bits a key, and 2^26 at most whatever the number of keys: beyond 4 million it lets more of the other rows pass. size is the number of keys
    where that is known.
    """
    words = 1 << min(20, max(8, ((keys.count() if size is None else size) // 4).bit_length()))
    place = F.xxhash64(F.lit(11), *columns)
    word = F.pmod(place, F.lit(words))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(place, 40).bitwiseAND(F.lit(63)).cast("int"))
    full = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    held = rows.withColumn("__word", word).join(F.broadcast(full), "__word")
    return held.where(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")

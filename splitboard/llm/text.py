"""Column helpers that the operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII white space that the contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df, wanted: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sized(staged: DataFrame, most: int, otherwise: str = "shuffle_hash") -> DataFrame:
    """A staged table with a hint: broadcast while its counted rows are within most, otherwise the other strategy."""
    return staged.hint("broadcast" if staged.count() <= most else otherwise)


def smallest(df: DataFrame, key: Column, n: int, *ties: str) -> DataFrame:
    """The n rows with the smallest keys, equal keys in the order of ties.

    The n-th key is found first, from keys alone, so that tasks do not each send n whole rows to one place.
    """
    last = df.select(key.alias("key")).where("key IS NOT NULL").orderBy("key").limit(n).agg(F.max("key")).first()[0]
    return df.where(F.lit(False) if last is None else key <= last).orderBy(key, *ties).limit(n)

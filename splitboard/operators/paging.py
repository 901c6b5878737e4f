"""Pages of ordered lists."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    """One page's rows and the totals; only the count reaches the driver."""

    rows: DataFrame
    page: int
    limit: int
    total: int

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total / self.limit) if self.limit > 0 else 0


def ordered(choices: dict[str, Column | str], sort: str, descending: bool, default: str) -> Column:
    """A column of a fixed choice; nulls are last ascending and first descending."""
    chosen = choices.get(sort, choices[default])
    column = F.col(chosen) if isinstance(chosen, str) else chosen
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def rows_of_page(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """The page's rows; order must end in a key. Planned as a top-n, not as a full sort."""
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def paged(df: DataFrame, order: list[Column], page: int, limit: int) -> Page:
    return Page(rows_of_page(df, order, page, limit), page, limit, df.count())

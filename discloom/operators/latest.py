"""The row of each group that counts: latest filing, latest year, first rows.

Latest rows are aggregates (max of a comparable key), so they combine before
the shuffle and a hot group is no sort in one task; top-k keeps a window, which
Spark limits per partition first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(df: DataFrame, group: Sequence[str], order: Sequence[str], smallest: bool = False) -> DataFrame:
    """One row per group: the largest (or smallest) values of ``order``.

    Nulls in ``order`` lose against any value; the last column should be
    unique, else equal rows leave either.  Null groups are groups.
    """
    rest = [c for c in df.columns if c not in group]
    key = F.struct(*[F.col(c) for c in order])
    if smallest:
        key = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c))])
    best = (F.min_by if smallest else F.max_by)(F.struct(*rest), key).alias("__row")
    return df.groupBy(*group).agg(best).select(*group, "__row.*").select(*df.columns)


def latest_year_rows(df: DataFrame, group: Sequence[str], year: str = "year", scope: Column | None = None) -> DataFrame:
    """All rows of each group's latest year; ``scope`` tells which rows may set
    the year and stay."""
    own = df if scope is None else df.filter(scope)
    top = own.groupBy(*group).agg(F.max(year).alias("__y"))
    return own.join(top, list(group)).filter(F.col(year) == F.col("__y")).drop("__y")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their position from 1."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key in the order of a column (case and such are
    settled by the key)."""
    keyed = df.withColumn("__k", key)
    return latest(keyed, ["__k"], [order], smallest=True).drop("__k")


def tier(c: Column, tiers: Sequence[Sequence[object]]) -> Column:
    """The number of the first tier that holds a value, one more than the last
    for none."""
    out = F
    for i, t in enumerate(tiers):
        out = out.when(c.isin(*t), i)
    return out.otherwise(len(tiers))


def best_ranked(df: DataFrame, group: Sequence[str], ranks: Sequence[Column], tie: str) -> DataFrame:
    """The row of each group whose ranks come first, in order, then the
    smallest ``tie``: an aggregate, so it combines before the shuffle."""
    key = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)], F.col(tie))
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.min_by(F.struct(*rest), key).alias("__row")).select(*group, "__row.*").select(*df.columns)

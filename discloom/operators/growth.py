"""Series by year: growth, labels, histories, sparklines, walk-forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from discloom.functions.cols import ordered_when


def year_over_year(df: DataFrame, group: Sequence[str], year: str, value: str) -> DataFrame:
    """The last two non-null years of each group and the change in percent
    (one place, half to even); a previous value of zero gives null."""
    own = df.filter(F.col(value).isNotNull()).select(*group, year, value)
    w = W.partitionBy(*group).orderBy(F.desc(year))
    two = own.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= 2)
    at = lambda r, c: F.max(F.when(F.col("__r") == r, F.col(c)))
    got = two.groupBy(*group).agg(at(1, year).alias("year"), at(1, value).alias("latest"), at(2, value).alias("previous"))
    pct = F.when(F.col("previous") > 0, F.bround((F.col("latest") - F.col("previous")) / F.col("previous") * 100, 1))
    return got.withColumn("yoy_pct", pct)


def first_last(df: DataFrame, group: Sequence[str], year: str, value: str, least_first: float = 5, least_points: int = 2) -> DataFrame:
    """First and last non-null values, their difference, percent and span, for
    series of enough points with a large enough first value."""
    own = df.filter(F.col(value).isNotNull())
    g = own.groupBy(*group).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by(value, year).alias("first"),
        F.max_by(value, year).alias("last"),
        (F.max(year) - F.min(year)).alias("span"),
    )
    g = g.filter((F.col("points") >= least_points) & (F.col("first") >= least_first))
    return g.withColumn("growth_abs", F.col("last") - F.col("first")).withColumn(
        "growth_pct", F.bround((F.col("last") - F.col("first")) / F.col("first") * 100, 1)
    )


# Labels of growth in percent.
DIRECTIONS = ((50, "rapidly-growing"), (10, "growing"), (-5, "stable"))


def direction(pct: Column) -> Column:
    """The label of a growth; unknown where it is null."""
    return F.when(pct.isNull(), "unknown").otherwise(ordered_when([(pct >= least, name) for least, name in DIRECTIONS], "contracting"))


def history(df: DataFrame, group: Sequence[str], year: str, value: str) -> DataFrame:
    """group, history: array of (year, value) in order of years.

    A history has one entry a year, so its length is bounded by the years.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, year).agg(F.max(value).alias("n"))
    return per.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(year).alias("year"), "n"))).alias("history"))


def sparkline(h: Column, width: int = 80, height: int = 20) -> Column:
    """Points (x, y) of a history scaled into a box."""
    n = F.size(h)
    values = F.transform(h, lambda p: p["n"].cast("double"))
    low, span = F.array_min(values), F.array_max(values) - F.array_min(values)
    return F.transform(
        values,
        lambda v, i: F.struct(
            F.when(n > 1, i / (n - 1) * (width - 2) + 1).otherwise(F.lit(1.0)).alias("x"),
            (F.lit(height - 2) - F.coalesce(F.try_divide(v - low, span), F.lit(0.0)) * (height - 4)).alias("y"),
        ),
    )


def missing_cells(df: DataFrame, part: str, other: str, total: str) -> DataFrame:
    """A missing part is the total less the other, not under zero; a missing
    total is the sum."""
    p, o, t = F.col(part), F.col(other), F.col(total)
    return df.withColumns(
        {
            other: F.coalesce(o, F.greatest(F.lit(0), t - p)),
            part: F.coalesce(p, F.greatest(F.lit(0), t - o)),
            total: F.coalesce(t, p + o),
        }
    )


def walk_forward(df: DataFrame, keys: Sequence[str], start: Column, yearly: Column, years: int = 10) -> DataFrame:
    """keys, year, balance for years 0..years: what a yearly amount makes of a
    start."""
    return df.select(*keys, start.alias("__s"), yearly.alias("__y"), F.explode(F.sequence(F.lit(0), F.lit(years))).alias("year")).select(
        *keys, "year", (F.col("__y") * F.col("year") - F.col("__s")).alias("balance")
    )


def rates(df: DataFrame, group: Sequence[str], lost: Sequence[str], base: str, digits: int = 1) -> DataFrame:
    """Sum of losses over the sum of a base, in percent."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in lost[1:]), F.coalesce(F.col(lost[0]), F.lit(0)))
    g = df.groupBy(*group).agg(F.sum(total).alias("lost"), F.sum(base).alias("base"))
    return g.withColumn("rate_pct", F.when(F.col("base") > 0, F.bround(F.col("lost") / F.col("base") * 100, digits)))


def latest_breakdown(df: DataFrame, key: str, year: str, kind: str, value: str, legacy: str = "franchised", kinds: Sequence[str] = ("total", "franchised", "company-owned")) -> DataFrame:
    """key, latest_year and the value of each kind in it (hyphens become
    underscores); where the ``legacy`` kind has none, that of a row without a
    kind.  Of several rows the largest value counts."""
    own = df.filter(F.col(year).isNotNull())
    per = own.groupBy(key, year).agg(
        *[F.max(F.when(F.col(kind) == k, F.col(value))).alias(k.replace("-", "_")) for k in kinds],
        F.max(F.when(F.col(kind).isNull(), F.col(value))).alias("__old"),
    )
    per = per.withColumn(legacy, F.coalesce(legacy, "__old")).drop("__old")
    names = [k.replace("-", "_") for k in kinds]
    top = per.groupBy(key).agg(F.max_by(F.struct(F.col(year).alias("latest_year"), *names), year).alias("x"))
    return top.select(key, "x.*")

"""Exact order statistics and distributions.

Values are counted before they are shuffled and ranks come from running sums,
so a group's values are never held in memory nor pass through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from discloom.session import write_cut


def running_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, value, __c (rows of the value), __to (rows up to it), n (rows of
    the group) of the distinct non-null values.

    Values are laid out in ranges of group and value; ranks come from counts
    per range and group, of which a group has no more than there are ranges.
    So a group with most of the rows is spread over as many tasks as any data
    of its size.  The layout is written to the shared folder, as the numbers
    of its ranges must not change between the two uses.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    laid = write_cut(counts.repartitionByRange(*group, value).withColumn("__p", F.spark_partition_id()), "ranks")
    parts = laid.groupBy(*group, "__p").agg(F.sum("__c").alias("__s"))
    own = W.partitionBy(*group)
    base = parts.select(
        F.col("__p").alias("__q"),
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.sum("__s").over(own).alias("n"),
        F.coalesce(F.sum("__s").over(own.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    on = laid["__p"] == base["__q"]
    for i, g in enumerate(group):
        on = on & laid[g].eqNullSafe(base[f"__g{i}"])
    inside = F.sum("__c").over(W.partitionBy(*group, "__p").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return laid.join(base, on).select(*group, value, "__c", "n", (F.col("__before") + inside).alias("__to"))


def at_ranks(df: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """group, n and for each name the value at a 0-based rank of the sorted
    non-null values; rank expressions may use column ``n``."""
    run = running_counts(df, group, value)
    hit = {k: F.when((r >= F.col("__to") - F.col("__c")) & (r < F.col("__to")), F.col(value)) for k, r in ranks.items()}
    return run.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(c).alias(k) for k, c in hit.items()])


def median(df: DataFrame, group: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """The exact median (mean of the middle two)."""
    n = F.col("n")
    r = at_ranks(df, group, value, {"__a": F.floor((n - 1) / 2), "__b": F.floor(n / 2)})
    return r.select(*group, "n", ((F.col("__a") + F.col("__b")) / 2).alias(name))


def upper_median(df: DataFrame, group: Sequence[str], value: str, name: str = "upper_median") -> DataFrame:
    """The value at rank n // 2."""
    return at_ranks(df, group, value, {name: F.floor(F.col("n") / 2)})


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, percents: Sequence[int], least: int = 3) -> DataFrame:
    """Values at rank round(p / 100 * (n - 1)), half to even, for groups of at
    least ``least`` values."""
    n = F.col("n")
    r = at_ranks(df, group, value, {f"p{p}": F.bround((n - 1) * F.lit(p) / 100).cast("bigint") for p in percents})
    return r.filter(n >= least)


def quintile_cuts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Values at rank int(p * n) for p of 0.2 to 0.8."""
    n = F.col("n")
    return at_ranks(df, group, value, {f"cut{i}": F.least(F.floor(n * F.lit(i) / 5), n - 1) for i in range(1, 5)})


def quintile_thresholds(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, n, cut1 .. cut4 of the positive values: those at rank int(p * n)
    for p of 0.2 to 0.8; up to four values are cuts themselves, each once, the
    last one repeated."""
    run = running_counts(df.filter(F.col(value) > 0), group, value)
    n = F.col("n")
    ranks = [F.least(F.floor(n * F.lit(i) / 5), n - 1) for i in range(1, 5)]
    at = [F.max(F.when((r >= F.col("__to") - F.col("__c")) & (r < F.col("__to")), F.col(value))).alias(f"__{i}") for i, r in enumerate(ranks, 1)]
    g = run.groupBy(*group).agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.when(n <= 4, F.col(value)))).alias("__few"), *at)
    few = lambda i: F.coalesce(F.get("__few", F.lit(i - 1)), F.get("__few", F.size("__few") - 1))
    return g.select(*group, "n", *[F.when(n <= 4, few(i)).otherwise(F.col(f"__{i}")).alias(f"cut{i}") for i in range(1, 5)])


def half_up_percent(part: Column, whole: Column) -> Column:
    """A whole percentage, halves up; zero of nothing."""
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole + 0.5)).cast("int")


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """score, n, mean, upper_median: the histogram of scores beside their mean
    and upper median."""
    one = df.select(F.lit(1).alias("__g"), F.col(score).alias("score"))
    run = running_counts(one, ["__g"], "score")
    mid = F.floor(F.col("n") / 2)
    facts = run.agg(
        (F.sum(F.col("score") * F.col("__c")) / F.sum("__c")).alias("mean"),
        F.max(F.when((mid >= F.col("__to") - F.col("__c")) & (mid < F.col("__to")), F.col("score"))).alias("upper_median"),
    )
    return run.select("score", F.col("__c").alias("n")).join(F.broadcast(facts))


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """bin, lower, upper, n of half-open bins, empty ones too; values outside
    the edges and nulls are in none."""
    bins = df.sparkSession.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lower double, upper double"
    )
    index = F
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        index = index.when((F.col(value) >= a) & (F.col(value) < b), i)
    counts = df.select(index.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def top_k_other(df: DataFrame, group: str, k: int, other: str = "(other)") -> DataFrame:
    """Counts of the k most frequent groups and one row for all the rest."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.desc("n"), group)
    top = counts.orderBy(F.desc("n"), F.asc(group)).limit(k).withColumn("pos", F.row_number().over(w))
    rest = counts.join(top.select(group), group, "left_anti").agg(F.sum("n").alias("n"))
    return top.select(F.col(group).alias("name"), "n", "pos").unionByName(
        rest.filter(F.col("n").isNotNull()).select(F.lit(other).alias("name"), "n", F.lit(k + 1).alias("pos"))
    )


def mode(df: DataFrame, group: Sequence[str], value: str, order: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group, the first seen of equals."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("n", -F.col("__first"))).alias(name), F.max("n").alias("n"))


def with_parents(df: DataFrame, leaf: str, prefix: str, sep: str = "-") -> DataFrame:
    """Rows of leaves that start with a prefix count for it too: one row more
    with the prefix as group."""
    return df.withColumn(
        leaf, F.explode(F.array_compact(F.array(F.col(leaf), F.when(F.col(leaf).startswith(prefix + sep), F.lit(prefix)))))
    )


def z_badges(df: DataFrame, value: str, polarity: int = 1, name: str = "z") -> DataFrame:
    """z-score of a value over all rows, sign by polarity."""
    m, sd = df.agg(F.avg(value), F.stddev_pop(value)).first()
    return df.withColumn(name, F.try_divide(F.col(value) - F.lit(m), F.lit(sd)) * polarity)


def composite_score(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of scores; null until a weight is set."""
    total = sum(weights.values())
    if not total:
        return F.lit(None).cast("double")
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + scores[k] * F.lit(w / total)
    return out

"""Joins between rows of one or two tables beyond plain keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def untried(df: DataFrame, tried: DataFrame, name: str, other: str) -> DataFrame:
    """Rows whose name was not tried yet, case and outer blanks aside; null
    names count as untried."""
    key = lambda c: F.lower(F.trim(c))
    done = tried.select(key(F.col(other)).alias("__k")).distinct()
    return df.withColumn("__k", key(F.col(name))).join(done, "__k", "left_anti").drop("__k")


def contains_pairs(a: DataFrame, b: DataFrame, least: int = 5) -> DataFrame:
    """a_key, b_key, how: pairs of distinct keys (column ``key``) that are
    equal or of which one contains the other, the contained one having at
    least ``least`` characters.

    A contained key's first ``least`` characters stand in the other, so both
    sides meet on such pieces: an equi-join, nothing is broadcast or crossed.
    Null and empty keys meet nothing.
    """

    def sides(big: DataFrame, small: DataFrame, big_name: str, small_name: str) -> DataFrame:
        heads = small.filter(F.length("key") >= least).select(F.col("key").alias(small_name), F.substring("key", 1, least).alias("__p"))
        n = F.length("key")
        pieces = (
            big.filter(n >= least)
            .select(F.col("key").alias(big_name), F.explode(F.sequence(F.lit(1), n - least + 1)).alias("__i"))
            .select(big_name, F.substring(F.col(big_name), F.col("__i"), F.lit(least)).alias("__p"))
            .distinct()
        )
        return pieces.join(heads, "__p").filter(F.col(big_name).contains(F.col(small_name))).select("a_key", "b_key")

    a, b = (x.select("key").filter(F.length("key") > 0).distinct() for x in (a, b))
    equal = a.join(b, "key").select(F.col("key").alias("a_key"), F.col("key").alias("b_key"))
    pairs = sides(a, b, "a_key", "b_key").unionByName(sides(b, a, "b_key", "a_key")).unionByName(equal).distinct()
    how = F.when(F.col("a_key") == F.col("b_key"), "equal").when(F.contains("a_key", "b_key"), "contains").otherwise("contained")
    return pairs.withColumn("how", how)


def first_match(df: DataFrame, name: str, steps: Sequence[tuple[str, DataFrame]], on: Sequence[Column]) -> DataFrame:
    """The value of the first step whose join finds one, and which step it was.

    Each step is (label, table of unique ``key`` and ``value``), each ``on``
    the row's key for it.
    """
    out = df
    for i, ((_, t), key) in enumerate(zip(steps, on, strict=True)):
        out = out.withColumn(f"__k{i}", key).join(t.select(F.col("key").alias(f"__k{i}"), F.col("value").alias(f"__v{i}")), f"__k{i}", "left")
    value = F.coalesce(*[F.col(f"__v{i}") for i in range(len(steps))])
    how = F
    for i, (label, _) in enumerate(steps):
        how = how.when(F.col(f"__v{i}").isNotNull(), label)
    return out.withColumns({name: value, f"{name}_by": how}).drop(*[f"__{x}{i}" for i in range(len(steps)) for x in "kv"])


def tiered_names(df: DataFrame, name: str, known: DataFrame, least: int = 5, head: int = 4) -> DataFrame:
    """key, match, how: the known key (column ``key``) of each different key in
    ``name``: an equal one, else the shortest that contains it or that it
    contains (``least`` characters at least), else the first that begins with
    the same ``head`` characters.  Ties go to the first in text order; keys
    without a match have null."""
    own = df.select(F.col(name).alias("key")).filter(F.length("key") > 0).distinct()
    k = known.select("key").filter(F.length("key") > 0).distinct()
    pairs = contains_pairs(own, k, least)
    rank = F.struct((F.col("how") != "equal").alias("far"), F.length("b_key").alias("n"), F.col("b_key").alias("k"))
    near = pairs.groupBy(F.col("a_key").alias("key")).agg(F.min(F.struct(rank.alias("r"), F.col("how")))["r"].alias("r"))
    near = near.select("key", F.col("r.k").alias("__near"), F.when(F.col("r.far"), "substring").otherwise("exact").alias("__how"))
    begins = k.filter(F.length("key") >= head).groupBy(F.substring("key", 1, head).alias("__h")).agg(F.min("key").alias("__first"))
    j = own.join(near, "key", "left").withColumn("__h", F.when(F.length("key") >= head, F.substring("key", 1, head))).join(begins, "__h", "left")
    how = F.coalesce("__how", F.when(F.col("__first").isNotNull(), "prefix"))
    return j.select("key", F.coalesce("__near", "__first").alias("match"), how.alias("how"))


def lesser_peers(df: DataFrame, key: str, group: str, value: str, k: int) -> DataFrame:
    """key, peer, rank: of each row, the k rows of its group with the next
    smaller values (ties by key).

    One sort per group and a sliding frame of k rows; no pairs are formed.
    Rows with equal values are not lesser, so the frame runs over distinct
    values and takes their rows with the smallest keys.
    """
    own = df.filter(F.col(value).isNotNull())
    w = W.partitionBy(group, value).orderBy(key)
    few = own.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= k).groupBy(group, value).agg(F.array_sort(F.collect_list(F.struct("__i", key))).alias("__rows"))
    below = W.partitionBy(group).orderBy(value).rowsBetween(-k, -1)
    cand = few.withColumn("__near", F.reverse(F.collect_list("__rows").over(below))).select(group, value, F.slice(F.flatten("__near"), 1, k).alias("__peers"))
    return (
        own.select(key, group, value)
        .join(cand, [group, value])
        .select(key, F.posexplode("__peers").alias("__p", "__x"))
        .select(key, F.col(f"__x.{key}").alias("peer"), (F.col("__p") + 1).alias("rank"))
    )


def ring_peers(df: DataFrame, key: str, group: str, order: str, k: int) -> DataFrame:
    """key, peer, rank: the first k other rows of each row's group by ``order``
    (descending, ties by key)."""
    w = W.partitionBy(group).orderBy(F.desc_nulls_last(order), key)
    top = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k + 1)
    tops = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__r", key))).alias("__t"))
    return (
        df.select(key, group)
        .join(tops, group)
        .select(key, F.posexplode(F.slice(F.filter("__t", lambda x: x[key] != F.col(key)), 1, k)).alias("__p", "__x"))
        .select(key, F.col(f"__x.{key}").alias("peer"), (F.col("__p") + 1).alias("rank"))
    )


def other_medians(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """key, n_peers, peer_median: the median of the positive values of all
    other rows of the group, without forming pairs.

    With the group's positive values sorted, leaving one out moves the middle
    by one place at most, so each row needs only the three middle values.
    """
    from discloom.operators.stats import running_counts

    pos = df.select(key, group, F.when(F.col(value) > 0, F.col(value)).alias("__v"))
    run = running_counts(pos, [group], "__v")
    half = F.floor((F.col("n") - 1) / 2)
    at = lambda r: F.max(F.when((r >= F.col("__to") - F.col("__c")) & (r < F.col("__to")), F.col("__v")))
    mids = run.groupBy(group).agg(F.max("n").alias("__n"), *[at(half + d).alias(f"__m{d + 1}") for d in (-1, 0, 1, 2)])
    # Of equal values any may be left out, so the first one's rank serves for all.
    ranked = run.select(group, "__v", (F.col("__to") - F.col("__c")).alias("__i"))
    sizes = df.groupBy(group).agg((F.count(F.lit(1)) - 1).alias("n_peers"))
    rows = pos.join(ranked, [group, "__v"], "left").join(mids, group, "left").join(sizes, group)
    m, i = F.col("__n"), F.col("__i")
    h = F.floor((m - 1) / 2)
    # Ranks among the others: those after the row's own move up by one.
    at = lambda r: F.col(f"__m{r + 1}")
    left_out = i.isNotNull()
    odd = m % 2 == 1
    pick = lambda d: F.when(i <= h + d, at(d + 1)).otherwise(at(d))  # noqa: E731  value at group rank h+d among the others
    med = (
        F.when(~left_out & odd, F.col("__m1"))
        .when(~left_out, (F.col("__m1") + F.col("__m2")) / 2)
        .when(m == 1, None)
        .when(odd, (pick(-1) + pick(0)) / 2)  # m - 1 others, even: ranks h-1 and h
        .otherwise(pick(0))  # odd number of others: rank h
    )
    return rows.select(key, "n_peers", med.alias("peer_median"))


def unordered_pairs(df: DataFrame, key: str, group: str, eligible: Column | None = None) -> DataFrame:
    """key_a < key_b of all pairs within a group, asked for as the result.

    The result is quadratic by its nature; ``eligible`` is applied before.
    """
    own = (df if eligible is None else df.filter(eligible)).select(group, key)
    return own.select(group, F.col(key).alias("key_a")).join(own.select(group, F.col(key).alias("key_b")), group).filter("key_a < key_b")


def compare_matrix(df: DataFrame, key: str, chosen: Sequence[object], metrics: Sequence[str]) -> DataFrame:
    """One row per metric, one column per chosen key (as text)."""
    long = df.filter(F.col(key).isin(*chosen)).unpivot([key], list(metrics), "metric", "value")
    return long.groupBy("metric").pivot(key, list(chosen)).agg(F.first("value"))

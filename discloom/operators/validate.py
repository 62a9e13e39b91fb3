"""Checks of fields and tables; issues are rows, never side effects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discloom.session import write_cut


def bounded(df: DataFrame, bounds: Mapping[str, tuple[float, float]], flags: str = "quality_flag") -> DataFrame:
    """Fields as numbers within bounds; what is none or outside becomes null
    and is named in ``flags`` (joined by "; ", null if all is well)."""
    notes, cols = [], {}
    for c, (lo, hi) in bounds.items():
        raw = F.col(c).cast("string")
        x = F.regexp_replace(raw, r"[$,%\s]", "").try_cast("double")
        ok = x.between(lo, hi)
        notes.append(
            F.when(raw.isNotNull() & x.isNull(), F.lit(f"{c}=non_numeric")).when(
                x.isNotNull() & ~ok, F.concat(F.lit(f"{c}="), F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("_out_of_range"))
            )
        )
        cols[c] = F.when(ok, x)
    flag = F.array_join(F.array_compact(F.array(*notes)), "; ")
    return df.withColumn(flags, F.nullif(flag, F.lit(""))).withColumns(cols)


def ordered_pair(df: DataFrame, low: str, high: str, flag: str) -> DataFrame:
    """Swaps a low above its high and says so."""
    lo, hi = F.col(low), F.col(high)
    turned = F.coalesce(lo > hi, F.lit(False))
    return df.select(
        *[c for c in df.columns if c not in (low, high, flag)],
        F.when(turned, hi).otherwise(lo).alias(low),
        F.when(turned, lo).otherwise(hi).alias(high),
        turned.alias(flag),
    )


def flattened(items: Column, low: str, high: str, note: str, most: int = 500) -> Column:
    """A list of objects as one: least low, largest high, notes joined."""
    get = lambda f: F.transform(items, lambda x: x[f])
    notes = F.array_join(F.filter(get(note), lambda x: x.isNotNull() & (x != "")), " | ")
    return F.struct(F.array_min(get(low)).alias(low), F.array_max(get(high)).alias(high), F.substring(notes, 1, most).alias(note))


def issues(df: DataFrame, key: Sequence[str], checks: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """key, severity, check_name, detail: one row per failed check
    (severity, name, what is wrong, detail); a null test is no issue."""
    found = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("check_name"), detail.cast("string").alias("detail")))
                for sev, name, bad, detail in checks
            ]
        )
    )
    return df.select(*key, F.explode(found).alias("i")).select(*key, "i.*")


def value_bound_checks(lo: str = "value_min", hi: str = "value_max", values: Sequence[str] = ("value_avg", "value_median")) -> list:
    """Values outside their own minimum and maximum."""
    return [("fail", f"{v}_out_of_bounds", (F.col(v) < F.col(lo)) | (F.col(v) > F.col(hi)), F.col(v)) for v in values]


def sums_up(df: DataFrame, group: Sequence[str], kind: str, value: str, parts: Sequence[str], total: str, slack: float = 1) -> DataFrame:
    """group, parts, total of groups whose parts do not make the total; groups
    without all of them are not judged."""
    one = lambda k: F.sum(F.when(F.col(kind) == k, F.col(value)))
    g = df.groupBy(*group).agg(*[one(k).alias(f"__p{i}") for i, k in enumerate(parts)], one(total).alias("total"))
    made = sum((F.col(f"__p{i}") for i in range(1, len(parts))), F.col("__p0"))
    return g.withColumn("parts", made).filter(F.abs(F.col("parts") - F.col("total")) > slack).select(*group, "parts", "total")


def audit(checks: Sequence[tuple[int, str, DataFrame]]) -> DataFrame:
    """tier, check, key, detail of several checks (tier, name, rows of key and
    detail) in one table."""
    out = None
    for tier, name, df in checks:
        rows = df.select(F.lit(tier).alias("tier"), F.lit(name).alias("check"), F.col("key").cast("string").alias("key"), F.col("detail").cast("string").alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_passes(found: DataFrame) -> bool:
    """Whether no check of the first tier failed."""
    return found.filter(F.col("tier") == 1).limit(1).count() == 0


def guarded_audit(checks: Sequence[tuple[int, str, Callable[[], DataFrame]]], spark: SparkSession) -> DataFrame:
    """Like :func:`audit` of checks still to be run: one that fails to run is
    itself a row of the first tier, and the others go on."""
    done = []
    for tier, name, run in checks:
        try:
            rows = write_cut(run().select(F.col("key").cast("string").alias("key"), F.col("detail").cast("string").alias("detail")), "audit")
            done.append((tier, name, rows))
        except Exception as e:  # noqa: BLE001  any failure of a check is a finding
            text = f"{type(e).__name__}: {e}".splitlines()[0][:200]
            done.append((1, name, spark.createDataFrame([(None, text)], "key string, detail string")))
    return audit(done)


def fee_checks(royalty: str = "royalty_pct", marketing: str = "marketing_fee_pct", ranges: Sequence[tuple[str, str, str]] = ()) -> list:
    """Percentages outside 0 to 25 and 0 to 15, and ranges (name, low, high)
    whose low end is above the high one."""
    out = [("fail", f"{c}_bounds", ~F.col(c).between(0, top), F.col(c)) for c, top in ((royalty, 25), (marketing, 15))]
    return out + [("fail", f"{n}_low_gt_high", F.col(lo) > F.col(hi), F.concat_ws(" > ", lo, hi)) for n, lo, hi in ranges]


def suppressed(df: DataFrame, value: str, high: str, note: str, notes: str = "notes") -> DataFrame:
    """Values above their own maximum become null, and the note says which;
    notes that are there stay before it."""
    bad = F.coalesce(F.col(value) > F.col(high), F.lit(False))
    text = F.concat(F.lit(note), F.lit(": "), F.col(value).cast("string"), F.lit(" > "), F.col(high).cast("string"))
    said = F.when(F.coalesce(F.col(notes), F.lit("")) == "", text).otherwise(F.concat_ws(" | ", F.col(notes), text))
    return df.withColumns({notes: F.when(bad, said).otherwise(F.col(notes)), value: F.when(~bad, F.col(value))}).select(*df.columns)


def flags_from_records(df: DataFrame, key: str, flag: str, records: DataFrame, fk: str) -> DataFrame:
    """Rows whose flag says otherwise than their records: key, was, now; a null
    flag counts as false."""
    has = records.select(F.col(fk).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn("__has", F.lit(True))
    j = df.select(key, F.coalesce(flag, F.lit(False)).alias("was")).join(has, key, "left").withColumn("now", F.coalesce("__has", F.lit(False)))
    return j.filter(F.col("was") != F.col("now")).select(key, "was", "now")


def missing_parts(found: DataFrame, key: str, part: str, size: str, expected: Sequence[str], least: int = 5) -> DataFrame:
    """key, part, reason of each expected part that a key lacks (missing) or
    that is smaller than ``least`` (empty); of several the largest counts."""
    got = found.groupBy(key, part).agg(F.max(size).alias("__s"))
    want = found.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, expected))).alias(part))
    reason = F.when(F.col("__s").isNull(), "missing").when(F.col("__s") < least, "empty")
    return want.join(got, [key, part], "left").select(key, part, reason.alias("reason")).filter(F.col("reason").isNotNull())


def gate(found: DataFrame, key: str, item: str, must: Sequence[int] = (5, 6, 7), any_of: Sequence[int] = (19, 20), some: int = 2) -> DataFrame:
    """key, n_found, bucket: whole if all of ``must`` and one of ``any_of`` are
    there, partial from ``some`` on, else none."""
    has = lambda i: F.max(F.when(F.col(item) == i, 1).otherwise(0))
    g = found.groupBy(key).agg(
        F.count_distinct(F.when(F.col(item).isin(*must, *any_of), F.col(item))).alias("n_found"),
        F.least(*[has(i) for i in must]).alias("__must"),
        F.greatest(*[has(i) for i in any_of]).alias("__any"),
    )
    whole = (F.col("__must") == 1) & (F.col("__any") == 1)
    return g.select(key, "n_found", F.when(whole, "whole").when(F.col("n_found") >= some, "partial").otherwise("none").alias("bucket"))


def low_confidence(df: DataFrame, key: str, conf: str, below: float = 0.7, least: int = 3) -> DataFrame:
    """key, n_low, mean of keys with at least ``least`` rows below a confidence
    (a null one counts as zero)."""
    c = F.coalesce(conf, F.lit(0.0))
    g = df.groupBy(key).agg(F.count_if(c < below).alias("n_low"), F.avg(c).alias("mean"))
    return g.filter(F.col("n_low") >= least)


def hash_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows that are the same at every run: those with the smallest hash of
    all their columns, of equal hashes those first in text order."""
    whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.orderBy(F.xxhash64(F.lit(seed), whole), whole).limit(n)


def quality_score(parts: Sequence[tuple[int, Column]]) -> Column:
    """The sum of the weights of the tests that hold."""
    out = F.lit(0)
    for weight, test in parts:
        out = out + F.when(test, weight).otherwise(0)
    return out

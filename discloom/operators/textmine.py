"""Facts found in running text: names, dates, phrases, headings to trim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloom.functions.cols import any_date

_FORM = r"(?:LLC|L\.L\.C\.|Inc\.?|Incorporated|Corp\.?|Corporation|Company|Co\.|L\.P\.|LP|Ltd\.?)"
_NAME = rf"([A-Z][A-Za-z0-9&'’.,\- ]{{2,110}}?,?\s+{_FORM})"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def company_in_text(c: Column, header: str = r"(?i)disclosure document", near: int = 1200) -> Column:
    """The first name of a company: on a line of its own after a header, else
    within ``near`` characters of it, else on any line."""
    at = F.regexp_instr(c, F.lit(header))
    after = F.when(at > 0, F.substring(c, at, F.length(c)))
    own_line = F.regexp_extract(after, rf"(?m)^\s*{_NAME}\s*$", 1)
    inline = F.regexp_extract(F.substring(after, 1, near), _NAME, 1)
    anywhere = F.regexp_extract(c, rf"(?m)^\s*{_NAME}\s*$", 1)
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (own_line, inline, anywhere)])


def plausible_company(c: Column, phrases: Sequence[str], not_first: Sequence[str]) -> Column:
    """Whether a text can be a company's name: 4 to 120 characters, without
    the phrases, not an article with a lower-case word, not led by a state."""
    low = F.lower(c)
    bad = F.lit(False)
    for p in phrases:
        bad = bad | low.contains(p)
    return F.coalesce(
        F.length(c).between(4, 120) & ~bad & ~c.rlike(r"^(?:[Tt]he|[Aa]n?)\s+[a-z]") & ~F.get(F.split(low, " "), F.lit(0)).isin(*not_first), F.lit(False)
    )


def date_in_text(c: Column, words: str = r"issuance date|issued|effective date|effective", near: int = 1500) -> Column:
    """The date after one of the words, in months, slashes or ISO; else the
    first date in the first characters."""
    month, slash, iso = rf"(?:{_MONTHS})\s+\d{{1,2}},\s*\d{{4}}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{2}-\d{2}"
    found = [F.regexp_extract(c, rf"(?i)(?:{words})\s*(?:of|on|is|:)?\s*[:\-]?\s*({p})", 1) for p in (month, slash, iso)]
    found += [F.regexp_extract(F.substring(c, 1, near), f"({p})", 1) for p in (month, slash, iso)]
    return F.coalesce(*[any_date(F.nullif(x, F.lit(""))) for x in found])


def phrase_hits(df: DataFrame, key: str, text: str, patterns: Sequence[str], around: int = 60) -> DataFrame:
    """key, pattern_no, context of the first hit of each pattern."""
    hits = []
    for i, p in enumerate(patterns):
        at = F.regexp_instr(text, F.lit(p))
        start = F.greatest(at - around, F.lit(1))
        hits.append(F.when(at > 0, F.struct(F.lit(i).alias("pattern_no"), F.substring(F.col(text), start, F.lit(2 * around)).alias("context"))))
    return df.select(key, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "h.*")


def has_phrase(c: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase stands in a text, case aside; null texts have none."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.lower(c).contains(p)
    return F.coalesce(out, F.lit(False))


def without_common_prefix(labels: Column, least: int = 30, tail: int = 8) -> Column:
    """Labels without the words they all begin with, if these are long and
    something is left of each."""
    first, last = F.array_min(labels), F.array_max(labels)
    n = F.length(first)
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda a, i: F.when((a == i - 1) & (F.substring(first, i, F.lit(1)) == F.substring(last, i, F.lit(1))), i).otherwise(a),
    )
    word = F.length(F.regexp_extract(F.substring(first, F.lit(1), same), r"^(.*\s)", 1))
    short = F.array_min(F.transform(labels, F.length))
    ok = (F.size(labels) > 1) & (word >= least) & (short - word >= tail)
    return F.when(ok, F.transform(labels, lambda x: F.substring(x, word + 1, F.length(x)))).otherwise(labels)


def freshness_tier(c: Column) -> Column:
    """current, aging or stale of "5 mo old", "2 yr old"."""
    n = F.regexp_extract(c, r"(\d+)\s*(?:mo|yr)", 1).try_cast("int")
    months = F.when(c.rlike(r"\d+\s*yr"), n * 12).otherwise(n)
    return F.when(months <= 6, "current").when(months <= 12, "aging").when(months.isNotNull(), "stale")


def latest_active(df: DataFrame, key: str, status: str, date: str, active: str = "registered", legacy: bool = False) -> DataFrame:
    """The active row with the latest date of each key.  ``legacy`` compares
    dates as the text they are, which is wrong across months."""
    from discloom.operators.latest import latest

    own = df.filter(F.lower(F.trim(status)) == active).withColumn("__d", F.col(date) if legacy else any_date(F.col(date)))
    return latest(own, [key], ["__d", date, *[c for c in df.columns if c != date]]).drop("__d")


def non_unit_metric(scope: Column, words: Column, patterns: Sequence[str]) -> Column:
    """Whether a figure is of a market or a single sale rather than of a unit:
    the scope if it is given, else the words."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | words.rlike(p)
    return F.when(scope.isin("market-area", "ramp-snapshot"), True).when(scope == "franchisee", False).otherwise(F.coalesce(hit, F.lit(False)))


def disambiguated(df: DataFrame, group: Sequence[str], label: str, period: str, most: int = 130, name: str = "label") -> DataFrame:
    """Labels that stand more than once in a group get their period behind
    them, its year if it has one; longer ones end in an ellipsis."""
    n = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("__n"))
    year = F.nullif(F.regexp_extract(period, r"\b(20\d{2})\b", 1), F.lit(""))
    said = F.nullif(F.col(period), F.lit(""))
    full = F.when((F.col("__n") > 1) & said.isNotNull(), F.concat(F.col(label), F.lit(" ("), F.coalesce(year, said), F.lit(")"))).otherwise(F.col(label))
    cut = F.when(F.length(full) > most, F.concat(F.substring(full, 1, most - 3), F.lit("…"))).otherwise(full)
    return df.join(n, [*group, label]).withColumn(name, cut).drop("__n")


def indicated(c: Column, need: str, skip: str) -> Column:
    """Whether a name has the wanted pattern and not the unwanted one."""
    return F.coalesce(c.rlike(need) & ~c.rlike(skip), F.lit(False))


def chartable(metric: Column, value: Column, words: Column, metrics: Sequence[str]) -> Column:
    """Whether a figure is a currency metric with a value and not of one
    numbered month."""
    return F.coalesce(metric.isin(*metrics) & value.isNotNull() & ~F.lower(F.coalesce(words, F.lit(""))).rlike(r"month\s*\d+"), F.lit(False))

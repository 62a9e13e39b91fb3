"""Amounts recorded per different periods and in different dollar scales.

Everything is SQL over columns: the words of a row are searched for a period
and a scale, the spelling found is normalised by a join with an alias table
(a few dozen rows, built here, so its broadcast is bounded by the code), the
period is ``coalesce(words, unit field, source default)``, and the amount is
``value * per_year * scale + offset``.  One narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of a period and how many of it make a year.
PERIODS: dict[int, tuple[str, ...]] = {
    365: ("day", "daily", "days", "per diem", "night"),
    52: ("week", "weekly", "wk", "wkly", "p.w.", "awus", "aws", "w/e"),
    26: ("two weeks", "two-week", "2 weeks", "2-week", "bi-weekly", "biweekly", "bi weekly", "bi-wkly", "fortnight", "fortnightly"),
    13: (
        "4-week", "4 week", "4 weeks", "4-wk", "4 wk", "four-week", "four week", "four weeks", "28-day", "28 days", "28 day",
    ),
    12: ("month", "monthly", "mo", "mthly", "mth", "mnthly"),
    4: ("quarter", "quarterly", "qtr", "qtrly", "three months", "3 months", "three-month", "3-month"),
    2: (
        "half-year", "half year", "half-yearly", "half yearly", "six months", "six-month", "six month", "6 months", "6-month",
        "semi-annual", "semi annual", "semiannual", "semi-annually", "bi-annual",
    ),
    1: (
        "annual", "annually", "annualized", "annualised", "year", "yearly", "yr", "full-year", "full year", "12 months", "12-month",
        "twelve months", "twelve-month", "52 weeks", "52-week", "53 weeks", "every day of the year", "365 days",
    ),
}
# Spellings of a dollar scale.
SCALES: dict[int, tuple[str, ...]] = {
    1000: (
        "thousand", "thousands", "$000", "$000s", "$000's", "'000", "'000s", "000s", "000's", "000 omitted", "$k", "k$", "usd k", "three zeros", "$ 000",
    ),
    1000000: (
        "million", "millions", "$mm", "usd mm", "$m", "mm", "us$ m", "usd m", "six zeros", "000,000 omitted", "$ mm",
    ),
}
# Words on where figures come from; they say nothing about the amount.
SOURCE_WORDS = (
    r"compiled from [a-z0-9-]+ (?:[a-z]+ )?reports|"
    r"(?:daily|weekly|bi-weekly|monthly|quarterly) (?:[a-z]+ )?reports|"
    r"reports sent in (?:each|every) [a-z]+|"
    r"(?:each|all) days? open|all days open|open (?:since|for|at least)[^,;.|)]*|"
    r"months?\s*\d+"
)
MONEY_METRICS = ("gross_sales", "total_revenue", "gross_profit", "net_profit", "ebitda")


def _escape(s: str) -> str:
    return "".join("\\" + c if c in r".$()[]{}*+?^|\/" else c for c in s)


def pattern(groups: dict[int, Sequence[str]]) -> str:
    """One alternation of all spellings, longest first, in group 2; works in
    Java and RE2 alike."""
    words = sorted((a for g in groups.values() for a in g), key=lambda a: (-len(a), a))
    return "(^|[^a-z0-9$'])(" + "|".join(map(_escape, words)) + ")([^a-z0-9]|$)"


def aliases(spark: SparkSession, groups: dict[int, Sequence[str]], value: str) -> DataFrame:
    """The alias table: alias string, ``value`` int."""
    return spark.createDataFrame([(a, k) for k, g in groups.items() for a in g], f"alias string, {value} int")


def _words(columns: Sequence[str]) -> Column:
    """The row's words in lower case, source words taken out."""
    text = F.lower(F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]))
    return F.regexp_replace(text, SOURCE_WORDS, " ")


def to_common_units(
    df: DataFrame,
    value: str = "value_median",
    words: Sequence[str] = ("metric_raw", "raw_text", "notes"),
    unit: str = "unit_period",
    default_per_year: int = 1,
    default_scale: int = 1,
    offset: float = 0.0,
    figure: str | None = None,
    source: str | None = None,
    source_defaults: DataFrame | None = None,
) -> DataFrame:
    """Add ``per_year``, ``scale`` and ``value_usd_year``.

    The row's words come before the unit field, that before the default of the
    source (``source_defaults``: the column ``source``, once each, per_year,
    scale), that before the two defaults.  With ``figure`` a null value is read
    from the last number in that text.  Nulls anywhere fall through to the next rule; a null value stays
    null.  Unknown spellings of the unit field count as not given.  Columns
    called like the three results are replaced; others pass through.
    """
    spark = df.sparkSession
    src = df.drop("per_year", "scale", "value_usd_year").withColumn("__w", _words(words))
    u = F.lower(F.trim(F.col(unit)))
    src = src.withColumns(
        {
            "__tp": F.regexp_extract("__w", pattern(PERIODS), 2),
            "__ts": F.regexp_extract("__w", pattern(SCALES), 2),
            "__up": F.regexp_extract(u, pattern(PERIODS), 2),
            "__us": F.regexp_extract(u, pattern(SCALES), 2),
        }
    )
    for at, groups in (("__tp", PERIODS), ("__up", PERIODS), ("__ts", SCALES), ("__us", SCALES)):
        dim = aliases(spark, groups, f"{at}v").withColumnRenamed("alias", f"{at}a")
        src = src.join(F.broadcast(dim), F.col(at) == F.col(f"{at}a"), "left").drop(f"{at}a")
    src = src.withColumns({"__dp": F.lit(None).cast("int"), "__ds": F.lit(None).cast("int")})
    if source is not None and source_defaults is not None:
        own = source_defaults.select(source, F.col("per_year").alias("__dp"), F.col("scale").alias("__ds"))
        src = src.drop("__dp", "__ds").join(own, source, "left")
    amount = F.col(value).cast("double")
    return src.withColumns(
        {
            "per_year": F.coalesce("__tpv", "__upv", "__dp", F.lit(default_per_year)),
            "scale": F.coalesce("__tsv", "__usv", "__ds", F.lit(default_scale)),
        }
    ).withColumn(
        "value_usd_year", (amount if figure is None else F.coalesce(amount, last_number(F.col(figure)))) * F.col("per_year") * F.col("scale") + F.lit(offset)
    ).drop("__w", "__dp", "__ds", *[f"{a}{b}" for a in ("__tp", "__up", "__ts", "__us") for b in ("", "v")])


#: The last number of a text, with its thousands.
NUMBER = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)[^0-9]*$"


def last_number(c: Column) -> Column:
    """The last number of a text; null if there is none."""
    return F.regexp_replace(F.regexp_extract(c, NUMBER, 1), ",", "").try_cast("double")


def text_figures(df: DataFrame) -> DataFrame:
    """id, figure, is_median of every row: the number in its raw text, and
    whether that is its median."""
    x = last_number(F.col("raw_text"))
    return df.select("id", x.alias("figure"), F.coalesce(F.abs(x - F.col("value_median")) < 0.01, F.lit(False)).alias("is_median"))


def foreign_units(df: DataFrame, metrics: Sequence[str] = MONEY_METRICS) -> DataFrame:
    """p2_found: rows with money metrics and a value that is not already in
    single dollars per year, with the factors that bring it there."""
    own = df.filter(F.col("metric_name").isin(*metrics) & F.col("value_median").isNotNull()).select(
        "id", "metric_raw", "raw_text", "notes", "unit_period", "value_median"
    )
    return (
        to_common_units(own)
        .filter((F.col("per_year") != 1) | (F.col("scale") != 1))
        .select("id", "per_year", "scale")
    )


def common_units(df: DataFrame, metrics: Sequence[str] = MONEY_METRICS) -> DataFrame:
    """Every row with a money metric and its median in whole dollars a year
    (null stays null)."""
    own = df.filter(F.col("metric_name").isin(*metrics)).select(
        "id", "fdd_id", "metric_name", "metric_raw", "raw_text", "notes", "unit_period", "value_median"
    )
    return to_common_units(own).select(
        "id", "fdd_id", "metric_name", "per_year", "scale", F.round("value_usd_year").cast("bigint").alias("usd_year")
    )


def _factors_sql(where: str) -> str:
    def case(col: str, groups: dict[int, Sequence[str]], other: str) -> str:
        quote = lambda a: "'" + a.replace("'", "''") + "'"
        arms = " ".join(f"WHEN {col} IN ({', '.join(map(quote, g))}) THEN {k}" for k, g in groups.items())
        return f"CASE {arms} ELSE {other} END"

    rx = lambda g: pattern(g).replace("'", "''")
    names = ", ".join(f"'{m}'" for m in MONEY_METRICS)
    return f"""
WITH w AS (
  SELECT id, fdd_id, metric_name, value_median, lower(trim(coalesce(unit_period, ''))) AS u,
         regexp_replace(lower(concat_ws(' | ', metric_raw, raw_text, notes)), '{SOURCE_WORDS}', ' ', 'g') AS t
  FROM item19_records WHERE metric_name IN ({names}) {where}
), e AS (
  SELECT id, fdd_id, metric_name, value_median, regexp_extract(t, '{rx(PERIODS)}', 2) AS tp, regexp_extract(t, '{rx(SCALES)}', 2) AS ts,
         regexp_extract(u, '{rx(PERIODS)}', 2) AS up, regexp_extract(u, '{rx(SCALES)}', 2) AS us
  FROM w
), f AS (
  SELECT id, fdd_id, metric_name, value_median, CAST({case("tp", PERIODS, case("up", PERIODS, "1"))} AS INTEGER) AS per_year,
         CAST({case("ts", SCALES, case("us", SCALES, "1"))} AS INTEGER) AS scale
  FROM e
)
"""


def foreign_units_sql() -> str:
    """p2_found in SQL that DuckDB runs."""
    return _factors_sql("AND value_median IS NOT NULL") + "SELECT id, per_year, scale FROM f WHERE per_year <> 1 OR scale <> 1"


def common_units_sql() -> str:
    return _factors_sql("") + (
        "SELECT id, fdd_id, metric_name, per_year, scale, "
        "CAST(round(value_median * per_year * scale) AS BIGINT) AS usd_year FROM f"
    )

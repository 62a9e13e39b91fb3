"""One surviving record per group of duplicate records, field by field.

Currency reasoning: rows with usable times are ordered by them; for the rest a
precedence between values is learnt from timed rows (value a was followed by
value b more often than the other way round) and closed over the values between,
which gives a partial order per group, and the topologically latest value is
taken.

Each group is aggregated (max of a comparable key), never collected, so a
group of any size is combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from discloom.session import write_cut

FIELDS = ("effective_date", "has_item19", "page_count")
YEARS = (2000, 2030)


def usable_time(c: Column) -> Column:
    """The time if it lies in the years that can be true, else null."""
    return F.when(F.year(c).between(*YEARS), c)


def true_year(year: Column, path: Column) -> Column:
    """A year in 2000-2030, a two-digit year of that century, else the
    four-digit year that stands in the path."""
    in_path = F.regexp_extract(path, r"(?:^|[^0-9])(20[0-3][0-9])(?:[^0-9]|$)", 1).try_cast("int")
    return F.when(year.between(*YEARS), year).when(year.between(1, 99), year + 2000).otherwise(in_path)


def usable_value(field: str) -> Column:
    c = F.col(field)
    if field.endswith("_date"):
        return c.isNotNull() & F.year(c).between(*YEARS)
    if field.endswith("_count"):
        return c > 0
    return c.isNotNull()


def groups(df: DataFrame) -> DataFrame:
    """Add ``year`` (true year); rows without an entity or a year that can be
    told belong to no group and are left out."""
    y = true_year(F.col("filing_year"), F.col("local_path"))
    return df.withColumn("year", y).filter(F.col("franchisor_id").isNotNull() & F.col("year").isNotNull())


def _later() -> Column:
    """Comparable key: rows parsed last come first, rows without a usable time
    after all with one, then the later fetch, then the smaller id."""
    parsed = usable_time(F.col("parsed_at"))
    return F.struct(
        parsed.isNotNull().alias("timed"),
        F.coalesce(parsed.cast("timestamp"), F.lit(0).cast("timestamp")).alias("parsed"),
        F.col("retrieved_at").isNotNull().alias("fetched"),
        F.coalesce(F.col("retrieved_at").cast("timestamp"), F.lit(0).cast("timestamp")).alias("at"),
        (-F.col("id")).alias("small"),
    )


def survivors(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """p6_found: group_id, field, from_id for each group of two or more rows.

    A field without a usable value has no row.  A row repeated in full under
    one id counts as one.  Order among rows as in the module's text; columns
    that are not named are not read.
    """
    own = groups(df.select("id", "franchisor_id", "filing_year", "local_path", "parsed_at", "retrieved_at", *fields)).dropDuplicates(["id"])
    key = _later()
    per = own.groupBy("franchisor_id", "year").agg(
        F.min("id").alias("group_id"),
        F.count(F.lit(1)).alias("n"),
        *[F.max(F.when(usable_value(f), key)).alias(f"__{f}") for f in fields],
    ).filter(F.col("n") > 1)
    kept = F.array(*[F.struct(F.lit(f).alias("field"), (-F.col(f"__{f}")["small"]).alias("from_id")) for f in fields])
    return (
        per.select("group_id", F.explode(kept).alias("x"))
        .select("group_id", "x.field", "x.from_id")
        .filter(F.col("from_id").isNotNull())
    )


def survivors_sql(fields: Sequence[str] = FIELDS) -> str:
    test = {"effective_date": "effective_date IS NOT NULL AND year(effective_date) BETWEEN 2000 AND 2030",
            "has_item19": "has_item19 IS NOT NULL", "page_count": "page_count > 0"}
    one = """
SELECT g.group_id, '{f}' AS field, r.id AS from_id FROM g JOIN (
  SELECT *, row_number() OVER (PARTITION BY franchisor_id, yr ORDER BY
    CASE WHEN year(parsed_at) BETWEEN 2000 AND 2030 THEN parsed_at END DESC NULLS LAST, retrieved_at DESC NULLS LAST, id) AS rn
  FROM r WHERE {t}) r ON r.franchisor_id = g.franchisor_id AND r.yr = g.yr AND r.rn = 1"""
    return """
WITH r AS (
  SELECT DISTINCT ON (id) *, CASE WHEN filing_year BETWEEN 2000 AND 2030 THEN filing_year WHEN filing_year BETWEEN 1 AND 99 THEN filing_year + 2000
    ELSE TRY_CAST(regexp_extract(local_path, '(?:^|[^0-9])(20[0-3][0-9])(?:[^0-9]|$)', 1) AS INTEGER) END AS yr
  FROM fdds WHERE franchisor_id IS NOT NULL
), g AS (SELECT franchisor_id, yr, min(id) AS group_id FROM r WHERE yr IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
""" + " UNION ALL ".join(one.format(f=f, t=test[f]) for f in fields)


def learned_precedence(df: DataFrame, field: str) -> DataFrame:
    """older, newer, n: value transitions between neighbouring timed rows of a
    group that were seen more often in this direction than in the other."""
    own = groups(df).filter(usable_time(F.col("parsed_at")).isNotNull() & usable_value(field))
    w = W.partitionBy("franchisor_id", "year").orderBy("parsed_at", "retrieved_at", "id")
    seen = (
        own.select(F.lag(F.col(field).cast("string")).over(w).alias("older"), F.col(field).cast("string").alias("newer"))
        .filter(F.col("older") != F.col("newer"))
        .groupBy("older", "newer")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    back = seen.select(F.col("older").alias("newer"), F.col("newer").alias("older"), F.col("n").alias("m"))
    return seen.join(back, ["older", "newer"], "left").filter(F.col("n") > F.coalesce("m", F.lit(0))).select("older", "newer", "n")


def transitive(rules: DataFrame) -> DataFrame:
    """older, newer of all pairs that rules lead from one to the other, however
    many lie between; values that lead to each other are not ordered.

    Every round doubles the length of the ways, until none is new.
    """
    reach, n = write_cut(rules.select("older", "newer").distinct(), "precedence"), -1
    while (m := reach.count()) != n:
        n = m
        far = reach.select(F.col("older"), F.col("newer").alias("mid")).join(reach.select(F.col("older").alias("mid"), "newer"), "mid").select("older", "newer")
        reach = write_cut(reach.unionByName(far).distinct(), "precedence")
    back = reach.select(F.col("newer").alias("older"), F.col("older").alias("newer"))
    return reach.join(back, ["older", "newer"], "left_anti")


def untimed_latest(df: DataFrame, field: str = "filing_state") -> DataFrame:
    """group_id, field, latest, n_values, n_latest for groups with no usable
    time at all: values from which the learnt order leads to no other value of
    their group, also by way of values the group does not have.

    The partial order may leave several; the smallest in text order is taken
    and ``n_latest`` tells how many there were (all, if nothing is known).
    """
    own = groups(df)
    timed = F.max(usable_time(F.col("parsed_at")))
    loose = own.groupBy("franchisor_id", "year").agg(timed.alias("t"), F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    loose = loose.filter(F.col("t").isNull() & (F.col("n") > 1)).select("franchisor_id", "year", "group_id")
    values = write_cut(
        own.filter(usable_value(field)).join(loose, ["franchisor_id", "year"]).select("group_id", F.col(field).cast("string").alias("value")).distinct(), "untimed"
    )
    order = transitive(learned_precedence(df, field))
    older = (
        values.join(order, values["value"] == order["older"])
        .join(values.select("group_id", F.col("value").alias("newer")), ["group_id", "newer"], "left_semi")
        .select("group_id", "value")
        .distinct()
        .withColumn("old", F.lit(True))
    )
    marked = values.join(older, ["group_id", "value"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
    return marked.groupBy("group_id").agg(
        F.lit(field).alias("field"),
        F.min(F.when(~F.col("old"), F.col("value"))).alias("latest"),
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(~F.col("old")).alias("n_latest"),
    )


#: Fields whose values follow one another in an order that can be learnt.
ORDERED = ("filing_state", "has_item19", "has_item20")


def untimed_survivors(df: DataFrame, fields: Sequence[str] = ORDERED) -> DataFrame:
    """:func:`untimed_latest` of several fields."""
    out = None
    for f in fields:
        one = untimed_latest(df, f)
        out = one if out is None else out.unionByName(one)
    return out


def untimed_sql(fields: Sequence[str] = ORDERED) -> str:
    one = """
SELECT * FROM (WITH RECURSIVE o AS (SELECT *, CAST({f} AS VARCHAR) AS v FROM r WHERE {f} IS NOT NULL),
t AS (SELECT lag(v) OVER (PARTITION BY franchisor_id, yr ORDER BY parsed_at, retrieved_at, id) AS a, v AS b FROM o WHERE year(parsed_at) BETWEEN 2000 AND 2030),
c AS (SELECT a, b, count(*) AS n FROM t WHERE a <> b GROUP BY ALL),
u AS (SELECT c.a, c.b FROM c LEFT JOIN c d ON d.a = c.b AND d.b = c.a WHERE c.n > coalesce(d.n, 0)),
w AS (SELECT a, b FROM u UNION SELECT w.a, u.b FROM w JOIN u ON u.a = w.b),
p AS (SELECT a, b FROM w WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.a = w.b AND x.b = w.a)),
l AS (SELECT franchisor_id, yr, min(id) AS group_id FROM r GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (WHERE year(parsed_at) BETWEEN 2000 AND 2030) = 0),
z AS (SELECT DISTINCT l.group_id, o.v FROM o JOIN l USING (franchisor_id, yr)),
m AS (SELECT z.*, EXISTS (SELECT 1 FROM p JOIN z y ON y.v = p.b WHERE p.a = z.v AND y.group_id = z.group_id) AS old FROM z)
SELECT group_id, '{f}' AS field, min(v) FILTER (WHERE NOT old) AS latest, count(*) AS n_values, count(*) FILTER (WHERE NOT old) AS n_latest FROM m GROUP BY 1)"""
    return """
WITH r AS (SELECT * FROM (SELECT *, CASE WHEN filing_year BETWEEN 2000 AND 2030 THEN filing_year WHEN filing_year BETWEEN 1 AND 99 THEN filing_year + 2000
    ELSE TRY_CAST(regexp_extract(local_path, '(?:^|[^0-9])(20[0-3][0-9])(?:[^0-9]|$)', 1) AS INTEGER) END AS yr FROM fdds WHERE franchisor_id IS NOT NULL) WHERE yr IS NOT NULL)
""" + " UNION ALL ".join(one.format(f=f) for f in fields)

"""Named queries over the relational operators, each with its SQL counterpart.

Every query reads its whole tables.  Money is summed as decimals, so sums do
not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from discloom.functions import cols as C
from discloom.operators import entity, filters, growth, latest, relate, stats, validate
from discloom.plans.registry import Registry
from discloom.session import table
from discloom.sources import files, sinks
from discloom.streaming import jobs

_R = Registry()
QUERIES, ORACLE, query = _R.queries, _R.oracle, _R.query


def money_sum(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def year_of(c: str) -> Column:
    return F.year(c).cast("int")


# ------------------------------------------------------- latest rows, joins


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def q_latest_filing(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return latest.latest(o, ["o_custkey"], ["o_orderkey"])


@query("""SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey DESC) = 1""")
def q_latest_by_year_policy(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", year_of("o_orderdate").alias("y"))
    return latest.latest(o, ["o_custkey"], ["y", "o_orderkey"])


@query("""WITH x AS (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
          SELECT o_custkey, o_orderkey, y FROM x JOIN (SELECT o_custkey, max(y) AS y FROM x GROUP BY 1) USING (o_custkey, y)""")
def q_latest_year_rows(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", year_of("o_orderdate").alias("y"))
    return latest.latest_year_rows(o, ["o_custkey"], "y")


@query("""WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
          SELECT c_mktsegment, count(*) AS n, median(o_totalprice) AS median_price
          FROM l JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def q_category_median(s, d):
    o = latest.latest(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return stats.median(o.join(c, "o_custkey"), ["c_mktsegment"], "o_totalprice", "median_price")


@query("""WITH x AS (SELECT p_partkey, p_retailprice, lower(replace(p_type, ' ', '-')) AS leaf FROM part),
          y AS (SELECT leaf, p_retailprice FROM x UNION ALL SELECT 'standard', p_retailprice FROM x WHERE starts_with(leaf, 'standard-'))
          SELECT leaf, count(*) AS n, median(p_retailprice) AS median_price FROM y GROUP BY 1""")
def q_parent_rollup(s, d):
    p = table(s, d, "part").select("p_retailprice", F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("leaf"))
    return stats.median(stats.with_parents(p, "leaf", "standard"), ["leaf"], "p_retailprice", "median_price")


@query("""WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
          t AS (SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, max(o_totalprice) AS top FROM orders GROUP BY 1),
          i AS (SELECT o_custkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
          SELECT c_custkey, c_name, c_mktsegment, o_orderkey AS last_order, o_totalprice AS last_price,
                 coalesce(n_orders, 0) AS n_orders, spent, top, coalesce(n_lines, 0) AS n_lines, coalesce(n_parts, 0) AS n_parts
          FROM customer LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN i ON i.o_custkey = c_custkey""")
def q_summary_wide(s, d):
    c, o = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    agg = o.groupBy("c_custkey").agg(
        F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("x"),
        F.count(F.lit(1)).alias("n_orders"),
        money_sum("o_totalprice").alias("spent"),
        F.max("o_totalprice").alias("top"),
    )
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(o.select("o_orderkey", "c_custkey"), "o_orderkey")
    i = li.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return c.join(agg, "c_custkey", "left").join(i, "c_custkey", "left").select(
        "c_custkey", "c_name", "c_mktsegment", F.col("x.o_orderkey").alias("last_order"), F.col("x.o_totalprice").alias("last_price"),
        zero("n_orders"), "spent", "top", zero("n_lines"), zero("n_parts"),
    )


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def q_left_join_on_predicate(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    c = table(s, d, "customer").select("c_custkey")
    return c.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def q_eligible_semi(s, d):
    o = table(s, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return relate.semi(table(s, d, "customer").select("c_custkey"), o, ["c_custkey"])


@query("SELECT s_suppkey FROM supplier WHERE lower(trim(s_name)) NOT IN (SELECT lower(trim(c_name)) FROM customer)")
def q_untried_anti(s, d):
    return relate.untried(table(s, d, "supplier"), table(s, d, "customer"), "s_name", "c_name").select("s_suppkey")


@query("""WITH a AS (SELECT DISTINCT regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g') AS key FROM franchisors),
          b AS (SELECT DISTINCT regexp_replace(lower(trade_name), '[^a-z0-9]+', '', 'g') AS key FROM wi_filings)
          SELECT a.key AS a_key, b.key AS b_key, CASE WHEN a.key = b.key THEN 'equal' WHEN contains(a.key, b.key) THEN 'contains' ELSE 'contained' END AS how
          FROM a, b WHERE a.key <> '' AND b.key <> '' AND (a.key = b.key OR (length(b.key) >= 5 AND contains(a.key, b.key)) OR (length(a.key) >= 5 AND contains(b.key, a.key)))""")
def q_fuzzy_contains(s, d):
    a = table(s, d, "franchisors").select(C.compact_key(F.col("brand_name")).alias("key"))
    b = table(s, d, "wi_filings").select(C.compact_key(F.col("trade_name")).alias("key"))
    return relate.contains_pairs(a, b, 5)


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer),
          v AS (SELECT c_mktsegment, c_acctbal, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_acctbal ORDER BY c_custkey) AS j,
                dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS dr FROM c),
          p AS (SELECT a.c_custkey, b.c_custkey AS peer, row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.c_acctbal DESC, b.c_custkey) AS rank
                FROM v a JOIN v b ON a.c_mktsegment = b.c_mktsegment AND b.dr BETWEEN a.dr - 3 AND a.dr - 1)
          SELECT c_custkey, peer, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 3""")
def q_similar_cheaper(s, d):
    return relate.lesser_peers(table(s, d, "customer"), "c_custkey", "c_mktsegment", "c_acctbal", 3)


@query("""WITH t AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS r FROM customer)
          SELECT a.c_custkey, b.c_custkey AS peer, CAST(row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.r) AS INTEGER) AS rank
          FROM t a JOIN t b ON a.c_mktsegment = b.c_mktsegment AND b.r <= 5 AND a.c_custkey <> b.c_custkey
          QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.r) <= 4""")
def q_peers_topk(s, d):
    return relate.ring_peers(table(s, d, "customer"), "c_custkey", "c_mktsegment", "c_acctbal", 4)


@query("""SELECT c_mktsegment, a.s_suppkey AS key_a, b.s_suppkey AS key_b FROM
          (SELECT s_suppkey, n_name AS c_mktsegment FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0) a JOIN
          (SELECT s_suppkey, n_name AS c_mktsegment FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0) b USING (c_mktsegment)
          WHERE a.s_suppkey < b.s_suppkey""")
def q_pairs(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("c_mktsegment"))
    x = table(s, d, "supplier").join(n, "s_nationkey")
    return relate.unordered_pairs(x, "s_suppkey", "c_mktsegment", F.col("s_acctbal") > 0)


@query("""WITH x AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer)
          SELECT a.c_custkey, a.n - 1 AS n_peers, b.m AS peer_median FROM
          (SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM x) a
          LEFT JOIN (SELECT p.c_custkey, median(q.v) AS m FROM x p JOIN x q ON p.c_mktsegment = q.c_mktsegment AND p.c_custkey <> q.c_custkey GROUP BY 1) b USING (c_custkey)""")
def q_peer_medians(s, d):
    return relate.other_medians(table(s, d, "customer"), "c_custkey", "c_mktsegment", "c_acctbal")


@query("""SELECT DISTINCT ON (key) key, how FROM (
          SELECT d.pdf_sha256 AS key, CASE WHEN m.guid IS NOT NULL THEN 'guid' WHEN f.slug IS NOT NULL THEN 'slug' END AS how
          FROM fdds d LEFT JOIN (SELECT DISTINCT guid FROM mn_filings) m ON m.guid = d.pdf_sha256
          LEFT JOIN franchisors f ON f.id = d.franchisor_id)""")
def q_tiered_match(s, d):
    t1 = table(s, d, "mn_filings").select(F.col("guid").alias("key"), F.col("guid").alias("value")).dropDuplicates(["key"])
    t2 = table(s, d, "franchisors").select(F.col("id").cast("string").alias("key"), F.col("slug").alias("value"))
    x = relate.first_match(table(s, d, "fdds").select("pdf_sha256", "franchisor_id"), "m", [("guid", t1), ("slug", t2)], [F.col("pdf_sha256"), F.col("franchisor_id").cast("string")])
    return x.select(F.col("pdf_sha256").alias("key"), F.col("m_by").alias("how"))


# -------------------------------------------------- aggregates, statistics


@query("""SELECT o_custkey, CAST(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS DOUBLE) AS top_f,
          count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1""")
def q_conditional_agg(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("top_f"),
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
        F.countDistinct("o_orderpriority").alias("priorities"),
    )


_PIVOT = """SELECT fdd_id, year, CAST(max(outlets_end) FILTER (WHERE outlet_type = 'franchised') AS INTEGER) AS franchised,
          CAST(max(outlets_end) FILTER (WHERE outlet_type = 'company-owned') AS INTEGER) AS company_owned, CAST(max(outlets_end) FILTER (WHERE outlet_type = 'total') AS INTEGER) AS total
          FROM item20_locations GROUP BY 1, 2"""


@query(_PIVOT)
def q_pivot_types(s, d):
    i = table(s, d, "item20_locations").select("fdd_id", "year", "outlet_type", "outlets_end")
    p = i.groupBy("fdd_id", "year").pivot("outlet_type", ["franchised", "company-owned", "total"]).agg(F.max("outlets_end"))
    return p.withColumnRenamed("company-owned", "company_owned")


@query(f"""SELECT fdd_id, year, coalesce(franchised, greatest(0, total - company_owned)) AS franchised,
          coalesce(company_owned, greatest(0, total - franchised)) AS company_owned, coalesce(total, franchised + company_owned) AS total
          FROM ({_PIVOT}) WHERE CAST(total IS NULL AS INT) + CAST(franchised IS NULL AS INT) + CAST(company_owned IS NULL AS INT) <= 1""")
def q_missing_cell(s, d):
    p = q_pivot_types(s, d)
    gaps = sum((F.col(c).isNull().cast("int") for c in ("franchised", "company_owned")), F.col("total").isNull().cast("int"))
    return growth.missing_cells(p.filter(gaps <= 1), "franchised", "company_owned", "total")


@query("""SELECT o_orderstatus, count(*) AS n, (list(o_totalprice ORDER BY o_totalprice))[count(*) // 2 + 1] AS upper_median FROM orders GROUP BY 1""")
def q_upper_median(s, d):
    return stats.upper_median(table(s, d, "orders"), ["o_orderstatus"], "o_totalprice")


@query("""SELECT o_custkey, count(*) AS n, """ + ", ".join(f"(list(o_totalprice ORDER BY o_totalprice))[CAST(round_even((count(*) - 1) * {p} / 100.0, 0) AS BIGINT) + 1] AS p{p}" for p in (25, 50, 75)) + """
          FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def q_nearest_rank(s, d):
    return stats.nearest_rank(table(s, d, "orders"), ["o_custkey"], "o_totalprice", (25, 50, 75))


@query("""SELECT c_mktsegment, count(*) AS n, """ + ", ".join(f"(list(c_acctbal ORDER BY c_acctbal))[least(count(*) * {i} // 5, count(*) - 1) + 1] AS cut{i}" for i in range(1, 5)) + """
          FROM customer GROUP BY 1""")
def q_quintile_bucket(s, d):
    return stats.quintile_cuts(table(s, d, "customer"), ["c_mktsegment"], "c_acctbal")


# Bounds of the investment bins.
BINS = (0, 100_000, 250_000, 500_000, 1_000_000, 5_000_000, 10**12)


@query("""WITH b AS (SELECT unnest(range(6)) AS bin, unnest([0, 100000, 250000, 500000, 1000000, 5000000]::DOUBLE[]) AS lower, unnest([100000, 250000, 500000, 1000000, 5000000, 1000000000000]::DOUBLE[]) AS upper)
          SELECT CAST(bin AS INTEGER) AS bin, lower, upper, (SELECT count(*) FROM orders WHERE o_totalprice >= lower AND o_totalprice < upper) AS n FROM b""")
def q_histogram_bins(s, d):
    return stats.histogram(table(s, d, "orders"), "o_totalprice", BINS)


@query("""WITH c AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS pos FROM c)
          SELECT name, n, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 12 UNION ALL SELECT '(other)', CAST(sum(n) AS BIGINT), 13 FROM r WHERE pos > 12 HAVING count(*) > 0""")
def q_category_topk_other(s, d):
    return stats.top_k_other(table(s, d, "part"), "p_brand", 12)


@query("""SELECT o_custkey, first(o_orderpriority ORDER BY n DESC, f) AS mode, max(n) AS n FROM
          (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY 1""")
def q_mode_first_seen(s, d):
    return stats.mode(table(s, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def q_status_counts(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""SELECT n_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def q_state_totals(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(s, d, "customer").join(F.broadcast(n), "c_nationkey").groupBy("n_name").agg(money_sum("c_acctbal").alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name, n_name, count(*) AS n, grouping(r_name, n_name) AS level FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def q_rollup_regions(s, d):
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    x = table(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("""SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS lost, count(*) AS base,
          CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 100, 1) END AS rate_pct,
          CASE WHEN round_even(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 100, 1) <= 3 THEN 'green' WHEN round_even(count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 100, 1) <= 7 THEN 'yellow' ELSE 'red' END AS tier
          FROM lineitem GROUP BY 1""")
def q_closure_rate(s, d):
    l = table(s, d, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("r"), F.lit(1).alias("one"))
    return growth.rates(l, ["l_suppkey"], ["r"], "one").withColumn("tier", C.bands(F.col("rate_pct"), (3, 7), ("green", "yellow", "red")))


@query("""SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent,
          CAST(row_number() OVER (ORDER BY sum(CAST(o_totalprice AS DECIMAL(18,2))) DESC, o_custkey) AS BIGINT) AS position FROM orders GROUP BY 1""")
def q_rank_position(s, d):
    t = table(s, d, "orders").groupBy("o_custkey").agg(money_sum("o_totalprice").alias("spent"))
    return sinks.numbered(t.withColumn("__d", -F.col("spent")), ["__d", "o_custkey"]).drop("__d")


@query("""WITH s AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS sd FROM supplier) SELECT s_suppkey, round((s_acctbal - m) / nullif(sd, 0), 6) AS z FROM supplier, s""")
def q_z_badges(s, d):
    return stats.z_badges(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", F.round("z", 6).alias("z"))


# ------------------------------------------------------------ series, growth

_SERIES = "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2"


def series(s, d):
    return table(s, d, "orders").groupBy("o_custkey", year_of("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS ({_SERIES}), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS i FROM x)
          SELECT o_custkey, max(y) FILTER (WHERE i = 1) AS year, max(n) FILTER (WHERE i = 1) AS latest, max(n) FILTER (WHERE i = 2) AS previous,
          CASE WHEN max(n) FILTER (WHERE i = 2) > 0 THEN round_even((max(n) FILTER (WHERE i = 1) - max(n) FILTER (WHERE i = 2)) / max(n) FILTER (WHERE i = 2) * 100, 1) END AS yoy_pct
          FROM r WHERE i <= 2 GROUP BY 1""")
def q_yoy_growth(s, d):
    return growth.year_over_year(series(s, d), ["o_custkey"], "y", "n")


_FIRST_LAST = f"""SELECT o_custkey, count(*) AS points, arg_min(n, y) AS first, arg_max(n, y) AS last, CAST(max(y) - min(y) AS INTEGER) AS span FROM ({_SERIES}) GROUP BY 1
          HAVING count(*) >= 2 AND arg_min(n, y) >= 2"""


@query(f"""SELECT *, last - first AS growth_abs, round_even((last - first) / first * 100, 1) AS growth_pct FROM ({_FIRST_LAST})""")
def q_first_last_growth(s, d):
    return growth.first_last(series(s, d), ["o_custkey"], "y", "n", least_first=2)


@query(f"""SELECT o_custkey, CASE WHEN g >= 50 THEN 'rapidly-growing' WHEN g >= 10 THEN 'growing' WHEN g >= -5 THEN 'stable' ELSE 'contracting' END AS direction
          FROM (SELECT o_custkey, round_even((last - first) / first * 100, 1) AS g FROM ({_FIRST_LAST}))""")
def q_growth_direction(s, d):
    g = growth.first_last(series(s, d), ["o_custkey"], "y", "n", least_first=2)
    return g.select("o_custkey", growth.direction(F.col("growth_pct")).alias("direction"))


@query(f"""SELECT o_custkey, last - first AS growth_abs FROM ({_FIRST_LAST}) WHERE last > first""")
def q_abs_growth(s, d):
    return growth.first_last(series(s, d), ["o_custkey"], "y", "n", least_first=2).filter("growth_abs > 0").select("o_custkey", "growth_abs")


@query(f"""SELECT o_custkey, string_agg(y || ':' || n, ',' ORDER BY y) AS history FROM ({_SERIES}) GROUP BY 1""")
def q_history_array(s, d):
    h = growth.history(series(s, d), ["o_custkey"], "y", "n")
    return h.select("o_custkey", F.array_join(F.transform("history", lambda p: F.concat_ws(":", p["year"], p["n"])), ",").alias("history"))


@query(f"""WITH x AS (SELECT *, count(*) OVER w AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY y) - 1 AS i, min(n) OVER w AS lo, max(n) OVER w AS hi FROM ({_SERIES}) WINDOW w AS (PARTITION BY o_custkey))
          SELECT o_custkey, CAST(i AS INTEGER) AS i, round(CASE WHEN k > 1 THEN i / (k - 1) * 78 + 1 ELSE 1 END, 6) AS x, round(18 - coalesce((n - lo) / nullif(hi - lo, 0), 0) * 16, 6) AS y FROM x""")
def q_sparkline(s, d):
    h = growth.history(series(s, d), ["o_custkey"], "y", "n")
    p = h.select("o_custkey", F.posexplode(growth.sparkline(F.col("history"))).alias("i", "p"))
    return p.select("o_custkey", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""SELECT o_orderkey, CAST(unnest(range(11)) AS INTEGER) AS year, round(unnest(range(11)) * o_totalprice * 0.15 - o_totalprice, 4) AS balance FROM orders""")
def q_walk_forward(s, d):
    w = growth.walk_forward(table(s, d, "orders"), ["o_orderkey"], F.col("o_totalprice"), F.col("o_totalprice") * 0.15)
    return w.select("o_orderkey", "year", F.round("balance", 4).alias("balance"))


@query("""WITH c AS (SELECT fdd_id, year, state, outlets_end FROM item20_locations WHERE length(state) = 2 AND state = upper(state)),
          t AS (SELECT fdd_id, max(year) AS year FROM c GROUP BY 1),
          g AS (SELECT fdd_id, state, CAST(sum(outlets_end) AS BIGINT) AS n FROM c JOIN t USING (fdd_id, year) GROUP BY 1, 2)
          SELECT fdd_id, state, n, CAST(row_number() OVER (PARTITION BY fdd_id ORDER BY n DESC NULLS LAST, state) AS INTEGER) AS rank FROM g
          QUALIFY rank <= 10""")
def q_top_states(s, d):
    code = (F.length("state") == 2) & (F.col("state") == F.upper("state"))
    i = table(s, d, "item20_locations").select("fdd_id", "year", "state", "outlets_end").filter(code)
    per = latest.latest_year_rows(i, ["fdd_id"]).groupBy("fdd_id", "state").agg(F.sum("outlets_end").alias("n"))
    return latest.top_k(per, ["fdd_id"], [F.desc_nulls_last("n"), F.asc("state")], 10).select("fdd_id", "state", "n", "rank")


# ------------------------------------------------- reports, filters, sorts


@query("""SELECT o_custkey, o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey
          QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) <= 5""")
def q_best_by_group(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return latest.top_k(o.join(c, "o_custkey"), ["c_mktsegment"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).drop("rank")


@query("""SELECT l_orderkey, max(l_extendedprice) AS top, arg_max(l_partkey, l_extendedprice * 1000000 - l_linenumber) AS part FROM lineitem GROUP BY 1""")
def q_top_earners(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_extendedprice").alias("top"), F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("part")
    )


def _report(column, descending, where=None, tie="o_orderkey", n=25):
    def run(s, d):
        order = F.desc(column) if descending else F.asc(column)
        o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        return (o.filter(where) if where else o).orderBy(order, F.asc(tie)).limit(n).drop("o_orderdate")

    return run


for _name, _order, _where, _sql in (
    ("q_largest", "o_totalprice", None, "ORDER BY o_totalprice DESC"),
    ("q_cheapest_under", "o_totalprice", "o_totalprice < 100000", "WHERE o_totalprice < 100000 ORDER BY o_totalprice"),
    ("q_newest", "o_orderdate", None, "ORDER BY o_orderdate DESC"),
):
    QUERIES[_name] = _report(_order, "DESC" in _sql, _where)
    ORACLE[_name] = f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders {_sql}, o_orderkey LIMIT 25"

SPEC = filters.Spec(contains={"c_name": "customer"}, equals={"c_mktsegment": "BUILDING"}, least={"c_acctbal": 1000}, most={"c_acctbal": 8000}, sort="c_acctbal", descending=True)


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE contains(lower(c_name), 'customer') AND c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 1000 AND 8000""")
def q_filter_spec(s, d):
    return filters.Spec.from_params(SPEC.to_params()).apply(table(s, d, "customer"), ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE nullif(c_acctbal, 0) IS NULL OR c_acctbal <= 2500")
def q_budget_filter(s, d):
    return table(s, d, "customer").filter(filters.within_budget(F.col("c_acctbal"), 2500)).select("c_custkey")


@query("SELECT id, year_founded FROM franchisors ORDER BY year_founded ASC NULLS LAST, id LIMIT 300")
def q_sort_nulls_last_limit(s, d):
    return filters.Spec(sort="year_founded", limit=300).apply(table(s, d, "franchisors"), ["id"]).select("id", "year_founded")


@query("""SELECT 'c_acctbal' AS metric, CAST(max(c_acctbal) FILTER (WHERE c_custkey = 1) AS VARCHAR) AS "1", CAST(max(c_acctbal) FILTER (WHERE c_custkey = 2) AS VARCHAR) AS "2" FROM customer
          UNION ALL SELECT 'c_name', max(c_name) FILTER (WHERE c_custkey = 1), max(c_name) FILTER (WHERE c_custkey = 2) FROM customer""")
def q_compare_matrix(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_name")
    return relate.compare_matrix(c, "c_custkey", [1, 2], ["c_acctbal", "c_name"])


# ------------------------------------------------------- entities, duplicates


@query("""SELECT regexp_replace(lower(legal_name), '[^a-z0-9]+', '', 'g') AS key, count(*) AS n, min(id) AS keeper FROM franchisors WHERE legal_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def q_dup_groups(s, d):
    return entity.duplicate_groups(table(s, d, "franchisors"), C.compact_key(F.col("legal_name")), "id")


@query("""WITH k AS (SELECT id, regexp_replace(lower(legal_name), '[^a-z0-9]+', '', 'g') AS key FROM franchisors WHERE legal_name IS NOT NULL)
          SELECT id, keeper FROM (SELECT id, min(id) OVER (PARTITION BY key) AS keeper FROM k) WHERE id <> keeper""")
def q_keep_lowest(s, d):
    return entity.merge_plan(table(s, d, "franchisors"), C.compact_key(F.col("legal_name")), "id")


@query("SELECT doc_id AS id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY sha256(text)) END AS class_id FROM documents")
def q_sha_dedup(s, d):
    return entity.content_classes(table(s, d, "documents"), "text", "doc_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def q_first_seen_dedup(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "event_id")
    return latest.latest(e, ["user_id", "event_type"], ["event_id"], smallest=True)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_recent_per_key(s, d):
    return latest.latest(table(s, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


_KNOWN = "SELECT id, regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g') AS name_key, state_of_inc AS state FROM franchisors"


@query(f"""WITH k AS ({_KNOWN}), m AS (SELECT meta_id, regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g') AS name_key, state_of_inc AS state FROM filing_metadata)
          SELECT meta_id, coalesce((SELECT min(id) FROM k WHERE k.name_key = m.name_key AND k.state = m.state AND k.name_key <> ''), (SELECT min(id) FROM k WHERE k.name_key = m.name_key AND k.name_key <> '')) AS match_id FROM m""")
def q_find_match(s, d):
    key = C.compact_key(F.col("brand_name")).alias("name_key")
    known = table(s, d, "franchisors").select("id", key, F.lit("x").alias("industry"), F.col("state_of_inc").alias("state"))
    new = table(s, d, "filing_metadata").select("meta_id", key, F.lit("x").alias("industry"), F.col("state_of_inc").alias("state"))
    return entity.match_entity(new, known).select("meta_id", "match_id")


@query(f"""WITH RECURSIVE f AS (SELECT id AS ord, regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g') AS k, website AS w FROM franchisors),
          e AS (SELECT a.ord AS a, b.ord AS b FROM f a JOIN f b ON a.k = b.k AND a.k <> '' UNION SELECT a.ord, b.ord FROM f a JOIN f b ON a.w = b.w UNION SELECT ord, ord FROM f),
          c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
          SELECT a AS filing, min(b) AS entity FROM c GROUP BY 1""")
def q_entity_registry(s, d):
    f = table(s, d, "franchisors").select(
        F.col("id").alias("filing"), F.col("id").alias("ord"), F.lit(None).cast("string").alias("sha"), C.compact_key(F.col("brand_name")).alias("name_key"), F.lit("x").alias("industry"), F.col("website").alias("slug")
    )
    return entity.registry(f)


@query("""WITH k AS (SELECT franchisor_id, max(filing_year) AS y FROM fdds WHERE filing_state = 'MN' GROUP BY 1)
          SELECT d.id, CASE WHEN k.y IS NULL THEN 'NEW' WHEN d.filing_year > k.y THEN 'UPDATE' ELSE 'SKIP' END AS status FROM fdds d LEFT JOIN k USING (franchisor_id) WHERE filing_state = 'WI'""")
def q_new_or_update(s, d):
    f = table(s, d, "fdds").select("id", "franchisor_id", "filing_year", "filing_state")
    known = f.filter("filing_state = 'MN'")
    return entity.new_or_update(f.filter("filing_state = 'WI'"), known, "franchisor_id", "filing_year").select("id", "status")


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
          UNION ALL SELECT c_custkey, upper(c_name), 0.0::DOUBLE FROM customer WHERE c_mktsegment = 'BUILDING'""")
def q_replace_by_key(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return entity.replace_by_key(c.drop("c_mktsegment"), new, ["c_custkey"])


# ------------------------------------------------------------- text functions


@query("""SELECT id, regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g') AS brand_key,
          coalesce(nullif(substring(regexp_replace(regexp_replace(lower(brand_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'unknown') AS slug FROM franchisors""")
def q_brand_key(s, d):
    b = F.col("brand_name")
    return table(s, d, "franchisors").select("id", C.compact_key(b).alias("brand_key"), C.slug(b).alias("slug"))


RULES = (("(?i)promo", "promo"), ("(?i)economy|standard", "plain"), ("(?i)steel|brass", "metal"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)promo') THEN 'promo' WHEN regexp_matches(p_type, '(?i)economy|standard') THEN 'plain' WHEN regexp_matches(p_type, '(?i)steel|brass') THEN 'metal' END AS kind FROM part""")
def q_rule_classify(s, d):
    return table(s, d, "part").select("p_partkey", C.rule_classify(F.col("p_type"), RULES).alias("kind"))


@query(r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '\b(20\d{2})\b', 1), '') AS INTEGER) AS y, coalesce(len(string_split(nullif(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ''), ' ')), 0)::INTEGER AS words,
          substring(sha1(text), 1, 12) AS print FROM documents""")
def q_text_facts(s, d):
    t = F.col("text")
    words = C.word_count(F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", " "))
    return table(s, d, "documents").select("doc_id", C.year_in_text(t).alias("y"), words.alias("words"), C.fingerprint(t).alias("print"))


@query(r"""WITH w AS (SELECT DISTINCT portal_id, regexp_replace(effective_date, '^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2})$', '\1/\2/20\3') AS t FROM
            (SELECT DISTINCT portal_id, effective_date FROM wi_filings))
          SELECT portal_id, coalesce(CAST(try_strptime(t, '%Y-%m-%d') AS DATE), CAST(try_strptime(t, '%m/%d/%Y') AS DATE), CAST(try_strptime(t, '%B %d, %Y') AS DATE),
            CAST(try_strptime(t, '%b %d, %Y') AS DATE), CAST(try_strptime(t, '%d %B %Y') AS DATE)) AS effective FROM w""")
def q_any_date(s, d):
    return table(s, d, "wi_filings").select("portal_id", "effective_date").distinct().select("portal_id", C.any_date(F.col("effective_date")).alias("effective"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_json_props(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(r"""SELECT doc_id, coalesce(length(text) < 200 OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.5 * length(text)
          OR length(regexp_replace(text, '[^\x20-\x7E\n\r\t]', '', 'g')) < 0.85 * length(text), true) AS scanned FROM documents""")
def q_scan_quality(s, d):
    return table(s, d, "documents").select("doc_id", C.scan_quality(F.col("text")).alias("scanned"))


@query(r"""SELECT meta_id, coalesce(n <> '' AND contains(t, substring(n, 1, 25)), false) AS said FROM (SELECT meta_id,
          trim(regexp_replace(lower(brand_name), '\s+', ' ', 'g')) AS n, trim(regexp_replace(lower(raw_excerpt), '\s+', ' ', 'g')) AS t FROM filing_metadata)""")
def q_needle_match(s, d):
    return table(s, d, "filing_metadata").select("meta_id", C.loosely_contains(F.col("raw_excerpt"), F.col("brand_name")).alias("said"))


@query("""SELECT portal_id, trim(regexp_replace(coalesce(legal_name, ''), '\\s+', ' ', 'g')) AS legal_name, nullif(details_url, '') AS link FROM (SELECT DISTINCT * FROM wi_filings)""")
def q_html_rows(s, d):
    """Pages made of portal rows, read back as rows."""
    w = table(s, d, "wi_filings").distinct()
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c), F.lit("")), F.lit("</td>"))
    html = F.concat(F.lit("<table><tr>"), cell("portal_id"), cell("legal_name"), F.lit("<td><a href='"), F.coalesce("details_url", F.lit("")), F.lit("'>x</a></td></tr></table>"))
    t = files.html_tables(w.select("portal_id", html.alias("html")), "portal_id", "html", 3)
    return t.select("portal_id", F.get("cells", F.lit(1)).alias("legal_name"), "link")


# ------------------------------------------------------------- numbers


@query("""SELECT o_orderkey, CAST(round_even(o_totalprice / s, 0) * s AS BIGINT) AS nice FROM
          (SELECT o_orderkey, abs(o_totalprice) AS o_totalprice, CASE WHEN abs(o_totalprice) < 100000 THEN 5000 WHEN abs(o_totalprice) < 500000 THEN 10000 WHEN abs(o_totalprice) < 2000000 THEN 25000 WHEN abs(o_totalprice) < 10000000 THEN 100000 ELSE 500000 END AS s FROM orders)""")
def q_nice_round(s, d):
    return table(s, d, "orders").select("o_orderkey", C.nice_round(F.col("o_totalprice")).alias("nice"))


@query("""WITH w AS (SELECT id, lower(coalesce(metric_raw, '')) AS t, lower(trim(unit_period)) AS u, value_median FROM item19_records)
          SELECT id, value_median * CASE u WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 WHEN 'daily' THEN 365 WHEN 'annual' THEN 1 ELSE
            CASE WHEN contains(t, 'weekly') OR contains(t, 'per week') OR contains(t, 'awus') OR contains(t, 'aws ') THEN 52 WHEN contains(t, 'monthly') OR contains(t, 'per month') THEN 12
                 WHEN contains(t, 'daily') OR contains(t, 'revpar') OR contains(t, 'adr') OR contains(t, 'per day') OR contains(t, 'per night') THEN 365 ELSE 1 END END AS annual FROM w""")
def q_annualise(s, d):
    i = table(s, d, "item19_records")
    return i.select("id", (F.col("value_median") * C.annual_multiplier(F.col("unit_period"), F.col("metric_raw"))).alias("annual"))


@query("""SELECT id, CASE WHEN filing_year IS NULL OR filing_year = 0 THEN 'unknown' WHEN 2026 - filing_year <= 0 THEN 'current' WHEN 2026 - filing_year = 1 THEN '1' WHEN 2026 - filing_year = 2 THEN '2' WHEN 2026 - filing_year = 3 THEN '3' ELSE 'older' END AS age FROM fdds""")
def q_age_bucket(s, d):
    return table(s, d, "fdds").select("id", C.age_bucket(F.col("filing_year"), 2026).alias("age"))


@query("""SELECT l_orderkey, l_linenumber, '$' || format('{:,}', CAST(round(l_extendedprice) AS BIGINT)) AS full_text FROM lineitem""")
def q_format_money(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.money_full(F.col("l_extendedprice")).alias("full_text"))


@query("""SELECT user_id, CAST(sum(CAST(k * 3.0 / 1000000 AS DECIMAL(18,9))) AS DOUBLE) AS cost, count(*) AS n FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def q_token_cost(s, d):
    e = table(s, d, "events").select("user_id", F.from_json("props", "k bigint")["k"].alias("k"))
    c = C.token_cost(F.lit(None).cast("double"), {"input": (F.col("k"), 3.0)})
    return e.groupBy("user_id").agg(F.sum(F.round(c, 9).cast("decimal(18,9)")).cast("double").alias("cost"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- validation

BOUNDS = {"value_avg": (0, 100_000), "value_median": (0, 100_000)}


@query("""SELECT id, CASE WHEN value_avg BETWEEN 0 AND 100000 THEN value_avg END AS value_avg, CASE WHEN value_median BETWEEN 0 AND 100000 THEN value_median END AS value_median,
          CAST((value_avg NOT BETWEEN 0 AND 100000) IS TRUE AS INTEGER) + CAST((value_median NOT BETWEEN 0 AND 100000) IS TRUE AS INTEGER) AS n_flags FROM item19_records""")
def q_bounds_flags(s, d):
    b = validate.bounded(table(s, d, "item19_records").select("id", "value_avg", "value_median"), BOUNDS)
    return b.select("id", "value_avg", "value_median", F.when(F.col("quality_flag").isNull(), 0).otherwise(F.size(F.split("quality_flag", "; "))).alias("n_flags"))


@query("""SELECT id, CASE WHEN value_min > value_max THEN value_max ELSE value_min END AS value_min, CASE WHEN value_min > value_max THEN value_min ELSE value_max END AS value_max, coalesce(value_min > value_max, false) AS swapped FROM item19_records""")
def q_swap(s, d):
    return validate.ordered_pair(table(s, d, "item19_records").select("id", "value_min", "value_max"), "value_min", "value_max", "swapped")


@query("""SELECT id, 'fail' AS severity, 'value_avg_out_of_bounds' AS check_name FROM item19_records WHERE value_avg < value_min OR value_avg > value_max
          UNION ALL SELECT id, 'fail', 'value_median_out_of_bounds' FROM item19_records WHERE value_median < value_min OR value_median > value_max
          UNION ALL SELECT id, 'warn', 'no_outlets' FROM item19_records WHERE outlet_count = 0""")
def q_value_bounds(s, d):
    checks = [*validate.value_bound_checks(), ("warn", "no_outlets", F.col("outlet_count") == 0, F.col("outlet_count"))]
    return validate.issues(table(s, d, "item19_records"), ["id"], checks).drop("detail")


@query("""SELECT fdd_id, year, p AS parts, t AS total FROM (SELECT fdd_id, year, CAST(sum(outlets_end) FILTER (WHERE outlet_type = 'franchised') + sum(outlets_end) FILTER (WHERE outlet_type = 'company-owned') AS BIGINT) AS p, CAST(sum(outlets_end) FILTER (WHERE outlet_type = 'total') AS BIGINT) AS t
          FROM item20_locations GROUP BY 1, 2) WHERE abs(p - t) > 1""")
def q_identity(s, d):
    return validate.sums_up(table(s, d, "item20_locations"), ["fdd_id", "year"], "outlet_type", "outlets_end", ["franchised", "company-owned"], "total")


@query("""WITH i AS (SELECT DISTINCT fdd_id FROM item19_records) SELECT 1 AS tier, 'flag_without_records' AS "check", CAST(id AS VARCHAR) AS key FROM fdds WHERE has_item19 AND id NOT IN (SELECT fdd_id FROM i WHERE fdd_id IS NOT NULL)
          UNION ALL SELECT 2, 'records_without_flag', CAST(id AS VARCHAR) FROM fdds WHERE has_item19 = false AND id IN (SELECT fdd_id FROM i)""")
def q_audit_union(s, d):
    f = table(s, d, "fdds").select(F.col("id").alias("key"), "has_item19", F.lit("").alias("detail"))
    i = table(s, d, "item19_records").select(F.col("fdd_id").alias("key")).distinct()
    checks = [(1, "flag_without_records", f.filter("has_item19").join(i, "key", "left_anti")), (2, "records_without_flag", f.filter("has_item19 = false").join(i, "key", "left_semi"))]
    return validate.audit(checks).drop("detail")


@query("""SELECT id, CAST(3 * CAST(has_item19 IS TRUE AS INT) + 2 * CAST(has_item20 IS TRUE AS INT) + 3 * CAST((page_count > 0) IS TRUE AS INT) + 2 * CAST(effective_date IS NOT NULL AS INT) AS INTEGER) AS score FROM fdds""")
def q_quality_score(s, d):
    parts = [(3, F.col("has_item19")), (2, F.col("has_item20")), (3, F.col("page_count") > 0), (2, F.col("effective_date").isNotNull())]
    return table(s, d, "fdds").select("id", validate.quality_score(parts).alias("score"))


@query("""SELECT id FROM item19_records WHERE confidence < 0.7""")
def q_needs_review(s, d):
    return table(s, d, "item19_records").filter(F.col("confidence") < 0.7).select("id")


# ------------------------------------------------------------- time windows


@query("""SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def q_tumbling(s, d):
    e = table(s, d, "events").withColumn("v", F.col("value").cast("decimal(18,6)"))
    return jobs.tumbling(e, "ts", "1 hour", "event_type", "v").withColumn("total", F.col("total").cast("double"))


@query("""WITH x AS (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events)
          SELECT CAST(w AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM x GROUP BY 1, 2""")
def q_sliding(s, d):
    return jobs.sliding(table(s, d, "events"), "ts", "1 hour", "30 minutes", "event_type")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
          y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
          SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM y GROUP BY user_id, g""")
def q_session(s, d):
    return jobs.sessions(table(s, d, "events"), "ts", "30 minutes", "user_id")


@query("SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2")
def q_stream_dedup(s, d):
    return jobs.deduplicated(table(s, d, "events").select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"])

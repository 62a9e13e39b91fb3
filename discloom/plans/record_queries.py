"""Queries over the filing tables: breakdowns, repairs, gates, text facts, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from discloom.functions import cols as C
from discloom.operators import entity, filters, growth, latest, relate, sections, stats, textmine, validate
from discloom.plans.registry import Registry
from discloom.session import table
from discloom.sources import files, sinks

_R = Registry()
QUERIES, ORACLE, query = _R.queries, _R.oracle, _R.query

# ------------------------------------------------------------ series, ranks


@query("""WITH t AS (SELECT fdd_id, max(year) AS y FROM item20_locations WHERE year IS NOT NULL GROUP BY 1)
          SELECT i.fdd_id, t.y AS latest_year, CAST(max(outlets_end) FILTER (WHERE outlet_type = 'total') AS INTEGER) AS total,
            CAST(coalesce(max(outlets_end) FILTER (WHERE outlet_type = 'franchised'), max(outlets_end) FILTER (WHERE outlet_type IS NULL)) AS INTEGER) AS franchised,
            CAST(max(outlets_end) FILTER (WHERE outlet_type = 'company-owned') AS INTEGER) AS company_owned
          FROM item20_locations i JOIN t ON t.fdd_id = i.fdd_id AND t.y = i.year GROUP BY 1, 2""")
def q_latest_breakdown(s, d):
    return growth.latest_breakdown(table(s, d, "item20_locations"), "fdd_id", "year", "outlet_type", "outlets_end")


TIERS = (("all_franchised", "all_units", "all_reporting"), ("tenure_based",), ("performance_anchored",))


@query("""SELECT fdd_id, id, metric_name, cohort_name FROM item19_records WHERE coalesce(value_median, value_avg) IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY fdd_id ORDER BY CASE WHEN cohort_name IN ('all_franchised', 'all_units', 'all_reporting') THEN 0 WHEN cohort_name = 'tenure_based' THEN 1
            WHEN cohort_name = 'performance_anchored' THEN 2 ELSE 3 END, CASE WHEN cohort_name = 'all_franchised' THEN 0 ELSE 1 END, CASE WHEN metric_name = 'gross_sales' THEN 0 ELSE 1 END,
            CASE WHEN value_median IS NOT NULL THEN 0 ELSE 1 END, id) = 1""")
def q_tiered_best(s, d):
    i = table(s, d, "item19_records").filter("coalesce(value_median, value_avg) is not null").select("fdd_id", "id", "metric_name", "cohort_name", "value_median")
    first = lambda c: F.when(c, 0).otherwise(1)
    ranks = [latest.tier(F.col("cohort_name"), TIERS), first(F.col("cohort_name") == "all_franchised"), first(F.col("metric_name") == "gross_sales"), first(F.col("value_median").isNotNull())]
    return latest.best_ranked(i, ["fdd_id"], ranks, "id").drop("value_median")


@query("""WITH c AS (SELECT id, fdd_id, coalesce(cohort_raw, '') AS l, nullif(reporting_period, '') AS p, count(*) OVER (PARTITION BY fdd_id, coalesce(cohort_raw, '')) AS n FROM item19_records)
          SELECT id, CASE WHEN length(t) > 130 THEN substring(t, 1, 127) || '…' ELSE t END AS label FROM (SELECT id, CASE WHEN n > 1 AND p IS NOT NULL
            THEN l || ' (' || coalesce(nullif(regexp_extract(p, '\\b(20[0-9]{2})\\b', 1), ''), p) || ')' ELSE l END AS t FROM c)""")
def q_disambiguated(s, d):
    i = table(s, d, "item19_records").select("id", "fdd_id", F.coalesce("cohort_raw", F.lit("")).alias("raw"), "reporting_period")
    return textmine.disambiguated(i, ["fdd_id"], "raw", "reporting_period").select("id", "label")


@query("""WITH p AS (SELECT fdd_id, outlets_end AS v FROM item20_locations WHERE outlets_end > 0), g AS (SELECT fdd_id, count(*) AS n, list(v ORDER BY v) AS a, list_sort(list_distinct(list(v))) AS u FROM p GROUP BY 1)
          SELECT fdd_id, n, """ + ", ".join(f"CAST(CASE WHEN n <= 4 THEN u[least({i}, len(u))] ELSE a[least(n * {i} // 5, n - 1) + 1] END AS INTEGER) AS cut{i}" for i in range(1, 5)) + " FROM g")
def q_quintile_padded(s, d):
    return stats.quintile_thresholds(table(s, d, "item20_locations").select("fdd_id", "outlets_end"), ["fdd_id"], "outlets_end")


@query("""SELECT filing_state, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE has_item19) * 100 / count(*) + 0.5) END AS INTEGER) AS percent FROM fdds GROUP BY 1""")
def q_kpi_percent(s, d):
    g = table(s, d, "fdds").groupBy("filing_state").agg(F.count_if("has_item19").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("filing_state", stats.half_up_percent(F.col("k"), F.col("n")).alias("percent"))


_SCORE = "3 * CAST(has_item19 IS TRUE AS INT) + 2 * CAST(has_item20 IS TRUE AS INT) + 3 * CAST((page_count > 0) IS TRUE AS INT) + 2 * CAST(effective_date IS NOT NULL AS INT)"


@query(f"""WITH x AS (SELECT CAST({_SCORE} AS INTEGER) AS score FROM fdds), m AS (SELECT sum(score) / count(*) AS mean, (list(score ORDER BY score))[count(*) // 2 + 1] AS upper_median FROM x)
          SELECT score, count(*) AS n, any_value(mean) AS mean, any_value(upper_median) AS upper_median FROM x, m GROUP BY 1""")
def q_score_histogram(s, d):
    parts = [(3, F.col("has_item19")), (2, F.col("has_item20")), (3, F.col("page_count") > 0), (2, F.col("effective_date").isNotNull())]
    return stats.score_summary(table(s, d, "fdds").select(validate.quality_score(parts).alias("score")), "score")


@query("""SELECT cohort_name, count(*) AS n, count(DISTINCT fdd_id) AS filings FROM item19_records GROUP BY 1""")
def q_cohort_distribution(s, d):
    return table(s, d, "item19_records").groupBy("cohort_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fdd_id").alias("filings"))


@query("""SELECT count(*) AS filings, avg(n) AS mean, min(n) AS low, max(n) AS high FROM (SELECT fdd_id, count(*) AS n FROM item19_records GROUP BY 1)""")
def q_records_per_filing(s, d):
    g = table(s, d, "item19_records").groupBy("fdd_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("filings"), F.avg("n").alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"))


@query("""SELECT fdd_id, count(*) FILTER (WHERE coalesce(confidence, 0) < 0.7) AS n_low, round(avg(coalesce(confidence, 0)), 9) AS mean FROM item19_records GROUP BY 1 HAVING n_low >= 3""")
def q_low_confidence(s, d):
    return validate.low_confidence(table(s, d, "item19_records"), "fdd_id", "confidence").withColumn("mean", F.round("mean", 9))


@query("""SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens, round(sum(k) / count(*), 6) AS mean_tokens, round(sum(k) * 3.0 / 1000000, 6) AS cost,
            round((count(*) - count(DISTINCT user_id)) * (sum(k) * 3.0 / 1000000 / count(*)), 6) AS avoided
          FROM (SELECT event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def q_token_report(s, d):
    e = table(s, d, "events").select("event_type", "user_id", F.from_json("props", "k bigint")["k"].alias("k"))
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("tokens"), F.count_distinct("user_id").alias("__u"))
    cost = F.col("tokens") * 3.0 / 1000000
    return g.select("event_type", "n", "tokens", F.round(F.col("tokens") / F.col("n"), 6).alias("mean_tokens"), F.round(cost, 6).alias("cost"), F.round((F.col("n") - F.col("__u")) * (cost / F.col("n")), 6).alias("avoided"))


@query("""SELECT event_type, min(g) AS low, max(g) AS high, round(avg(g), 6) AS mean FROM (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS g FROM events) WHERE g IS NOT NULL GROUP BY 1""")
def q_elapsed(s, d):
    from pyspark.sql.window import Window as W

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6
    e = table(s, d, "events").select("event_type", gap.alias("g")).filter("g is not null")
    return e.groupBy("event_type").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.round(F.avg("g"), 6).alias("mean"))


# ----------------------------------------------------------- states, filters

_CODES = "(VALUES " + ", ".join(f"('{n}', '{c}'), ('{c.lower()}', '{c}')" for n, c in C.STATES.items()) + ") s(n, c)"


@query(f"SELECT i.id, s.c AS code FROM item20_locations i LEFT JOIN {_CODES} ON s.n = lower(trim(i.state))")
def q_state_codes(s, d):
    return table(s, d, "item20_locations").select("id", C.state_code(F.col("state")).alias("code"))


@query(f"""SELECT s.c AS code, CAST(sum(i.outlets_end) AS BIGINT) AS n FROM item20_locations i JOIN {_CODES} ON s.n = lower(trim(i.state)) WHERE i.outlets_end IS NOT NULL GROUP BY 1""")
def q_state_sums(s, d):
    i = table(s, d, "item20_locations").select(C.state_code(F.col("state")).alias("code"), "outlets_end").filter("code is not null and outlets_end is not null")
    return i.groupBy("code").agg(F.sum("outlets_end").alias("n"))


#: Filters with their sorts, by name.
PRESETS = {
    "best-value": filters.Spec(least={"o_shippriority": 0}, most={"o_totalprice": 50_000}, sort="o_totalprice"),
    "urgent": filters.Spec(equals={"o_orderpriority": "1-URGENT"}, sort="o_totalprice", descending=True, limit=50),
    "largest": filters.Spec(least={"o_totalprice": 300_000}, has={"o_orderdate": True}, sort="o_totalprice", descending=True),
}


@query("""SELECT 'best-value' AS preset, o_orderkey FROM orders WHERE o_totalprice <= 50000
          UNION ALL SELECT * FROM (SELECT 'urgent', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
          UNION ALL SELECT 'largest', o_orderkey FROM orders WHERE o_totalprice >= 300000 AND o_orderdate IS NOT NULL""")
def q_presets(s, d):
    o = table(s, d, "orders")
    parts = [spec.apply(o, ["o_orderkey"]).select(F.lit(n).alias("preset"), "o_orderkey") for n, spec in PRESETS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT id, state FROM item20_locations WHERE state NOT IN ('TOTAL', '') AND outlet_type IS NULL")
def q_not_in_null(s, d):
    return table(s, d, "item20_locations").filter(~F.col("state").isin("TOTAL", "") & F.col("outlet_type").isNull()).select("id", "state")


@query("""SELECT id FROM item19_records WHERE metric_name IN ('gross_sales', 'total_revenue', 'gross_profit', 'net_profit', 'ebitda') AND value_avg IS NOT NULL
          AND NOT regexp_matches(lower(coalesce(metric_raw, '')), 'month\\s*[0-9]+')""")
def q_chartable(s, d):
    ok = textmine.chartable(F.col("metric_name"), F.col("value_avg"), F.col("metric_raw"), ("gross_sales", "total_revenue", "gross_profit", "net_profit", "ebitda"))
    return table(s, d, "item19_records").filter(ok).select("id")


NEED, SKIP = r"(?i)\b(Franchising|Franchisor|Franchise Systems|Franchise Company|Franchise Services)\b", r"(?i)\b(?:Holdings LLC$|Investments?|Ventures? LLC$|Properties LLC)\b"


@query(f"SELECT id FROM franchisors WHERE regexp_matches(legal_name, '{NEED}') AND NOT regexp_matches(legal_name, '{SKIP}')")
def q_name_filter(s, d):
    return table(s, d, "franchisors").filter(textmine.indicated(F.col("legal_name"), NEED, SKIP)).select("id")


@query("SELECT id FROM item19_records WHERE contains(lower(cohort_raw), 'affiliate') OR contains(lower(cohort_raw), 'company')")
def q_phrases(s, d):
    return table(s, d, "item19_records").filter(textmine.has_phrase(F.col("cohort_raw"), ("affiliate", "company"))).select("id")


@query("""SELECT id, CASE WHEN metric_scope IN ('market-area', 'ramp-snapshot') THEN true WHEN metric_scope = 'franchisee' THEN false ELSE coalesce(regexp_matches(metric_raw, '(?i)market|per visit|ticket'), false) END AS other FROM item19_records""")
def q_non_unit(s, d):
    return table(s, d, "item19_records").select("id", textmine.non_unit_metric(F.col("metric_scope"), F.col("metric_raw"), (r"(?i)market|per visit|ticket",)).alias("other"))


@query("""SELECT id, coalesce(length(legal_name) BETWEEN 4 AND 120 AND NOT contains(lower(legal_name), 'unknown') AND NOT regexp_matches(legal_name, '^(?:[Tt]he|[Aa]n?)\\s+[a-z]')
          AND string_split(lower(legal_name), ' ')[1] NOT IN ('california', 'ohio'), false) AS ok FROM franchisors""")
def q_plausible_names(s, d):
    return table(s, d, "franchisors").select("id", textmine.plausible_company(F.col("legal_name"), ("unknown",), ("california", "ohio")).alias("ok"))


@query("SELECT id, brand_name FROM franchisors ORDER BY lower(brand_name) ASC NULLS FIRST, id LIMIT 200")
def q_nocase_order(s, d):
    return table(s, d, "franchisors").select("id", "brand_name").orderBy(filters.sort_key("brand_name", nocase=True), "id").limit(200)


@query("SELECT id, year_founded FROM franchisors ORDER BY year_founded DESC NULLS LAST, id LIMIT 200")
def q_engine_nulls_desc(s, d):
    return table(s, d, "franchisors").select("id", "year_founded").orderBy(filters.sort_key("year_founded", True), "id").limit(200)


@query("SELECT id, year_founded FROM franchisors ORDER BY year_founded ASC NULLS FIRST, id LIMIT 200")
def q_engine_nulls_asc(s, d):
    return table(s, d, "franchisors").select("id", "year_founded").orderBy(filters.sort_key("year_founded"), "id").limit(200)


@query("""WITH k AS (SELECT c_mktsegment, c_nationkey, c_custkey FROM customer) SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment DESC, c_nationkey, c_custkey) AS BIGINT) AS position FROM k""")
def q_multi_sort(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    down = F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ZYXWVUTSRQPONMLKJIHGFEDCBA")
    return sinks.numbered(c.withColumn("__d", down), ["__d", "c_nationkey", "c_custkey"]).select("c_custkey", "position")


# --------------------------------------------------------------- validation


@query("""SELECT c_custkey, 'fail' AS severity, 'royalty_bounds' AS check_name FROM (SELECT c_custkey, c_acctbal / 300 AS royalty, c_acctbal / 500 AS marketing FROM customer) WHERE royalty NOT BETWEEN 0 AND 25
          UNION ALL SELECT c_custkey, 'fail', 'marketing_bounds' FROM (SELECT c_custkey, c_acctbal / 500 AS marketing FROM customer) WHERE marketing NOT BETWEEN 0 AND 15
          UNION ALL SELECT c_custkey, 'fail', 'fee_low_gt_high' FROM customer WHERE c_acctbal > c_nationkey * 300""")
def q_fee_checks(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 300).alias("royalty"), (F.col("c_acctbal") / 500).alias("marketing"), F.col("c_acctbal").alias("low"), (F.col("c_nationkey") * 300).alias("high"))
    return validate.issues(c, ["c_custkey"], validate.fee_checks("royalty", "marketing", [("fee", "low", "high")])).drop("detail")


@query("""SELECT id, CASE WHEN value_median > value_max THEN NULL ELSE value_median END AS value_median, CASE WHEN value_median > value_max THEN
          CASE WHEN coalesce(notes, '') = '' THEN 'median suppressed' ELSE notes || ' | median suppressed' END ELSE notes END AS notes FROM item19_records""")
def q_suppressed(s, d):
    i = table(s, d, "item19_records").select("id", "value_median", "value_max", "notes")
    out = validate.suppressed(i, "value_median", "value_max", "median suppressed")
    return out.select("id", "value_median", F.regexp_replace("notes", r"median suppressed: .*$", "median suppressed").alias("notes"))


@query("""WITH r AS (SELECT DISTINCT fdd_id FROM item19_records) SELECT id, coalesce(has_item19, false) AS was, r.fdd_id IS NOT NULL AS now FROM fdds LEFT JOIN r ON r.fdd_id = id WHERE coalesce(has_item19, false) <> (r.fdd_id IS NOT NULL)""")
def q_flag_repair(s, d):
    return validate.flags_from_records(table(s, d, "fdds"), "id", "has_item19", table(s, d, "item19_records"), "fdd_id")


@query("""SELECT * FROM item19_records WHERE coalesce(value_median BETWEEN value_min AND value_max, true) AND fdd_id IS NOT NULL""")
def q_bulk_cleanup(s, d):
    ok = F.coalesce(F.col("value_median").between(F.col("value_min"), F.col("value_max")), F.lit(True))
    return table(s, d, "item19_records").filter(ok & F.col("fdd_id").isNotNull())


@query("""WITH f AS (SELECT franchisor_id AS k, CAST(item_no AS INTEGER) AS i, max(n_chars) AS s FROM documents WHERE franchisor_id IS NOT NULL GROUP BY ALL), w AS (SELECT DISTINCT k, unnest([5, 6, 7]) AS i FROM f)
          SELECT k AS franchisor_id, i AS item_no, CASE WHEN s IS NULL THEN 'missing' ELSE 'empty' END AS reason FROM w LEFT JOIN f USING (k, i) WHERE s IS NULL OR s < 200""")
def q_missing_parts(s, d):
    t = table(s, d, "documents").filter("franchisor_id is not null").select("franchisor_id", F.col("item_no").cast("int").alias("item_no"), "n_chars")
    return validate.missing_parts(t, "franchisor_id", "item_no", "n_chars", (5, 6, 7), 200)


@query("""WITH g AS (SELECT franchisor_id, count(DISTINCT CASE WHEN item_no IN (5, 6, 7, 19, 20) THEN item_no END) AS n_found, count(DISTINCT CASE WHEN item_no IN (5, 6, 7) THEN item_no END) AS m, count(DISTINCT CASE WHEN item_no IN (19, 20) THEN item_no END) AS a
            FROM documents WHERE franchisor_id IS NOT NULL GROUP BY 1)
          SELECT franchisor_id, n_found, CASE WHEN m = 3 AND a > 0 THEN 'whole' WHEN n_found >= 2 THEN 'partial' ELSE 'none' END AS bucket FROM g""")
def q_gate(s, d):
    t = table(s, d, "documents").filter("franchisor_id is not null").select("franchisor_id", F.col("item_no").cast("int").alias("item_no"))
    return validate.gate(t, "franchisor_id", "item_no")


@query("""WITH r AS (SELECT fdd_id, count(*) AS n FROM item19_records GROUP BY 1) SELECT id, 'fail' AS severity, 'no_pages' AS check_name FROM fdds WHERE page_count IS NULL OR page_count <= 0
          UNION ALL SELECT id, 'fail', 'flag_without_records' FROM fdds LEFT JOIN r ON r.fdd_id = id WHERE has_item19 AND n IS NULL""")
def q_fallback_gate(s, d):
    n = table(s, d, "item19_records").groupBy(F.col("fdd_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    f = table(s, d, "fdds").select("id", "page_count", "has_item19").join(n, "id", "left")
    bad = [("fail", "no_pages", F.col("page_count").isNull() | (F.col("page_count") <= 0), F.col("page_count")), ("fail", "flag_without_records", F.col("has_item19") & F.col("n").isNull(), F.col("n"))]
    return validate.issues(f, ["id"], bad).drop("detail")


@query("""SELECT 1 AS tier, 'broken' AS "check", CAST(NULL AS VARCHAR) AS key UNION ALL SELECT 2, 'no_pages', CAST(id AS VARCHAR) FROM fdds WHERE page_count <= 0""")
def q_guarded_audit(s, d):
    f = table(s, d, "fdds")
    checks = [(2, "broken", lambda: f.select(F.col("no_such_column").alias("key"), F.lit("").alias("detail"))), (2, "no_pages", lambda: f.filter("page_count <= 0").select(F.col("id").alias("key"), F.lit("").alias("detail")))]
    return validate.guarded_audit(checks, s).drop("detail")


# ------------------------------------------------------------------ entities


@query("""WITH b AS (SELECT DISTINCT regexp_replace(lower(trade_name), '[^a-z0-9]+', '', 'g') AS key FROM wi_filings), k AS (SELECT DISTINCT regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g') AS key FROM franchisors),
          p AS (SELECT b.key, k.key AS m, CASE WHEN b.key = k.key THEN 0 WHEN (length(k.key) >= 5 AND contains(b.key, k.key)) OR (length(b.key) >= 5 AND contains(k.key, b.key)) THEN 1
            WHEN length(b.key) >= 4 AND length(k.key) >= 4 AND substring(b.key, 1, 4) = substring(k.key, 1, 4) THEN 2 END AS t FROM b, k WHERE b.key <> '' AND k.key <> ''),
          r AS (SELECT key, m, t, row_number() OVER (PARTITION BY key ORDER BY t, CASE WHEN t < 2 THEN length(m) ELSE 0 END, m) AS i FROM p WHERE t IS NOT NULL)
          SELECT b.key, r.m AS match, CASE r.t WHEN 0 THEN 'exact' WHEN 1 THEN 'substring' WHEN 2 THEN 'prefix' END AS how FROM b LEFT JOIN r ON r.key = b.key AND r.i = 1 WHERE b.key <> ''""")
def q_tiered_names(s, d):
    b = table(s, d, "wi_filings").select(C.compact_key(F.col("trade_name")).alias("name"))
    k = table(s, d, "franchisors").select(C.compact_key(F.col("brand_name")).alias("key"))
    return relate.tiered_names(b, "name", k)


_SLUG = "regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(legal_name)), '[\\s,.]*\\b(?:llc|inc|corp|co)\\b\\.?[\\s,.]*$', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""WITH k AS (SELECT id, nullif({_SLUG}, '') AS s, year_founded AS y FROM franchisors),
          c AS (SELECT id, CASE WHEN s IS NULL THEN NULL WHEN y IS NOT NULL THEN s || '|' || y ELSE s END AS content_key, CASE WHEN s IS NULL THEN NULL WHEN y IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM k)
          SELECT id, same_as, 'content' AS by FROM (SELECT id, min(id) OVER (PARTITION BY content_key) AS same_as FROM c WHERE confidence = 'medium') WHERE same_as < id""")
def q_content_dedup(s, d):
    f = table(s, d, "franchisors").select("id", F.lit(None).cast("string").alias("sha"), "legal_name", F.lit(None).cast("date").alias("on"), "year_founded")
    keyed = entity.content_keys(f, C.folded_slug(F.col("legal_name"), "llc|inc|corp|co"), F.col("on"), F.col("year_founded"))
    return entity.first_of_content(keyed, "sha", "id")


@query("""SELECT d.meta_id, coalesce(min(f.id) FILTER (WHERE f.state_of_inc = d.state_of_inc), min(f.id)) AS match_id FROM filing_metadata d LEFT JOIN franchisors f
            ON regexp_replace(lower(f.brand_name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(d.brand_name), '[^a-z0-9]+', '', 'g') AND regexp_replace(lower(d.brand_name), '[^a-z0-9]+', '', 'g') <> ''
            AND f.year_founded IS NOT NULL AND f.year_founded % 2 = d.filing_year % 2 GROUP BY 1, d.state_of_inc, d.brand_name, d.filing_year""")
def q_find_match_industry(s, d):
    """The second key of the match as a number's parity, so that it decides."""
    key = C.compact_key(F.col("brand_name")).alias("name_key")
    two = lambda c: (F.col(c) % 2).cast("string").alias("industry")
    known = table(s, d, "franchisors").select("id", key, two("year_founded"), F.col("state_of_inc").alias("state"))
    new = table(s, d, "filing_metadata").select("meta_id", key, two("filing_year"), F.col("state_of_inc").alias("state"), "brand_name").distinct()
    return entity.match_entity(new, known).select("meta_id", "match_id")


@query("""WITH o AS (SELECT CAST(fdd_id AS VARCHAR) AS key, CASE WHEN id % 2 = 0 THEN 'item19' ELSE 'fees' END AS source, id FROM item19_records WHERE value_median > value_max OR value_median < value_min)
          SELECT key, source, id FROM o WHERE NOT (source = 'item19' AND key IN (SELECT CAST(id AS VARCHAR) FROM fdds WHERE filing_state = 'WI'))
          UNION ALL SELECT CAST(id AS VARCHAR), 'item19', -id FROM fdds WHERE filing_state = 'WI' AND page_count IS NULL""")
def q_replace_issues(s, d):
    bad = (F.col("value_median") > F.col("value_max")) | (F.col("value_median") < F.col("value_min"))
    old = table(s, d, "item19_records").filter(bad).select(F.col("fdd_id").cast("string").alias("key"), F.when(F.col("id") % 2 == 0, "item19").otherwise("fees").alias("source"), "id")
    wi = table(s, d, "fdds").filter("filing_state = 'WI'")
    new = wi.filter("page_count is null").select(F.col("id").cast("string").alias("key"), F.lit("item19").alias("source"), (-F.col("id")).alias("id"))
    return entity.replace_issues(old, new, wi.select(F.col("id").cast("string").alias("key"), F.lit("item19").alias("source")))


# ------------------------------------------------------------ text, formats


@query("""SELECT id, CASE WHEN value_avg IS NULL THEN '—' WHEN regexp_matches(lower(coalesce(metric_raw, '')), 'margin|rate|%|percent|conversion') THEN format('{:.1f}', round(value_avg, 1)) || '%'
          WHEN abs(value_avg) >= 1000 THEN '$' || format('{:,.0f}', value_avg) ELSE '$' || format('{:,.2f}', value_avg) END AS shown FROM item19_records""")
def q_metric_text(s, d):
    return table(s, d, "item19_records").select("id", C.metric_text(F.col("value_avg"), F.col("metric_raw")).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 1000000 THEN '$' || format('{:.1f}', o_totalprice / 1000000) || 'M' WHEN abs(o_totalprice) >= 1000 THEN '$' || format('{:.0f}', round(o_totalprice / 1000)) || 'K'
          ELSE '$' || format('{:.0f}', round(o_totalprice)) END AS short FROM orders""")
def q_money_short(s, d):
    return table(s, d, "orders").select("o_orderkey", C.money_short(F.col("o_totalprice")).alias("short"))


@query("""SELECT id, replace(replace(replace(replace(replace(coalesce(legal_name, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html FROM franchisors""")
def q_html_escape(s, d):
    return table(s, d, "franchisors").select("id", C.html_escaped(F.col("legal_name")).alias("html"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS plain FROM documents""")
def q_strip_html(s, d):
    return table(s, d, "documents").select("doc_id", C.strip_html(F.col("text")).alias("plain"))


@query(f"SELECT id, {_SLUG} AS slug FROM franchisors")
def q_folded_slug(s, d):
    return table(s, d, "franchisors").select("id", C.folded_slug(F.col("legal_name"), "llc|inc|corp|co").alias("slug"))


@query("""SELECT id, CASE WHEN list_contains(string_split(lower(local_path), '/')[:-2], 'wi') THEN 'WI' WHEN list_contains(string_split(lower(local_path), '/')[:-2], 'mn') THEN 'MN'
          WHEN contains(regexp_replace(string_split(lower(local_path), '/')[-1], '\\.[^.]*$', ''), 'mn') THEN 'MN' ELSE 'UNKNOWN' END AS state FROM fdds""")
def q_path_state(s, d):
    return table(s, d, "fdds").select("id", C.path_label(F.col("local_path"), (("folder", "wi", "WI"), ("folder", "mn", "MN"), ("name", "mn", "MN"))).alias("state"))


@query("""SELECT id, coalesce(array_to_string(list_transform(string_split(replace(industry, '-', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' '), 'Other') AS label FROM franchisors""")
def q_title_label(s, d):
    return table(s, d, "franchisors").select("id", C.title_label(F.col("industry")).alias("label"))


@query(r"""SELECT doc_id, CAST(i AS INTEGER) AS pattern_no FROM (SELECT doc_id, unnest([0, 1]) AS i, unnest([regexp_matches(text, '(?i)fee of'), regexp_matches(text, '(?i)unless the')]) AS hit FROM documents) WHERE hit""")
def q_phrase_hits(s, d):
    return textmine.phrase_hits(table(s, d, "documents"), "doc_id", "text", (r"(?i)fee of", r"(?i)unless the")).select("doc_id", "pattern_no")


@query("""SELECT DISTINCT url FROM (SELECT details_url AS url FROM wi_filings WHERE details_url IS NOT NULL AND details_url <> '')""")
def q_sitemap(s, d):
    w = table(s, d, "wi_filings").filter("details_url is not null and details_url <> ''")
    return files.sitemap_urls(sinks.sitemap_lines(w.select("details_url"), "details_url"), "line")


@query("SELECT first(n ORDER BY n) AS name FROM (SELECT trim(brand_name) AS n FROM franchisors) WHERE n <> '' GROUP BY lower(n)")
def q_name_list(s, d):
    return files.name_list(table(s, d, "franchisors").select(F.col("brand_name").alias("value")))


@query("SELECT CAST(event_id AS VARCHAR) AS stem, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_manifest(s, d):
    m = table(s, d, "events").select(F.concat(F.lit('{"extractions": {"'), F.col("event_id").cast("string"), F.lit('": '), F.col("props"), F.lit("}}")).alias("text"))
    return files.manifest(m, "text", "k bigint")


@query("""SELECT fdd_id, min(value_min) AS low, max(value_max) AS high FROM item19_records GROUP BY 1""")
def q_flattened(s, d):
    i = table(s, d, "item19_records").groupBy("fdd_id").agg(F.collect_list(F.struct(F.col("value_min").alias("low"), F.col("value_max").alias("high"), F.lit(None).cast("string").alias("note"))).alias("x"))
    return i.select("fdd_id", validate.flattened(F.col("x"), "low", "high", "note").alias("f")).select("fdd_id", "f.low", "f.high")


# ---------------------------------------------------- scopes, pairs, resuming


@query("""SELECT fdd_id, id FROM item20_locations i WHERE state = 'TOTAL' AND outlet_type = 'total' AND year = (SELECT max(year) FROM item20_locations j WHERE j.fdd_id = i.fdd_id AND j.state = 'TOTAL' AND j.outlet_type = 'total')""")
def q_latest_year_scoped(s, d):
    i = table(s, d, "item20_locations").select("fdd_id", "id", "year", "state", "outlet_type")
    return latest.latest_year_rows(i, ["fdd_id"], "year", (F.col("state") == "TOTAL") & (F.col("outlet_type") == "total")).select("fdd_id", "id")


@query("""SELECT i.fdd_id, i.id FROM item20_locations i JOIN (SELECT fdd_id, max(year) AS y FROM item20_locations WHERE outlets_end IS NOT NULL GROUP BY 1) t ON t.fdd_id = i.fdd_id AND t.y = i.year WHERE i.outlets_end IS NOT NULL AND i.outlets_end > 0""")
def q_latest_year_with_values(s, d):
    i = table(s, d, "item20_locations").select("fdd_id", "id", "year", "outlets_end")
    return latest.latest_year_rows(i, ["fdd_id"], "year", F.col("outlets_end").isNotNull()).filter("outlets_end > 0").select("fdd_id", "id")


@query("""WITH p AS (SELECT fdd_id, cohort_raw, min(id) AS profit_id FROM item19_records WHERE metric_name = 'net_profit' AND cohort_raw IS NOT NULL GROUP BY ALL)
          SELECT r.id, p.profit_id FROM item19_records r LEFT JOIN p ON p.fdd_id = r.fdd_id AND p.cohort_raw = r.cohort_raw WHERE r.metric_name IN ('gross_sales', 'total_revenue')""")
def q_cohort_pairs(s, d):
    """Each revenue figure with the first profit of its cohort."""
    i = table(s, d, "item19_records").select("id", "fdd_id", "cohort_raw", "metric_name")
    p = i.filter("metric_name = 'net_profit' and cohort_raw is not null").groupBy("fdd_id", "cohort_raw").agg(F.min("id").alias("profit_id"))
    return i.filter(F.col("metric_name").isin("gross_sales", "total_revenue")).join(p, ["fdd_id", "cohort_raw"], "left").select("id", "profit_id")


@query("""WITH m AS (SELECT regexp_replace(lower(brand_name), '[^a-z0-9]+', '', 'g') AS k, min(industry) AS v FROM franchisors WHERE coalesce(industry, '') NOT IN ('', 'other') GROUP BY 1)
          SELECT f.id, CASE WHEN coalesce(f.industry, '') IN ('', 'other') THEN coalesce(m.v, f.industry) ELSE f.industry END AS industry FROM franchisors f LEFT JOIN m ON m.k = regexp_replace(lower(f.brand_name), '[^a-z0-9]+', '', 'g') AND m.k <> ''""")
def q_fill_assigned(s, d):
    """Only blank, missing and other industries take the assigned one."""
    f = table(s, d, "franchisors").select("id", "industry", C.compact_key(F.col("brand_name")).alias("k"))
    blank = F.coalesce("industry", F.lit("")).isin("", "other")
    m = f.filter(~blank & (F.col("k") != "")).groupBy("k").agg(F.min("industry").alias("v"))
    return f.join(m, "k", "left").select("id", F.when(blank, F.coalesce("v", "industry")).otherwise(F.col("industry")).alias("industry"))


@query("""SELECT pdf, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT id, franchisor_id || '-' || filing_year AS pdf FROM fdds) WHERE pdf IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def q_dup_id_lists(s, d):
    f = table(s, d, "fdds").select("id", F.concat(F.col("franchisor_id").cast("string"), F.lit("-"), F.col("filing_year").cast("string")).alias("pdf")).filter("pdf is not null")
    g = f.groupBy("pdf").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("x")).filter("n > 1")
    return g.select("pdf", "n", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("ids"))


@query("""WITH u AS (SELECT portal_id, legal_name, trade_name, 0 AS r FROM wi_filings WHERE status ILIKE 'registered' UNION ALL SELECT portal_id, legal_name, trade_name, 1 FROM wi_filings)
          SELECT portal_id, legal_name, trade_name FROM u QUALIFY row_number() OVER (PARTITION BY portal_id ORDER BY r, legal_name NULLS FIRST, trade_name NULLS FIRST) = 1""")
def q_union_searches(s, d):
    w = table(s, d, "wi_filings").select("portal_id", "legal_name", "trade_name", "status")
    first = w.filter(F.lower("status") == "registered").drop("status")
    return files.searches([first, w.drop("status")], "portal_id")


@query("""SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 20""")
def q_cut_searches(s, d):
    return files.cut_searches(table(s, d, "events").select("event_type", "user_id"), ["event_type", "user_id"], 20)


@query("""SELECT id FROM fdds WHERE id NOT IN (SELECT fdd_id FROM item19_records WHERE needs_review = false AND fdd_id IS NOT NULL)""")
def q_to_resume(s, d):
    done = table(s, d, "item19_records").select(F.col("fdd_id").alias("id"), (~F.col("needs_review")).alias("ok"))
    return sinks.to_resume(table(s, d, "fdds").select("id"), sinks.manifest_lines(done, "id"), "id")


# ------------------------------------------------------------------ sections

#: Pages of the documents: three paragraphs make a page.
_PAGES = """pages AS (SELECT doc_id, CAST(i // 3 + 1 AS INTEGER) AS page_num, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM
  (SELECT doc_id, unnest(a) AS p, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM documents WHERE text IS NOT NULL)) GROUP BY 1, 2)"""


def pages(s, d):
    t = table(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "p"))
    g = t.groupBy("doc_id", F.floor(F.col("i") / 3 + 1).cast("int").alias("page_num")).agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("x"))
    return g.select("doc_id", "page_num", F.array_join(F.transform("x", lambda y: y["p"]), "\n\n").alias("text"))


def _sql(p: str) -> str:
    return p.replace("'", "''")


_HEADS = " UNION ALL ".join(f"SELECT doc_id, page_num, {i} AS item, text FROM pages WHERE regexp_matches(text, '{_sql(sections.heading_pattern(i, t))}')" for i, t in sections.TITLES.items())


def _ranges_sql(pages_cte: str) -> str:
    return f"""WITH {pages_cte}, h AS (SELECT doc_id, item, page_num, greatest(0, len(regexp_extract_all(text, '{sections.REFERENCE}')) - 1) <= 4 AND NOT regexp_matches(text, '{sections.CONTENTS}') AND length(text) > 1500 AS good FROM ({_HEADS})),
          s AS (SELECT doc_id, item, coalesce(min(page_num) FILTER (WHERE good), max(page_num)) AS first_page FROM h GROUP BY 1, 2),
          e AS (SELECT doc_id, page_num, list_max(list_transform(regexp_extract_all(text, '{_sql(sections.NEXT_HEADING)}', 1), lambda x: TRY_CAST(x AS INTEGER))) AS high FROM pages WHERE len(regexp_extract_all(text, '{sections.REFERENCE}')) <= 5),
          l AS (SELECT doc_id, max(page_num) AS last FROM pages GROUP BY 1)
          SELECT s.doc_id, CAST(s.item AS INTEGER) AS item, s.first_page, coalesce((SELECT min(e.page_num) FROM e WHERE e.doc_id = s.doc_id AND e.page_num > s.first_page AND e.high > s.item), l.last) AS last_page FROM s JOIN l USING (doc_id)"""


@query(_ranges_sql(_PAGES))
def q_section_ranges(s, d):
    return sections.section_ranges(pages(s, d), "doc_id")


@query(f"""WITH {_PAGES} SELECT doc_id, coalesce(min(page_num) FILTER (WHERE regexp_matches(text, '(?i)item 1') AND regexp_matches(text, '(?i)fee') AND length(text) < 2500), 1) AS page FROM pages GROUP BY 1""")
def q_body_start(s, d):
    return sections.body_start(pages(s, d), "doc_id", "(?i)item 1", "(?i)fee")


_COVER = " + ".join(f"CASE WHEN regexp_matches(text, '{_sql(p)}') THEN {w} ELSE 0 END" for p, w in sections.COVER_SIGNS)


@query(f"""WITH {_PAGES}, o AS (SELECT doc_id, page_num, {_COVER} AS s, regexp_matches(text, '{sections.COVER_DATE}') AS d FROM pages WHERE page_num <= 25),
          b AS (SELECT doc_id, page_num, s + CASE WHEN d OR coalesce(lead(d) OVER (PARTITION BY doc_id ORDER BY page_num), false) THEN 1 ELSE 0 END AS s FROM o)
          SELECT doc_id, CAST(CASE WHEN max(s) >= 4 THEN arg_max(page_num, s * 1000 - page_num) ELSE 1 END AS INTEGER) AS page, CAST(max(s) AS INTEGER) AS score FROM b GROUP BY 1""")
def q_cover_page(s, d):
    return sections.cover_page(pages(s, d), "doc_id")


@query(f"""WITH {_PAGES} SELECT doc_id, 1 AS item, string_agg(chr(10) || '--- page ' || page_num || ' ---' || chr(10) || text, '' ORDER BY page_num) AS text FROM pages WHERE page_num <= 2 GROUP BY 1""")
def q_section_text(s, d):
    p = pages(s, d)
    r = p.select("doc_id").distinct().select("doc_id", F.lit(1).alias("item"), F.lit(1).alias("first_page"), F.lit(2).alias("last_page"))
    return sections.section_text(p, r, "doc_id", 10**9)


_MARKED = """pages AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_num, text FROM (SELECT doc_id, unnest(a) AS text, unnest(range(len(a))) AS i FROM
  (SELECT doc_id, string_split(regexp_replace(text, '(?m)^Page [0-9]+$', chr(12), 'g'), chr(12)) AS a FROM documents WHERE text IS NOT NULL)))"""


@query(_ranges_sql(_MARKED))
def q_section_scan(s, d):
    """Item sections of the documents, pages parted at their page marks."""
    docs = table(s, d, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^Page \d+$", "\f").alias("text"))
    return sections.section_ranges(sections.pages_of(docs, "doc_id", "text"), "doc_id")

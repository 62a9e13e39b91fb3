from pyspark.sql import functions as F

from discloom.operators import textmine as M


def test_names_dates_phrases(spark):
    t = "FRANCHISE DISCLOSURE DOCUMENT\nAcme Grill Franchising, LLC\n1 Main St\nIssuance date: April 5, 2024. You could earn, hypothetically, more."
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, t string")
    r = {x.k: x for x in df.select("k", M.company_in_text(F.col("t")).alias("n"), M.date_in_text(F.col("t")).alias("d"), M.has_phrase(F.col("t"), ["you could earn"]).alias("p")).collect()}
    assert (r[1].n, str(r[1].d), r[1].p) == ("Acme Grill Franchising, LLC", "2024-04-05", True)
    assert (r[2].n, r[2].d, r[2].p) == (None, None, False) == (r[3].n, r[3].d, r[3].p)
    hits = M.phrase_hits(df, "k", "t", ["(?i)hypothetical", "zzz"]).collect()
    assert [(h.k, h.pattern_no) for h in hits] == [(1, 0)] and "hypothetically" in hits[0].context
    ok = df.select(M.plausible_company(F.lit("Acme Grill LLC"), ["table of"], ["ohio"]).alias("a"), M.plausible_company(F.lit("the franchisor"), [], ["ohio"]).alias("b")).first()
    assert ok.a and not ok.b


def test_prefix_freshness_active(spark):
    p = "Average gross sales of franchised outlets "
    df = spark.createDataFrame([([p + "in northern towns", p + "in southern towns"],), (["a", "b"],)], "x array<string>")
    got = df.select(M.without_common_prefix(F.col("x")).alias("y")).collect()
    assert got[0].y == ["northern towns", "southern towns"] and got[1].y == ["a", "b"]
    f = spark.createDataFrame([("5 mo old",), ("1 yr old",), ("2 yr old",), (None,)], "c string")
    assert [r[0] for r in f.select(M.freshness_tier(F.col("c"))).collect()] == ["current", "aging", "stale", None]
    a = spark.createDataFrame([("k", "Registered", "9/1/2025", 1), ("k", "Registered", "12/1/2025", 2), ("k", "Expired", "12/9/2025", 3)], "k string, s string, d string, i int")
    assert M.latest_active(a, "k", "s", "d").first().i == 2 and M.latest_active(a, "k", "s", "d", legacy=True).first().i == 1
    s = spark.createDataFrame([(None, "Gross Sales by Job Size"), ("franchisee", "Gross Sales by Job Size"), (None, None), ("market-area", "x")], "s string, w string")
    assert [r[0] for r in s.select(M.non_unit_metric(F.col("s"), F.col("w"), [r"(?i)\bby\s+job\b"])).collect()] == [True, False, False, True]

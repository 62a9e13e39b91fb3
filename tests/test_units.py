from discloom.operators import units as U

S = "id long, fdd_id long, metric_name string, metric_raw string, raw_text string, notes string, unit_period string, value_median double, scale string"


def rows(spark, *r):
    return spark.createDataFrame([(i, 1, *x, "clash") for i, x in enumerate(r)], S)


def test_words_before_field_before_default(spark):
    df = rows(
        spark,
        ("gross_sales", "Average Weekly Unit Sales", None, None, "annual", 1.0),
        ("gross_sales", "Gross Sales", None, "Dollars in thousands", "per month", 2.0),
        ("gross_sales", "Gross Sales", None, None, None, 3.0),
        ("gross_sales", "Annual Sales, compiled from weekly reports", None, None, "weekly", 4.0),
        ("gross_sales", "Half-Year EBITDA (in millions)", None, None, None, 5.0),
        ("gross_sales", "Sales per 4-Week Period", None, None, "annual", 6.0),
        ("gross_sales", "Net Sales", None, None, "every two weeks", 7.0),
        ("transactions", "Transactions per Week", None, None, None, 8.0),
        ("net_profit", "Net Profit per Month", None, None, None, None),
        ("net_profit", None, None, None, "bogus", 9.0),
        ("net_profit", "Gross Sales of Units Open Every Day of the Year", None, None, None, 9.0),
        ("net_profit", "Sales each day, all days open", "Sales each day, all days open 9", None, None, 9.0),
    )
    got = {r.id: (r.per_year, r.scale) for r in U.foreign_units(df).collect()}
    assert got == {0: (52, 1), 1: (12, 1000), 4: (2, 1000000), 5: (13, 1), 6: (26, 1), 11: (365, 1)}
    money = {r.id: r.usd_year for r in U.common_units(df).collect()}
    assert money[1] == 24000 and money[2] == 3 and money[8] is None and 7 not in money
    assert U.foreign_units(df.limit(0)).count() == 0
    wide = U.to_common_units(df)
    assert wide.columns.count("scale") == 1 and wide.count() == 12


def test_every_spelling_reaches_its_factor(spark):
    flat = [(a, k) for k, g in U.PERIODS.items() for a in g]
    df = rows(spark, *[("gross_sales", f"Sales ({a.upper()}) x", None, None, None, 1.0) for a, _ in flat])
    got = {r.id: r.per_year for r in U.to_common_units(df).collect()}
    assert [got[i] for i in range(len(flat))] == [k for _, k in flat]


def test_source_defaults_and_figures_in_text(spark):
    rows = [(1, "a", None, "Sales 1,250.5 (stores)", None), (2, "a", 3.0, None, "weekly"), (3, "b", 2.0, None, None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, src string, value_median double, raw_text string, unit_period string").selectExpr("*", "'' as metric_raw", "'' as notes")
    own = spark.createDataFrame([("a", 12, 1000)], "src string, per_year int, scale int")
    got = {r.id: r.value_usd_year for r in U.to_common_units(df, figure="raw_text", source="src", source_defaults=own).collect()}
    assert got == {1: 1250.5 * 12 * 1000, 2: 3.0 * 52 * 1000, 3: 2.0, 4: None}

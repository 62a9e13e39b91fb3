import json

from discloom.operators import drift as D

S = "row_id long, feed_id long, file_no int, item_kind string, line_no int, payload string, kind string"


def feed(spark, *files, feed_id=1, kind="item7_investment"):
    rows, i = [], 0
    for no, payloads in files:
        for p in payloads:
            i += 1
            rows.append((i, feed_id, no, kind, i, p if p is None or isinstance(p, str) else json.dumps(p), "clash"))
    return spark.createDataFrame(rows, S)


def found(df):
    return sorted(tuple(r) for r in D.changes(df).collect())


def test_changes(spark):
    df = feed(
        spark,
        (3, [{"notes": "Indexed each January", "low": 100, "gone": 1}, "{broken", None]),
        (5, [{"Notes": "Indexed each January", "low": "$120"}, {"Notes": None, "low": "130"}, {"Notes": None, "low": "130"}]),
        (6, [{"Notes": "Indexed each January", "low": None}]),
        (9, [{"Notes": ["Indexed each January"], "low": 5, "new": {"inner": 1}}]),
    )
    assert found(df) == [
        (1, 5, "removed", "gone", ""),
        (1, 5, "renamed", "notes", "Notes"),
        (1, 5, "retyped", "low", "low"),
        (1, 9, "added", "", "new"),
        (1, 9, "retyped", "Notes", "Notes"),
        (1, 9, "retyped", "low", "low"),
    ]


def test_nested_fields_and_unlike_content(spark):
    df = feed(
        spark,
        (1, [{"records": [{"year": 2020, "n": 3}, 0], "confidence": 0.5}]),
        (2, [{"records": [{"year": 2021, "m": "word"}], "capital": 250000}]),
        kind="item19_fpr",
    )
    assert found(df) == [
        (1, 2, "added", "", "capital"),
        (1, 2, "added", "", "records.m"),
        (1, 2, "removed", "confidence", ""),
        (1, 2, "removed", "records.n", ""),
    ]


def test_names_that_stand_together_are_no_renames(spark):
    df = feed(
        spark,
        (1, [{"tech_fee": 500, "x": 1}]),
        (2, [{"min_fee": 500, "x": 1}]),
        (3, [{"min_fee": 500, "tech_fee": 500, "x": 1}]),
    )
    assert [r for r in found(df) if r[2] == "renamed"] == []


def test_empty_and_single(spark):
    df = feed(spark, (1, [{"a": 1}]))
    assert found(df) == [] and found(df.limit(0)) == []
    assert D.failed_casts(df).count() == 0


def test_consistent_table(spark):
    df = feed(
        spark,
        (1, [{"total": 100, "ok": True}] * 20),
        (2, [{"Total": "$1,200", "ok": "no"}, {"Total": "n/a"}, "{"]),
    )
    t = D.consistent_table(df, "item7_investment")
    assert t.columns == ["row_id", "feed_id", "file_no", "ok", "total"] and t.count() == 23
    assert {r.row_id: (r.total, r.ok) for r in t.collect()}[21] == (1200.0, False)
    bad = D.failed_casts(df).collect()
    assert [(r.field, r.n_failed, r.example) for r in bad] == [("Total", 1, "n/a")]


def test_records_have_a_typed_table(spark):
    df = feed(
        spark,
        (1, [{"records": [{"reporting_year": "2019", "ok": "yes"}, 7, {"reporting_year": 2020}], "x": [1, 2]}] * 4),
        (2, [{"records": {"reportingYear": "2021"}}, {"records": [{"reportingYear": "soon"}]}, {"records": None}, "{"]),
        kind="item19_fpr",
    )
    t = D.records_table(df, "item19_fpr")
    assert t.columns == ["row_id", "feed_id", "file_no", "record_no", "ok", "reporting_year"]
    rows = sorted((r.row_id, r.record_no, r.reporting_year, r.ok) for r in t.collect())
    assert rows[:2] == [(1, 0, 2019.0, True), (1, 2, 2020.0, None)] and rows[-2:] == [(5, 0, 2021.0, None), (6, 0, None, None)]
    bad = [(r.field, r.kind, r.n_failed, r.example) for r in D.failed_casts(df).collect()]
    assert bad == [("records.reportingYear", "double", 1, "soon")]
    assert D.consistent_table(df, "item19_fpr").filter("row_id = 1").first().x == "[1,2]"
    assert D.records_table(df.limit(0), "item19_fpr").count() == 0

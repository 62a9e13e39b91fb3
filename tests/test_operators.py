"""Small fixtures: nulls, ties, repeated rows, empty tables, clashing names."""

import statistics

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from discloom.functions import cols as C
from discloom.operators import entity, filters, growth, latest, relate, sections, stats, validate
from discloom.sources import sinks
from discloom.streaming import jobs


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", int: "int", float: "double"}[type(v)]) for k, v in values.items())))
    return row.select(expr.alias("x")).first().x


def test_nice_round_half_even(spark):
    df = spark.createDataFrame([(97500.0,), (92500.0,), (-600000.0,), (None,)], "v double")
    assert [r[0] for r in df.select(C.nice_round(F.col("v"))).collect()] == [100000, 90000, 600000, None]


def test_annual_multiplier(spark):
    df = spark.createDataFrame([("weekly", None), (None, "Average Weekly Unit Sales"), (None, "RevPAR"), (None, None), ("odd", "per month")], "u string, w string")
    assert [r[0] for r in df.select(C.annual_multiplier(F.col("u"), F.col("w"))).collect()] == [52, 52, 365, 1, 12]


def test_text_functions(spark):
    k = lambda s: one(spark, C.compact_key(F.col("s")), s=s)
    assert [k(x) for x in ("Domino's Pizza", "DOMINO'S PIZZA", "Dominos Pizza", "RE/MAX")] == ["dominospizza"] * 3 + ["remax"]
    assert one(spark, C.slug(F.col("s")), s="--A & B!--") == "a-b" and one(spark, C.slug(F.col("s")), s="!!") == "unknown"
    assert one(spark, C.strip_html(F.col("s")), s="<p>a&amp;b<br>c &lt;</p>") == "a&b c <"
    assert one(spark, C.strip_fence(F.col("s")), s='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, C.csv_field(F.col("s")), s='a"b,c') == '"a""b,c"'
    assert one(spark, C.word_count(F.col("s")), s=" a  b\nc ") == 3 and one(spark, C.word_count(F.col("s")), s="  ") == 0
    assert one(spark, C.trim_number(F.col("v")), v=6.5) == "6.5" and one(spark, C.trim_number(F.col("v")), v=6.0) == "6"
    assert one(spark, C.money_short(F.col("v")), v=1_250_000.0) == "$1.3M"
    assert one(spark, C.title_label(F.col("s"), "home-", {"Hvac": "HVAC"}), s="home-hvac-repair") == "HVAC Repair"
    assert str(one(spark, C.any_date(F.col("s")), s="4/2/25")) == "2025-04-02" and one(spark, C.any_date(F.col("s")), s="soon") is None
    assert one(spark, C.folded_slug(F.col("s"), "inc|llc"), s="Café Müller, LLC") == "cafe-muller"
    assert one(spark, C.truncated(F.col("s"), 5), s="abcdefgh") == "abcd…"
    assert one(spark, C.deep_link(F.col("s"), F.lit(3)), s="http://x/a.pdf") == "http://x/a.pdf#page=3"


def test_latest_ties_nulls_empty(spark):
    df = spark.createDataFrame([(7, 1, 2026), (9, 1, 2025), (3, None, None), (4, None, 2020), (4, None, 2020)], "id int, g int, y int")
    assert sorted(r.id for r in latest.latest(df, ["g"], ["id"]).collect()) == [4, 9]
    assert sorted(r.id for r in latest.latest(df, ["g"], ["y", "id"]).collect()) == [4, 7]
    assert latest.latest(df.limit(0), ["g"], ["id"]).count() == 0
    top = latest.top_k(df, ["g"], [F.desc("id")], 1)
    assert top.columns[-1] == "rank" and top.count() == 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=12))
def test_order_statistics(spark, xs):
    df = spark.createDataFrame([(1, float(x)) for x in xs] + [(1, None)], "g int, v double")
    s, n = sorted(xs), len(xs)
    assert stats.median(df, ["g"], "v").first().median == statistics.median(xs)
    assert stats.upper_median(df, ["g"], "v").first().upper_median == s[n // 2]
    near = stats.nearest_rank(df, ["g"], "v", (25, 75)).first()
    if n < 3:
        assert near is None
    else:
        assert (near.p25, near.p75) == (s[round(0.25 * (n - 1))], s[round(0.75 * (n - 1))])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-1, 6)), min_size=1, max_size=10))
def test_other_medians_by_brute_force(spark, rows):
    df = spark.createDataFrame([(i, g, float(v)) for i, (g, v) in enumerate(rows)], "k int, g int, v double")
    got = {r.k: (r.n_peers, r.peer_median) for r in relate.other_medians(df, "k", "g", "v").collect()}
    for i, (g, _) in enumerate(rows):
        peers = [v for j, (h, v) in enumerate(rows) if h == g and j != i]
        pos = [v for v in peers if v > 0]
        assert got[i] == (len(peers), statistics.median(pos) if pos else None)


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (None,), (99.0,)], "v double")
    assert [r.n for r in stats.histogram(df, "v", (0, 10, 20, 30)).orderBy("bin").collect()] == [1, 1, 0]


def test_growth(spark):
    df = spark.createDataFrame([("a", 2021, 100), ("a", 2022, 110), ("a", 2023, 150), ("a", 2024, None), ("b", 2021, 0), ("b", 2022, 4)], "g string, y int, n int")
    r = {x.g: x for x in growth.year_over_year(df, ["g"], "y", "n").collect()}
    assert r["a"].yoy_pct == 36.4 and r["b"].yoy_pct is None
    f = growth.first_last(df, ["g"], "y", "n").collect()
    assert [(x.g, x.growth_abs, x.growth_pct) for x in f] == [("a", 50, 50.0)]
    assert one(spark, growth.direction(F.col("v")), v=50.0) == "rapidly-growing"


def test_entities(spark):
    known = spark.createDataFrame([(1, "k", "food", "MN"), (2, "k", "food", "WI"), (3, "", "food", "WI")], "id int, name_key string, industry string, state string")
    new = spark.createDataFrame([("k", "food", "WI"), ("k", "food", None), ("k", None, "WI"), ("", "food", "WI")], "name_key string, industry string, state string")
    assert [r.match_id for r in entity.match_entity(new, known).collect()].count(None) == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    c = {r.node: r.component for r in entity.link_components(chain).collect()}
    assert set(c.values()) == {0, 100} and len(c) == 43
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, site string")
    upd = spark.createDataFrame([(1, "A", "s"), (2, "B", "y"), (3, "c", None)], "id int, name string, site string")
    got = {r.id: (r.name, r.site) for r in entity.upsert(old, upd, "id", fill_only=["name", "site"]).collect()}
    assert got == {1: ("a", "s"), 2: ("b", "x"), 3: ("c", None)}
    assert entity.append_new(old, upd, "id", "name").count() == 3
    facts = spark.createDataFrame([(2, 5), (9, 6)], "id int, v int")
    plan = spark.createDataFrame([(2, 1)], "id int, keeper int")
    assert sorted(r.id for r in entity.repoint(facts, plan, "id").collect()) == [1, 9]


def test_contains_pairs_by_brute_force(spark):
    a, b = ["subway", "sub", "abcdef", "xx", None, "", "abcdef"], ["way", "subwayinc", "abcde", "xx", "zabcdefz"]
    got = {(r.a_key, r.b_key) for r in relate.contains_pairs(spark.createDataFrame([(x,) for x in a], "key string"), spark.createDataFrame([(x,) for x in b], "key string"), 3).collect()}
    want = {(x, y) for x in a if x for y in b if x == y or (len(y) >= 3 and y in x) or (len(x) >= 3 and x in y)}
    assert got == want


def test_validation(spark):
    df = spark.createDataFrame([("30", "abc", 1), ("$7.5", None, 2)], "royalty_pct string, tech string, quality_flag int")
    rows = validate.bounded(df, {"royalty_pct": (0, 25), "tech": (0, 10)}).collect()
    assert rows[0].quality_flag == "royalty_pct=30_out_of_range; tech=non_numeric" and rows[1].royalty_pct == 7.5 and rows[1].quality_flag is None
    pair = validate.ordered_pair(spark.createDataFrame([(50, 40), (None, 1)], "low int, high int"), "low", "high", "sw").collect()
    assert [(r.low, r.high, r.sw) for r in pair] == [(40, 50, True), (None, 1, False)]
    j = spark.createDataFrame([([(100, 200, "a"), (80, 150, None)],)], "x array<struct<low:int,high:int,note:string>>")
    assert tuple(j.select(validate.flattened(F.col("x"), "low", "high", "note").alias("f")).first().f) == (80, 200, "a")
    s = spark.createDataFrame([(1, "f", 10), (1, "c", 3), (1, "t", 15), (2, "f", 10), (2, "c", 3), (2, "t", 14)], "g int, k string, n int")
    assert [r.g for r in validate.sums_up(s, ["g"], "k", "n", ["f", "c"], "t").collect()] == [1]
    assert validate.audit_passes(validate.audit([(2, "x", spark.createDataFrame([(1, "d")], "key int, detail string"))]))
    assert validate.hash_sample(s, 2).collect() == validate.hash_sample(s.repartition(5), 2).collect()


def test_filter_spec_round_trip_and_nulls(spark):
    spec = filters.Spec(contains={"n": "A"}, least={"v": 0, "w": 2}, has={"n": True}, sort="v", descending=True, limit=2)
    back = filters.Spec.from_params(spec.to_params())
    df = spark.createDataFrame([("a", None, 3), ("Ba", 5, 2), ("c", 9, 9), (None, 1, 9), ("a", 7, None)], "n string, v int, w int")
    assert [r.n for r in back.apply(df).collect()] == ["Ba", "a"]
    assert df.filter(filters.within_budget(F.col("v"), 4)).count() == 2


def test_sections(spark):
    long = "x " * 900
    contents = "TABLE OF CONTENTS\nITEM 5 INITIAL FEES ..... 3\nITEM 6 OTHER FEES ..... 4"
    four = "Item 1, Item 2, Item 3 and Item 4"
    docs = spark.createDataFrame(
        [
            # With its title anywhere, beside four other references; ends where a higher item is headed with a title.
            (1, f"{contents}\fsee ITEM 5 - Initial Fees {four} {long}\fmore\f6. OTHER FEES\n{long}\fITEM 7 ESTIMATED INITIAL INVESTMENT {long}"),
            # Alone on a line; five other references are too many, so the last page that heads it.
            (2, f"ITEM 5\n{four} Item 9 Item 8 {long}\fITEM 5\nshort\fend"),
            (3, None),
            (4, ""),
            (5, f"as defined in Item 5 of it {long}"),
        ],
        "doc int, text string",
    )
    pages = sections.pages_of(docs, "doc", "text")
    got = {(r.doc, r.item): (r.first_page, r.last_page) for r in sections.section_ranges(pages, "doc").collect()}
    assert got == {(1, 5): (2, 5), (1, 6): (4, 5), (1, 7): (5, 5), (2, 5): (2, 3)}
    dated = spark.createDataFrame([(1, 1, "FRANCHISE DISCLOSURE DOCUMENT"), (1, 2, "Issuance Date: May 1. www.x.com 12345 Acme LLC"), (2, 1, "x")], "doc int, page_num int, text string")
    assert sorted(map(tuple, sections.cover_page(dated, "doc").collect())) == [(1, 2, 5), (2, 1, 0)]
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "first"), (1, 3, "first")], "doc int, page_num int, text string")
    assert sections.cover_page(pages, "doc", [("(?i)first", 5)]).filter("doc = 1").first().page == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f'n"{i},') for i in range(57)], "id int, n string")
    n = sinks.numbered(df.repartition(5), ["id"]).collect()
    assert sorted((r.id, r.position) for r in n) == [(i, i + 1) for i in range(57)]
    assert sorted({r.batch for r in sinks.batches(df, ["id"], 20).collect()}) == [0, 1, 2]
    sinks.csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert {r.n for r in back.collect()} == {r.n for r in df.collect()}
    sinks.json_lines(df, str(tmp_path / "j"), by=["id"])
    assert spark.read.json(str(tmp_path / "j")).count() == 57


def test_sources(spark, tmp_path):
    from pyspark.sql import types as T

    from discloom.sources import files

    for stem, text in (("a", '{"x": 1}'), ("b", '{"x": 1'), ("c", '{"_section_not_found": true}')):
        (tmp_path / stem).mkdir()
        (tmp_path / stem / "item.json").write_text(text)
    d = files.json_documents(spark, f"{tmp_path}/*/item.json", T.StructType([T.StructField("x", T.IntegerType())]))
    exp = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "stem string")
    assert {r.stem: r.status for r in files.expected_status(d, exp).collect()} == {"a": "ok", "b": "parse_error", "c": "section_not_found", "d": "missing"}
    m = spark.createDataFrame([('{"extractions": {"s": {"ok": true}, "t": {"ok": false}}}',)], "m string")
    assert sorted((r.stem, r.ok) for r in files.manifest(m, "m", "ok boolean").collect()) == [("s", True), ("t", False)]
    names = files.name_list(spark.createDataFrame([(" A ",), ("a",), (None,), ("",), ("b",)], "value string"))
    assert sorted(r.name for r in names.collect()) == ["A", "b"]
    x = spark.createDataFrame([("<urlset><url><loc> u1 </loc></url><url><loc>u2</loc></url></urlset>",)], "x string")
    assert files.sitemap_urls(x, "x").count() == 2
    p = files.portal_lines(spark.createDataFrame([(1, "head\n123456  A Co\tRegistered\n12 x")], "k int, t string"), "k", "t")
    assert [r.fields for r in p.collect()] == [["123456", "A Co", "Registered"]]
    assert files.inventory(spark, str(tmp_path), "*.json").agg(F.sum("n_files")).first()[0] == 3


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h2")], "id int, sha string").coalesce(1)
    src, out, idx, ck = (str(tmp_path / x) for x in ("src", "out", "idx", "ck"))
    df.write.parquet(src)
    stream = lambda: jobs.file_stream(spark, src, df.schema)
    jobs.first_seen_by_hash(stream(), idx, out, ck)
    spark.createDataFrame([(4, "h2"), (5, "h3"), (6, None)], df.schema).coalesce(1).write.mode("append").parquet(src)
    jobs.first_seen_by_hash(stream(), idx, out, ck)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3, 5]
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(f"{src}-e")
    s = jobs.tumbling(jobs.file_stream(spark, f"{src}-e", ev.schema), "ts", "1 hour", "event_type", "value", late="60 days")
    q = s.writeStream.format("memory").queryName("tumb").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumb").agg(F.sum("n")).first()[0] == ev.count()
    log = spark.createDataFrame([("a", "failed"), ("a", "failed"), ("a", "failed"), ("b", "rate_limited"), ("b", "failed"), ("c", "ok")], "stem string, outcome string")
    assert {r.stem: r.state for r in jobs.attempts(log).collect()} == {"a": "given_up", "b": "retry", "c": "done"}


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    import sqlite3

    from discloom.sources import files

    at = str(tmp_path / "x.db")
    con = sqlite3.connect(at)
    con.execute('CREATE TABLE "a b" (id INTEGER, name TEXT, other BLOB)')
    con.executemany('INSERT INTO "a b" VALUES (?, ?, NULL)', [(i, None if i == 3 else f"n{i}") for i in range(25)])
    con.execute("CREATE TABLE empty_one (id INTEGER)")
    con.commit()
    con.close()
    rows = sorted(map(tuple, files.sqlite_table(spark, at, "a b", "id bigint, name string", 4).collect()))
    assert rows == [(i, None if i == 3 else f"n{i}") for i in range(25)]
    assert files.sqlite_table(spark, at, "empty_one", "id bigint").count() == 0


def test_pdf_needs_its_library(spark):
    import importlib.util

    import pytest

    from discloom.sources import files

    if importlib.util.find_spec("pypdf") is None:
        with pytest.raises(RuntimeError, match="pypdf"):
            files.pdf_pages(spark.createDataFrame([(1, b"")], "k int, c binary"), "k", "c")


def test_create_resume_and_copies(spark, tmp_path):
    from discloom.operators import entity
    from discloom.sources import sinks

    at = str(tmp_path / "t")
    assert sinks.create_if_absent(spark, at, "id int, a string").count() == 0
    spark.createDataFrame([(1, "x")], "id int, a string").write.mode("append").parquet(at)
    assert sinks.create_if_absent(spark, at, "id int, a string, b double").first() == (1, "x", None)
    done = sinks.manifest_lines(spark.createDataFrame([(1, True), (2, False), (2, True), (3, None)], "id int, ok boolean"), "id")
    assert sorted(r.id for r in sinks.to_resume(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int"), done, "id").collect()) == [3, 4]
    df = spark.createDataFrame([(1, "h", "acme", "out1"), (2, "h", "b", None), (3, "g", "acme", None), (4, None, None, None)], "id int, sha string, slug string, out string")
    keyed = entity.content_keys(df, F.col("slug"), F.lit(None), F.lit(2024))
    same = entity.first_of_content(keyed, "sha", "id")
    assert sorted(map(tuple, same.collect())) == [(2, 1, "sha"), (3, 1, "content")]
    got = sorted((r.id, r.out, r.source_id, r.method) for r in sinks.copied_from(df, same, "id", ["out"]).collect())
    assert got == [(2, "out1", 1, "sha"), (3, "out1", 1, "content")]
    assert entity.first_of_content(keyed.limit(0), "sha", "id").count() == 0

"""Shredding and reconstruction against a plain walk of the same documents."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from discloom.operators import nested as N

DATA = "/root/testdata/sf0.001/raw_extractions.parquet"
SECTION = {"item19_record": ("item19_fpr", ("records", "metrics"), "cohort_raw"),
           "yearly_summary": ("item20_outlets", ("yearly_summary",), "outlet_type"),
           "state_year_status": ("item20_outlets", ("state_year_status", "years"), "state")}


def plain(doc):
    """Child objects by a recursive walk; whole documents only."""
    out = []

    def walk(v, names, where, labels):
        if isinstance(v, str) and v.lstrip()[:1] in "[{" and v.strip():
            try:
                v = json.loads(v)
            except ValueError:
                return
        if isinstance(v, dict):
            for kind, (sec, keys, label) in SECTION.items():
                if names and names[-1] in keys and sec in names[:-1]:
                    own = [x[label] for x in [v, *reversed(labels)] if isinstance(x.get(label), str)]
                    child, parent = (where[-1], where[-2] if len(where) > 1 else 0) if v.get("__el") else (0, where[-1] if where else 0)
                    out.append((kind, parent, child, own[0] if own else ""))
            for k, x in v.items():
                walk(x, [*names, k], where, [*labels, v])
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    x = {**x, "__el": True}
                walk(x, names, [*where, i], labels)

    walk(doc, [], [], [])
    return sorted(out)


def rows_of(text):
    tree, _ = N.read_json(text)
    return sorted(r[:4] for r in N.assemble_leaves(N.shred_tree(tree) if tree is not None else {}, N.FPR_CHILDREN))


def test_whole_documents_match_a_plain_walk():
    import pyarrow.parquet as pq

    n = 0
    for p in pq.read_table(DATA).column("payload").to_pylist():
        try:
            doc = json.loads(p)
        except ValueError:
            continue
        n += 1
        assert rows_of(p) == plain(doc)
    assert n > 20


def test_cut_off_documents_keep_every_closed_child():
    doc = {"item19_fpr": {"records": [{"cohort_raw": "a", "percentiles": {"p25": 1}}, 0, {"cohort_raw": "b"}]},
           "item20_outlets": {"states": [{"state": "WI", "years": [{"year": 1}, {"year": 2}]}]}}
    text = json.dumps(doc)
    whole = rows_of(text)
    assert whole == [
        ("item19_record", 0, 0, "a"), ("item19_record", 0, 2, "b"),
        ("state_year_status", 0, 0, "WI"), ("state_year_status", 0, 1, "WI"),
    ]
    for cut in range(len(text)):
        part = rows_of(text[:cut])
        closed = [r for r, end in zip(whole, ['"p25": 1}}', '"b"}', '"year": 1}', '"year": 2}'], strict=True) if end in text[:cut]]
        assert part == closed, text[:cut]


def test_wrapping_strings_and_standing_objects():
    inner = json.dumps([{"cohort_raw": "x"}, None, {"cohort_raw": None}])
    assert rows_of("```json\n" + json.dumps({"item19_fpr": {"records": inner}}) + "\n```") == [("item19_record", 0, 0, "x"), ("item19_record", 0, 2, "")]
    assert rows_of(json.dumps({"item19_fpr": [{"records": {"cohort_raw": "y"}}, {"records": [{"cohort_raw": 3}]}]})) == [
        ("item19_record", 0, 0, "y"),
        ("item19_record", 1, 0, ""),
    ]
    assert rows_of(json.dumps({"item19_fpr": {"cohorts": [7, {"cohort_raw": "c", "metrics": [0, {"a": 1}, {"cohort_raw": "d"}]}]}})) == [
        ("item19_record", 1, 1, "c"),
        ("item19_record", 1, 2, "d"),
    ]
    for empty in (None, "", "  ", "no json", "{", "[]", "null", "3", '"x"', "```json\n```"):
        assert rows_of(empty) == []


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=3),
    lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from("abc"), c, max_size=3),
    max_leaves=20,
)


def rebuild(leaves):
    """The tree from its leaf columns: an exact round trip of the levels."""
    places = {}
    for path, (r, d, v) in leaves.items():
        for where, x, lev in zip(N.positions(r, d, path.count(N.STEP)), v, d, strict=True):
            places.setdefault(path, {})[where] = (lev, x)

    def value(path, where):
        mark = places.get((*path, N.MARK), {}).get(where)
        if mark and mark[1] is not None:
            out = {}
            for k in {p[len(path)] for p in leaves if len(p) > len(path) and p[: len(path)] == path} - {N.MARK, N.STEP, N.STEP[0]}:
                ok, x = value((*path, k), where)
                if ok:
                    out[k] = x
            return True, out
        el = places.get((*path, N.STEP, N.STEP[0]), {})
        items = [w for w in el if w[: len(where)] == where and el[w][1] is not None and len(w) == len(where) + 1]
        if items:
            return True, [value((*path, N.STEP), w)[1] for w in sorted(items)]
        leaf = places.get(path, {}).get(where)
        if leaf is None:
            return False, None
        x = leaf[1]
        return (True, None if x is None else {"s": str, "n": json.loads, "b": json.loads}[x[0]](x[1:]))

    return value((), ())[1]


def normal(v, top=True):
    """Nulls, empty containers and absent values are one and the same."""
    if isinstance(v, dict):
        return {k: y for k, x in v.items() if (y := normal(x, False)) is not None} or ({} if top else None)
    if isinstance(v, list):
        return [normal(x, False) for x in v] or None
    return v


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abc"), json_values, max_size=3))
def test_round_trip(tree):
    assert normal(rebuild(N.shred_tree(tree))) == normal(tree)


def test_tables(spark):
    doc = {"metadata": {"legal_name": "L", "filing_year": "2020"}, "item19_fpr": {"has_item19": "yes", "records": [{"cohort_raw": "a", "outlet_count": "1,200", "value_median": 3.5}]},
           "item20_outlets": {"yearly_summary": [{"year": 2019, "outlet_type": "total", "outlets_end": "7"}]}}
    df = spark.createDataFrame(
        [(1, 5, json.dumps(doc), "z"), (1, 5, json.dumps(doc), "z"), (2, None, None, None), (3, 6, "", "q")],
        "raw_id long, fdd_id long, payload string, label string",
    )
    got = N.child_rows(df).collect()
    assert sorted((r.raw_id, r.child_kind) for r in got) == [(1, "item19_record")] * 2 + [(1, "yearly_summary")] * 2
    f = {r.raw_id: r for r in N.filings_table(df).collect()}
    assert (f[1].has_item19, f[1].filing_year, f[1].state) == (True, 2020, "ok") and f[2].state == f[3].state == "empty"
    a = N.item19_table(df).first()
    assert (a.outlet_count, a.value_median, a.cohort_raw) == (1200, 3.5, "a")
    b = N.item20_table(df).first()
    assert (b.state, b.outlet_type, b.outlets_end) == ("TOTAL", "total", 7)
    empty = df.limit(0)
    assert N.child_rows(empty).count() == 0 and N.filings_table(empty).count() == 0


def test_one_pass_equals_two_steps(spark):
    df = spark.read.parquet(DATA)
    names = ["raw_id", "child_kind", "parent_no", "child_no", "label", "path", "place"]
    text = lambda d: sorted(str((*(r[n] for n in names), sorted(r["fields"].items()))) for r in d.collect())
    assert text(N.children_of(df)) == text(N.assemble(N.shred(df)))
    rows = N.children_of(df, fields=False)
    assert rows.count() == rows.select("raw_id", "path", "place").distinct().count()


def test_parents_of_nested_arrays(spark):
    years = lambda *ys: [{"year": y, "outlets_end": 1} for y in ys]
    doc = {"item20_outlets": {"state_year_status": [{"state": "OH", "years": years(2019, 2020)}, {"state": "UT", "years": years(2019)}]}}
    df = spark.createDataFrame([(1, json.dumps(doc))], "raw_id long, payload string")
    got = sorted((r.path, tuple(r.place), r.label, r.n_children) for r in N.parents_table(df).collect())
    assert got == [("item20_outlets.state_year_status[]", (0,), "OH", 2), ("item20_outlets.state_year_status[]", (1,), "UT", 1)]


def test_any_depth_is_read():
    child = '{"item19_fpr": {"records": [{"cohort_raw": "deep"}]}}'
    text = '{"a": ' * 5000 + child + "}" * 5000
    assert [r[:4] for r in N.assemble_leaves(N.shred_tree(N.read_json(text)[0]), N.FPR_CHILDREN)] == [("item19_record", 0, 0, "deep")]
    cut = N.read_json("[" * 30000)[0]
    assert N.shred_tree(cut) and list(N.assemble_leaves(N.shred_tree(cut), N.FPR_CHILDREN)) == []

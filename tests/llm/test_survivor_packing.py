import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from discloom.llm import packing as P
from discloom.llm import survivor as S
from tests.compare import DATA, connection, same

FDDS = "id long, franchisor_id long, filing_year int, local_path string, effective_date date, parsed_at timestamp, retrieved_at timestamp, has_item19 boolean, page_count int, filing_state string, year string"


def row(i, parsed, fetched=1, year=2020, f=1, eff=dt.date(2020, 5, 1), item19=True, pages=9, path="a/2020/x.pdf"):
    t = lambda d: d and dt.datetime(*d)
    return (i, f, year, path, eff, t(parsed), dt.datetime(2021, 1, fetched), item19, pages, "WI", "clash")


def test_survivors(spark):
    df = spark.createDataFrame(
        [
            row(5, (2020, 6, 1), eff=None, pages=0),
            row(4, (2020, 5, 1), year=20, eff=dt.date(1970, 1, 1)),
            row(3, (1970, 1, 1), fetched=9, year=None, item19=None),
            row(2, None, fetched=9, year=9999, pages=-1),
            row(2, None, fetched=9, year=9999, pages=-1),
            row(7, None, f=2),
            row(8, (2020, 1, 1), f=3, pages=None),
            row(9, (2020, 1, 1), f=3, pages=None),
            row(1, None, f=None),
        ],
        FDDS,
    )
    got = {(r.group_id, r.field): r.from_id for r in S.survivors(df).collect()}
    assert got == {
        (2, "effective_date"): 2, (2, "has_item19"): 5, (2, "page_count"): 4,
        (8, "effective_date"): 8, (8, "has_item19"): 8,
    }
    assert S.survivors(df.limit(0)).count() == 0


def test_survivors_equal_sql(spark):
    same(S.survivors(spark.read.parquet(f"{DATA}/fdds.parquet")), connection(), S.survivors_sql())


def test_untimed_equals_sql(spark):
    same(S.untimed_survivors(spark.read.parquet(f"{DATA}/fdds.parquet")), connection(), S.untimed_sql())


def test_learned_precedence(spark):
    rows = []
    for g in range(3):
        rows += [(10 * g + 1, 100 + g, (2020, 1, 1), "IL"), (10 * g + 2, 100 + g, (2020, 2, 1), "WI")]
    rows += [(90, 200, None, "WI"), (91, 200, None, "IL"), (92, 201, None, "NY"), (93, 201, None, "CA")]
    df = spark.createDataFrame([(*row(i, p, f=f)[:9], s, "x") for i, f, p, s in rows], FDDS.replace("filing_state", "filing_state"))
    assert [(r.older, r.newer, r.n) for r in S.learned_precedence(df, "filing_state").collect()] == [("IL", "WI", 3)]
    got = {r.group_id: (r.latest, r.n_values, r.n_latest) for r in S.untimed_latest(df).collect()}
    assert got == {90: ("WI", 2, 1), 92: ("CA", 2, 2)}


def test_the_order_goes_by_way_of_absent_values(spark):
    """IL -> NY -> WI is learnt from neighbours only; a group of IL and WI has
    no NY.  Values that lead to each other stay unordered."""
    rows = []
    for g in range(3):
        rows += [(10 * g + 1, 100 + g, (2020, 1, 1), "IL"), (10 * g + 2, 100 + g, (2020, 2, 1), "NY")]
        rows += [(100 + 10 * g, 200 + g, (2020, 1, 1), "NY"), (100 + 10 * g + 1, 200 + g, (2020, 2, 1), "WI")]
    for i, (a, b) in enumerate((("AA", "BB"), ("BB", "CC"), ("CC", "AA"))):
        rows += [(300 + 2 * i, 300 + i, (2020, 1, 1), a), (301 + 2 * i, 300 + i, (2020, 2, 1), b)]
    rows += [(900, 400, None, "WI"), (901, 400, None, "IL"), (910, 401, None, "AA"), (911, 401, None, "CC")]
    df = spark.createDataFrame([(*row(i, p, f=f)[:9], s, "x") for i, f, p, s in rows], FDDS)
    got = {r.group_id: (r.latest, r.n_values, r.n_latest) for r in S.untimed_latest(df).collect()}
    assert got == {900: ("WI", 2, 1), 910: ("AA", 2, 2)}
    assert S.untimed_survivors(df.limit(0), ("filing_state",)).count() == 0


def test_untimed_by_hidden_times(spark):
    """Times of a quarter of the groups are hidden; their last values are known."""
    import itertools

    steps, rows, truth, i = ["draft", "filed", "review", "effective", "expired"], [], {}, 0
    for g, (a, b) in enumerate(itertools.islice(itertools.cycle([(x, y) for x in range(5) for y in range(x + 1, 5)]), 200)):
        hidden = g % 4 == 0
        for place, v in enumerate((steps[a], steps[b])):
            i += 1
            rows.append((*row(i, None if hidden else (2020, 1 + place, 1), f=g)[:9], v, "x"))
        if hidden:
            truth[i - 1] = steps[b]
    got = {r.group_id: r.latest for r in S.untimed_latest(spark.createDataFrame(rows, FDDS)).collect()}
    assert got == truth


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_packing_fits_and_wastes_little(lengths):
    sizes = (8, 16, 64)
    placed = P.pack_shard(lengths, sizes)
    load = {}
    for b, n in zip(placed, lengths, strict=True):
        load[b] = load.get(b, 0) + n
    assert all(v <= sizes[t] for (t, _), v in load.items())
    used, room = sum(lengths), sum(sizes[t] for t, _ in load)
    assert room <= 2 * used + sum(sizes)


def test_pack_covers_every_token(spark):
    texts = ["word " * 700, "", None, "a b c", "a b c", "x"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, container string")
    rows = P.pack(df, sizes=(16, 64, 256), shard_tokens=10**9).collect()
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(df).collect()}
    for i in range(len(texts)):
        mine = sorted((r.token_start, r.n_tokens) for r in rows if r.doc_id == i)
        assert sum(n for _, n in mine) == counts[i]
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False))
        assert len(mine) == (0 if not counts[i] else -(-counts[i] // 256))
    load = P.container_load(P.pack(df, sizes=(16, 64, 256))).collect()
    assert all(r.unused >= 0 for r in load)
    assert P.pack(df.limit(0)).count() == 0


def test_corpus_fill(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = P.container_load(P.pack(docs)).selectExpr("sum(used) u", "sum(capacity) c").first()
    assert t.u / t.c > 0.97

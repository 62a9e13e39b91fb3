import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from discloom.llm import crossmatch as X
from discloom.llm import names as N
from discloom.llm import variants as V


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=18), st.data())
def test_trie_and_shards_find_every_close_name(s, data):
    k = N.bound(len(s))
    t = s
    for _ in range(data.draw(st.integers(0, k))):
        p = data.draw(st.integers(0, max(0, len(t) - 1)))
        t = data.draw(st.sampled_from([t[:p] + "x" + t[p + 1 :], t[:p] + t[p + 1 :], t[:p] + "c" + t[p:]])) or t
    long, short = (s, t) if len(s) >= len(t) else (t, s)
    if N.within(s, t, N.bound(len(long))):
        assert set(N.probes_of(long)) & set(N.shards_of(short))
        trie = N.Trie()
        trie.add(short)
        assert [x for x, _ in trie.near(long, N.bound(len(long)))] == [short]


def test_trie_join_by_brute_force(spark):
    rows = pq.read_table("/root/testdata/sf0.001/franchisors.parquet").column("brand_name").to_pylist()
    names = sorted({" ".join(N.brand_parts(r, N.Words())[0]) for r in rows} - {""})[:60] + ["alpha beta gamma", "gamma alpha betta", "alphabetagamma"]
    df = spark.createDataFrame([(n, "x") for n in [*names, names[0]]] + [(None, "x"), ("", "x")], "name string, a string")
    got = {(r.a, r.b): r.distance for r in N.trie_join(df).collect()}
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = sorted((a, b))
            ja, jb = (x, y) if len(x.replace(" ", "")) >= len(y.replace(" ", "")) else (y, x)
            d = min((k for o in N.orders(ja.split()) for t in N.stored(jb.split()) for k in range(3) if N.within(o, t, k) and k <= N.bound(len(o))), default=None)
            if d is not None:
                want[(x, y)] = d
    assert {k: v for k, v in want.items() if k not in got} == {}
    assert {(r.a, r.b): r.distance for r in N.trie_join(df, shard_names=1).collect()} == got  # every shard split
    assert N.trie_join(df.limit(0)).count() == 0


WORDS = N.Words(
    [(w, 1, 50) for w in ("llc", "franchise", "systems", "inc", "holdings", "lp", "co", "delaware", "company", "limited", "liability")]
    + [(w, 40, 30) for w in ("oil", "change", "tire", "center", "grill", "coffee", "house", "lawn", "care", "yoga", "studio", "pizza")]
)


def test_name_parts():
    assert N.brand_parts("The Oil Change by Dra & Nexi(TM)", WORDS) == (["dra", "nexi"], "change oil")
    assert N.brand_parts("Tire Center, Glachal's", WORDS) == (["glachals"], "center tire")
    assert N.brand_parts("N/A", WORDS) == ([], "") and N.brand_parts(None, WORDS) == ([], "")
    assert N.company_parts("Wynoma Franchse Systems, LLLC, a Delaware limited liability company", WORDS)[0] == "wynoma"
    assert N.company_parts("Holdings of Royal Nexo, L.P. d/b/a Royal Grill", WORDS) == ("royal nexo", " Royal Grill")
    assert N.fits(["nkp"], "", ["naskotal", "kratals"], "plumbing", "NKP") and N.fits(["naskos"], "coffee house", ["naskorho", "vix"], "coffee house", "")
    assert not N.fits(["zzz"], "", ["naskotal", "kratals"], "plumbing", "ZZZ")
    assert N.fits(["eftirho", "zanihep"], "", ["green", "zanihep", "eftirho"], "", "")


def test_common_words_are_learnt_and_a_hot_system_makes_none(spark):
    starts = ["Alp", "Bor", "Cal", "Dun", "Eri", "Fox", "Gam", "Hel", "Ivo", "Jut"]
    rows = [(f"{a}{i} Unique{a}{i} Bakery", False) for i, a in enumerate(starts * 2)] + [(f"{a}one Franchising LLC", True) for a in starts]
    rows += [(f"Subway Sandwich{i} Corner", False) for i in range(40)] + [(None, False), ("", True)]
    got = {w for w, _, _ in N.common_words(spark.createDataFrame(rows, "name string, legal boolean"))}
    assert got == {"bakery", "franchising", "llc"}
    assert N.common_words(spark.createDataFrame([], "name string, legal boolean")) == []


def test_every_order_of_many_words_meets(spark):
    df = spark.createDataFrame([("alder birch cedar dogwood elm",), ("cedar elm alder dogwood birch",), ("alder birch cedar dogwud elm",)], "name string")
    assert {(r.a, r.b) for r in N.trie_join(df).collect()} >= {("alder birch cedar dogwood elm", "cedar elm alder dogwood birch")}


def test_links(spark):
    f = spark.createDataFrame(
        [
            (1, "Wynomorv Chalalund Holdings LLC", "Wynomorv Chalalund Grill", None),
            (2, "N/A", "wynomorv chalalumd GRILL", None),
            (3, "Wynomorv Chalalund Holdings LLC", "WCG", None),
            (4, "Otherplace Brands Inc", "Wynomorv Chalalund Yoga Studio", None),
            (5, None, None, None),
            (6, "Wynomorv Chalalund Holdings LLC", "Skatroclo Dornojov Pizza", None),
            (1, "Wynomorv Chalalund Holdings LLC", "Wynomorv Chalalund Grill", None),
        ],
        "id long, legal_name string, brand_name string, website string",
    )
    m = spark.createDataFrame([(1, "Wynomorv Chalalund Holdings LLC", "Grill, Wynomorv Chalalund", None, "x")], "meta_id long, legal_name string, brand_name string, website string, key string")
    got = sorted((r.key_a, r.key_b) for r in V.links(f, m).collect())
    assert got == [("F1", "F2"), ("F1", "F3"), ("F1", "M1"), ("F2", "F3"), ("F2", "M1"), ("F3", "M1")]
    assert V.links(f.limit(0), m.limit(0)).count() == 0


def _index(spark):
    wi = pq.read_table("/root/testdata/sf0.001/wi_filings.parquet").to_pylist()
    mn = pq.read_table("/root/testdata/sf0.001/mn_filings.parquet").to_pylist()
    make = lambda rows, k, b, m: spark.createDataFrame([(r[k], r[b], r[m]) for r in rows], "key string, brand string, legal string")
    _, lc = X.documents(make(wi, "portal_id", "trade_name", "legal_name"), "l", WORDS)
    _, rc = X.documents(make(mn, "document_id", "franchise_name", "franchisor"), "r", WORDS)
    return X.weighted(lc.unionByName(rc))


def test_top_k_equals_brute_force(spark):
    ix = _index(spark)
    rows = ix.collect()
    want = {}
    for a in rows:
        for b in rows:
            if (a.side, b.side) == ("l", "r"):
                ta, tb = {t.h: (t.w, t.m) for t in a.terms}, {t.h: (t.w, t.m) for t in b.terms}
                reach = 0.0
                for x, y in ((ta, tb), (tb, ta)):
                    for attr in (X.BRAND, X.COMPANY):
                        own = {h: w for h, (w, m) in x.items() if m & attr and m & X.PROBE}
                        if own:
                            reach = max(reach, sum(w for h, w in own.items() if h in y and y[h][1] & X.PROBE) / sum(own.values()))
                if reach >= X.LEAST - 1e-9:
                    want[(a.cid, b.cid)] = sum(w for h, (w, _) in ta.items() if h in tb)
    pairs = X.scored(X.candidates(ix, False), ix)
    got = {(r.left, r.right): r.to_right for r in pairs.collect()}
    norm = {r.cid: r.norm for r in rows if r.side == "r"}
    assert set(got) == set(want) and all(abs(got[k] - want[k] * norm[k[1]]) < 1e-6 for k in got)
    for k in (1, 2, 10):
        best = {}
        for (a, b), s in want.items():
            best.setdefault(a, []).append((-s * norm[b], b))
        top = {(a, b) for a, x in best.items() for _, b in sorted(x)[:k]}
        mine = {(r.at, r.other) for r in X.nearest(pairs, k, 2.0).filter("of = 'left'").collect()}
        assert mine == top


def test_all_that_is_near_stays_beyond_k(spark):
    pairs = spark.createDataFrame([("lr", 1, i, 10.0, 10.0) for i in range(30)] + [("lr", 1, 99, 1.0, 9.0)], "kind string, left long, right long, to_right double, to_left double")
    assert X.mutual(pairs, 3, 0.75).count() == 30


def test_few_labels_leave_the_prior(spark):
    import numpy as np

    x = np.zeros((1, len(X.FEATURES)))
    assert np.abs(X.fit_logistic(x, np.array([1.0]), np.array(X.PRIOR)) - X.PRIOR).max() == 0
    w = X.fit_logistic(np.array([[1.0, 0.0]] * 5 + [[1.0, 1.0]] * 5), np.array([0.0] * 5 + [1.0] * 5), np.array([0.0, 1.0]))
    assert w[1] > 1


def test_portal_matches(spark):
    w = spark.createDataFrame(
        [("1", "Junaganth Ilmijun Franchise Systems Co.", "Junaganth Ilmijun Lawn Care"), ("2", None, None), ("3", "", "Torvaruskkra Nexovask Coffee Hse"), ("1", "Junaganth Ilmijun Franchise Systems Co.", "Junaganth Ilmijun Lawn Care")],
        "portal_id string, legal_name string, trade_name string",
    )
    m = spark.createDataFrame(
        [("a", "Junaganth Ilmijum Fran. Systems", "Junaganth Ilmijun Lawn Care", "1"), ("b", "Other Holdings", "Skaworl Zanmarikel Pizza", "2"), ("c", "-", "Torvaruskkra Nexovask Coffee House", None), ("d", None, None, None)],
        "document_id string, franchisor string, franchise_name string, file_number string",
    )
    assert sorted(map(tuple, X.found(w, m).collect())) == [("1", "a"), ("3", "c")]
    assert X.found(w.limit(0), m).count() == 0 and X.found(w.limit(0), m.limit(0)).count() == 0
    rows = {(r.portal, r.key): r.n_links for r in X.filings(w.distinct(), m).collect()}
    assert rows == {("W", "1"): 1, ("W", "3"): 1, ("M", "a"): 1, ("M", "b"): 0, ("M", "c"): 1}


def test_logistic_fit_parts_two_groups():
    import numpy as np

    x = np.array([[1.0, v] for v in (0, 0.1, 0.2, 0.8, 0.9, 1.0)] * 10)
    y = np.array([0, 0, 0, 1, 1, 1.0] * 10)
    w = X.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert ((p > 0.5) == (y == 1)).all()

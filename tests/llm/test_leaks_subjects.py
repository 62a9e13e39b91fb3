import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from discloom.llm import leaks as L
from discloom.llm import subjects as S

ITEM = "Suppose the owner plans to portion the frozen dessert with a dozen on hand; which leased catering tray would an examiner in Georgia expect to see during the term of the contract?"


def found(spark, *texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.item_id, r.doc_id) for r in L.leaks(docs, it).collect())


def test_what_counts_as_a_leak(spark):
    w = ITEM.split()
    marked = "<p>" + "&nbsp;".join(x.upper() for x in w[3:23]) + "</p>"
    broken = " ".join(w[2:12]) + "\n\n[Page 7]\n\n" + "\n".join(w[12:24]).replace("-", "")
    two = w[1:19]
    two[6], two[12] = "changed", "wrodng"
    three = w[1:19]
    three[4], three[9], three[14] = "x", "y", "z"
    added = w[0:9] + ["extra"] + w[9:20]
    texts = [f"before. {ITEM} after", marked, broken, " ".join(two), " ".join(three), " ".join(w[2:19]), "pre " + " ".join(added) + " post", None, "", " ".join(w[::-1])]
    assert found(spark, *texts) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 6)]
    assert found(spark, *texts, items=((1, None), (2, "too short"), (3, ""))) == []


def test_every_planted_case_is_found_and_no_shorter_one(spark):
    rng = random.Random(5)
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rows = pq.read_table("/root/testdata/sf0.001/eval_items.parquet").to_pylist()
    items = L.Items([(r["item_id"], r["text"]) for r in rows])
    cases, want = [], set()
    for i, r in enumerate(rows[:120]):
        w = r["text"].split()
        n = rng.choice([12, 14, 18, 20, 24, 33, 40])
        n = min(n, len(L.words_of(r["text"])) - 3)
        at = rng.randrange(max(1, len(w) - n))
        part = L.words_of(" ".join(w[at:]))[:n]
        edits = rng.randrange(n // 8 + 1)
        for p in sorted(rng.sample(range(1, n - 1), edits)):
            part[p] = "qqq" if rng.random() < 0.6 else part[p] + "x"
        cases.append((i, f"{rng.choice(docs)[:300]}\n\n{' '.join(part)}\n\n{rng.choice(docs)[:200]}"))
        if n >= 18:
            want.add((r["item_id"], i))
    assert set(L.search(items, cases)) >= want


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 2**63, 300, dtype=np.uint64)
    queries = stored[rng.integers(0, 300, 200)].copy()
    for i in range(200):
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(b)
    q, s = L.HammingIndex(stored).near(queries)
    got = set(zip(q.tolist(), s.tolist(), strict=True))
    near = np.bitwise_count(queries[:, None] ^ stored[None, :]) <= L.RADIUS
    assert got == set(zip(*map(list, np.nonzero(near)), strict=True))


def test_item_blocks_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet")
    a = sorted(map(tuple, L.leaks(docs, items).collect()))
    assert sorted(map(tuple, L.leaks(docs, items, block_words=4000).collect())) == a


def test_bisecting_kmeans_parts_clean_groups():
    docs = [[[w, "common", w]] for w in ("ant", "bee", "cat", "dog") for _ in range(20)]
    x = S._vectors(docs, {w: i for i, w in enumerate(("ant", "bee", "cat", "dog", "common"))}, np.array([20, 20, 20, 20, 80.0]), dict.fromkeys(("ant", "bee", "cat", "dog"), 1.0) | {"common": 0.2})
    leaf = S.bisecting_kmeans(S.smoothed(x, 8), 4, 5)
    assert [len(set(leaf[i : i + 20])) for i in (0, 20, 40, 60)] == [1] * 4 and len(set(leaf)) == 4
    assert len(S.bisecting_kmeans(np.zeros((0, 3)), 4, 5)) == 0


def test_subjects_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, subj, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "subjects", "doc_labels"))
    held = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    train = labels.join(held.select("doc_id").distinct(), "doc_id", "left_anti")
    got = S.subjects_of(docs, subj, train).join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    # Agreement with what most of several readers say.
    shares = S.label_shares(held).select("doc_id", F.explode("shares").alias("subject", "share"))
    readers = held.groupBy("doc_id").agg(F.countDistinct("reader").alias("k"))
    sure = shares.join(readers, "doc_id").filter("k >= 3 and share > 0.6 and subject <> 'none'").select("doc_id", "subject")
    hit = sure.join(got, ["doc_id", "subject"], "left_semi").count() / max(1, sure.count())
    said = got.join(shares.select("doc_id", "subject"), ["doc_id", "subject"], "left_semi").count() / max(1, got.count())
    assert hit > 0.9 and said > 0.9


def test_subjects_come_from_the_leaves():
    """With everything in one leaf nothing is found, and the mixture names the
    leaves of the subject a paragraph is given to."""
    words = {"law": [f"law{c}" for c in "abcdefgh"], "food": [f"food{c}" for c in "abcdefgh"], "pets": [f"pets{c}" for c in "abcdefgh"]}
    rng = np.random.default_rng(3)
    say = lambda s: " ".join(f"the operator said {' and '.join(rng.choice(words[s], 3))} were here." for _ in range(3))
    rows = [(say(s), {s: 1.0}) for _ in range(30) for s in words]
    m = S.fit(rows, sorted(words), leaves=6)
    for s in words:
        k, mix = S.subject_of(S.paragraphs(say(s))[0], m.weights, m.label)
        assert m.subjects[k] == s and max(mix, key=mix.get) in [i for i, x in enumerate(m.label) if x == k]
    one = S.fit(rows, sorted(words), cluster=lambda x, leaves, least=1: np.zeros(len(x), np.int64))
    assert one.weights == {} and all(S.subject_of(S.paragraphs(say(s))[0], one.weights, one.label)[0] == -1 for s in words)


def test_subjects_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Only notice words here. Nothing else at all.", "x")], "doc_id long, text string, subject string")
    subj = spark.createDataFrame([("a", "")], "subject string, description string")
    labels = spark.createDataFrame([], "label_id long, doc_id long, subject string, reader string")
    assert S.subjects_of(docs, subj, labels).count() == 0
    assert S.composition(docs.limit(0), subj, labels).count() == 0

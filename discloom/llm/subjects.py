"""Subject areas of documents.

Paragraphs of a bounded sample of labelled documents become normalised tf-idf
vectors, laid out in their leading directions and clustered by bisecting
k-means.  Each leaf is labelled with the subject its documents' readers name,
and its discriminative terms are its vector.  Every document of the corpus is
then read whole: each sentence falls to leaves by their terms, a paragraph is
the mixture of its sentences' leaves, and a document has every subject whose
leaves hold a paragraph of its own.  A term counts for leaves only, never for a
subject directly: where no leaf is labelled, nothing is found.

Only the fit is bounded (``fit_docs`` labelled documents, the same number of
each language, the ones with the smallest key hash); the broadcast is the leaf
vectors.  The pass over the corpus is narrow and keeps no state.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

FIT_DOCS = 3000
LEAVES, LEAST_LEAF, SMALL_LEAF = 72, 12, 5
#: Rounds in which paragraphs move between leaves.
ROUNDS = 2
#: How strongly a term's agreement among readers weighs in the vectors.
TELL = 4
#: Starts of each cut, the best of which is taken.
TRIALS = 10
#: Directions that paragraphs are laid out in.
AXES = 48
#: A leaf is a subject's if so many of its documents' readers name it.
MIXED = 0.45
LEAST_TERM, PURE = 4, 0.6
#: Sentences of one subject that make a paragraph its own, and their share of
#: the paragraph's sentences.
LEAST_SENTENCES, LEAST_SHARE = 2, 0.5

#: A term that stands in more of a mixed leaf's paragraphs than this belongs to
#: its language and phrasing, not to a subject.
FRAME_SHARE = 0.2

_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"[.?!]+[\s\"')\]]+|[.?!]+$|\n+\|")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _sentence_words(s: str) -> list[str]:
    """Words in lower case without proper names: a capital inside a sentence
    marks one, unless the whole sentence is in capitals."""
    words = _WORD.findall(s)
    if len(words) > 1:
        if s.isupper():
            return [w.lower() for w in words]
        words = [words[0].lower(), *[w for w in words[1:] if not w[0].isupper()]]
    return words


def paragraphs(text: str | None) -> list[list[list[str]]]:
    """Paragraphs of sentences of words of three letters and more."""
    if not text:
        return []
    out = []
    for p in _PARAGRAPH.split(text):
        sentences = [w for s in _SENTENCE.split(p) if len(w := _sentence_words(s)) > 2]
        if sentences:
            out.append(sentences)
    return out


def clean_subject(c: Column) -> Column:
    """A label as the subject is written: lower case, underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


class Sparse:
    """Rows of (term, value) pairs."""

    def __init__(self, start: np.ndarray, col: np.ndarray, val: np.ndarray, width: int):
        self.start, self.col, self.val, self.width = start, col, val, width

    def __len__(self) -> int:
        return len(self.start) - 1

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.width), np.float32)
        out[np.repeat(np.arange(len(self)), np.diff(self.start)), self.col] = self.val
        return out


def _loss(x: np.ndarray) -> float:
    """How far unit rows are from pointing one way."""
    return float(len(x) - np.linalg.norm(x.sum(0)))


def bisecting_kmeans(x: np.ndarray, leaves: int = LEAVES, least: int = LEAST_LEAF, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Leaf number of each row of unit vectors: the least coherent leaf is cut
    in two by spherical 2-means until there are enough or none can be cut."""
    rng = np.random.default_rng(seed)
    leaf = np.zeros(len(x), np.int64)
    loss = {0: _loss(x)} if len(x) else {}
    n = 1
    while n < leaves and loss:
        k = max(loss, key=lambda k: (loss[k], -k))
        if loss.pop(k) <= 1e-6:
            continue
        rows = np.flatnonzero(leaf == k)
        if len(rows) < 2 * least:
            continue
        y = x[rows]
        best = None
        for _ in range(TRIALS):
            a = y[int(rng.integers(len(y)))]
            far = np.argsort(y @ a, kind="stable")
            c = np.stack([a, y[int(far[rng.integers(max(1, len(y) // 10))])]])
            side = None
            for _ in range(rounds):
                new = (y @ c[1] > y @ c[0]).astype(np.int64)
                if side is not None and (new == side).all():
                    break
                side = new
                c = np.stack([y[side == 0].sum(0), y[side == 1].sum(0)])
                norm = np.linalg.norm(c, axis=1, keepdims=True)
                if (norm == 0).any():
                    break
                c /= norm
            gain = float(norm.sum())
            if min(side.sum(), len(side) - side.sum()) >= least and (best is None or gain > best[0]):
                best = (gain, side)
        if best is None:
            continue
        side = best[1]
        leaf[rows[side == 1]] = n
        for j, part in ((k, 0), (n, 1)):
            loss[j] = _loss(y[side == part])
        n += 1
    return leaf


def smoothed(x: Sparse, axes: int) -> np.ndarray:
    """Unit rows in the ``axes`` leading directions of the terms: paragraphs of
    one subject lie together though they share few of its words."""
    d = x.dense()
    _, v = np.linalg.eigh((d.T @ d).astype(np.float64))
    out = d @ v[:, ::-1][:, :axes].astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def telling(docs: Sequence[list[list[str]]], y: np.ndarray) -> dict[str, float]:
    """How much each term tells of a subject: the largest share of the readers
    of its paragraphs that agree on one, few paragraphs counting for less."""
    total: dict[str, np.ndarray] = {}
    n: Counter = Counter()
    for p, v in zip(docs, y, strict=True):
        for w in {w for s in p for w in s}:
            n[w] += 1
            if w in total:
                total[w] += v
            else:
                total[w] = v.copy()
    return {w: float(v.max(initial=0.0)) / (n[w] + 1) for w, v in total.items()}


def _vectors(docs: Sequence[list[list[str]]], terms: dict[str, int], df: np.ndarray, tell: dict[str, float]) -> Sparse:
    """Unit tf-idf rows; words of a language or of phrasing, which tell little
    of subjects, weigh little."""
    idf = np.log((1 + len(docs)) / (1 + df)) * np.array([tell[w] ** TELL + 0.01 for w in terms])
    start, col, val = [0], [], []
    for sentences in docs:
        n = Counter(k for s in sentences for w in s if (k := terms.get(w)) is not None)
        c = list(n)
        v = (1 + np.log(np.fromiter(n.values(), np.float64, len(n)))) * idf[c] if c else np.zeros(0)
        norm = np.linalg.norm(v)
        col += c
        val.append(v / norm if norm else v)
        start.append(start[-1] + len(c))
    return Sparse(np.array(start), np.array(col, np.int64), np.concatenate(val) if val else np.zeros(0), max(1, len(terms)))


#: Leaf numbers and weights of a term.
Weights = dict[str, tuple[tuple[int, float], ...]]


def leaf_mixture(sentences: list[list[str]], weights: Weights) -> list[dict[int, float]]:
    """The leaves each sentence falls to with their memberships."""
    out = []
    get = weights.get
    for s in sentences:
        m: dict[int, float] = {}
        for w in s:
            g = get(w)
            if g is not None:
                for k, v in g:
                    m[k] = m.get(k, 0.0) + v
        out.append(m)
    return out


def subject_of(sentences: list[list[str]], weights: Weights, label: Sequence[int]) -> tuple[int, dict[int, float]]:
    """The subject that a paragraph is given to (-1: none) and its mixture of
    leaves.

    Memberships are summed over the leaves of one subject (``label`` by leaf); a
    sentence belongs to the subject that leads, from a whole membership on.
    """
    mix: dict[int, float] = {}
    votes: dict[int, int] = {}
    for m in leaf_mixture(sentences, weights):
        if not m:
            continue
        score: dict[int, float] = {}
        for k, v in m.items():
            score[label[k]] = score.get(label[k], 0.0) + v
            mix[k] = mix.get(k, 0.0) + v
        top = max(score, key=lambda j: (score[j], -j))
        if score[top] >= 1.0:
            votes[top] = votes.get(top, 0) + 1
    if not votes:
        return -1, mix
    k = max(votes, key=lambda j: (votes[j], -j))
    if votes[k] >= LEAST_SENTENCES and votes[k] >= LEAST_SHARE * len(sentences):
        return k, mix
    return -1, mix


class Model:
    """Subjects, the subject of each leaf (-1: none), each term's weights by
    leaf, and notes on the leaves (number, subject, purity, leading terms)."""

    def __init__(self, subjects: list[str], label: list[int], weights: Weights, leaves: list[tuple[int, str, float, str]]):
        self.subjects, self.label, self.weights, self.leaves = subjects, label, weights, leaves


def leaf_labels(leaf: np.ndarray, y: np.ndarray) -> tuple[list[int], list[float]]:
    """The subject of each leaf and its share: what its documents' readers
    name, if one subject leads and stands out from the whole; else -1."""
    label, share_of = [], []
    base = y.mean(0) + 1e-9 if len(y) and y.shape[1] else np.zeros(0)
    for k in range(int(leaf.max()) + 1 if len(leaf) else 0):
        inside = y[leaf == k]
        share = inside.mean(0) if len(inside) and len(base) else np.zeros(1)
        s = int(share.argmax())
        ok = len(base) > 0 and len(inside) > 0 and share[s] >= MIXED and share[s] >= 2 * base[s]
        label.append(s if ok else -1)
        share_of.append(float(share[s]))
    return label, share_of


def leaf_weights(docs: Sequence[list[list[str]]], leaf: np.ndarray, label: Sequence[int]) -> Weights:
    """Discriminative terms of the leaves: a term counts for the leaves of the
    subject that it is pure for, shared out by how often it stands in each."""
    by_term: dict[str, Counter] = defaultdict(Counter)
    for p, k in zip(docs, leaf.tolist(), strict=True):
        for w in {w for s in p for w in s}:
            by_term[w][k] += 1
    size = Counter(label[k] for k in leaf.tolist())
    out: Weights = {}
    for w, c in by_term.items():
        n = sum(c.values())
        if n < LEAST_TERM:
            continue
        own: Counter = Counter()
        for k, x in c.items():
            own[label[k]] += x
        # Rates within each subject's paragraphs, so that large ones do not weigh more.
        rate = {s: x / size[s] for s, x in own.items()}
        top = max(rate, key=lambda j: (rate[j], -j))
        pure = rate[top] / sum(rate.values())
        if top >= 0 and pure >= PURE and own[top] >= max(LEAST_TERM, 0.4 * n):
            weight = pure**2 * (1.0 if pure >= 0.8 else 0.6) * 1.6
            out[w] = tuple((k, weight * x / own[top]) for k, x in sorted(c.items()) if label[k] == top)
    return out


def fit(rows: Sequence[tuple[str | None, dict[str, float]]], subjects: Sequence[str], leaves: int = LEAVES, cluster=bisecting_kmeans) -> Model:
    """Fit on (text, share of readers by subject) of labelled documents."""
    subjects = sorted(subjects)
    number = {s: i for i, s in enumerate(subjects)}
    docs, votes = [], []
    for text, shares in rows:
        v = np.zeros(len(subjects))
        for s, share in shares.items():
            if s in number:
                v[number[s]] = share
        for p in paragraphs(text):
            docs.append(p)
            votes.append(v)
    if not docs:
        return Model(subjects, [], {}, [])
    y = np.array(votes)
    seen = Counter(w for p in docs for w in {w for s in p for w in s})
    least = max(LEAST_TERM, len(docs) // 2000)
    terms = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least and n < 0.5 * len(docs)))}
    df = np.array([seen[w] for w in terms], np.float64)
    tell = telling(docs, y)
    leaf = cluster(smoothed(_vectors(docs, terms, df, tell), AXES), leaves) if terms else np.zeros(len(docs), np.int64)

    # Leaves that no subject leads are cut again by what tells their own
    # paragraphs apart, without the words they all share.
    open_ = list(range(int(leaf.max()) + 1)) if len(subjects) else []
    while open_:
        k = open_.pop()
        rows_k = np.flatnonzero(leaf == k)
        if len(rows_k) < 2 * SMALL_LEAF or y[rows_k].mean(0).max() >= MIXED:
            continue
        inside = Counter(w for i in rows_k for w in {w for q in docs[i] for w in q})
        own = {w: i for i, w in enumerate(sorted(w for w, n in inside.items() if n >= 3 and n <= FRAME_SHARE * len(rows_k)))}
        if not own:
            continue
        sub = [docs[i] for i in rows_k]
        cut = cluster(smoothed(_vectors(sub, own, np.array([inside[w] for w in own], np.float64), tell), AXES), max(2, len(rows_k) // SMALL_LEAF), SMALL_LEAF)
        if cut.any():
            first = int(leaf.max())
            leaf[rows_k] = np.where(cut == 0, k, first + cut)
            open_ += [j for j in (k, *range(first + 1, int(leaf.max()) + 1)) if (leaf == j).sum() < len(rows_k)]

    # Paragraphs move to the leaf of their subject that holds most of their
    # mixture, those of none to an unlabelled leaf, and leaves are weighed anew.
    label, share = leaf_labels(leaf, y)
    weights = leaf_weights(docs, leaf, label)
    for _ in range(ROUNDS):
        rest = len(label)
        moved = []
        for p, k in zip(docs, leaf.tolist(), strict=True):
            s, mix = subject_of(p, weights, label)
            if s >= 0:
                k = max((j for j in mix if label[j] == s), key=lambda j: (mix[j], -j))
            elif label[k] >= 0:
                k = rest
            moved.append(k)
        leaf = np.array(moved)
        label = [*label, -1]
        weights = leaf_weights(docs, leaf, label)
    notes = []
    for k, s in enumerate(label):
        inside = Counter(w for i in np.flatnonzero(leaf == k) for w in {w for q in docs[i] for w in q})
        n = max(1, int((leaf == k).sum()))
        lead = sorted(inside, key=lambda w: (-inside[w] * math.log((1 + inside[w] / n) / (1 + seen[w] / len(docs)) + 1e-9), w))[:8]
        notes.append((k, subjects[s] if s >= 0 else "none", share[k] if k < len(share) else 0.0, " ".join(lead)))
    return Model(subjects, label, weights, notes)


def label_shares(labels: DataFrame) -> DataFrame:
    """doc_id, shares (map subject -> share of its readers): each reader
    counts once for a subject however often they wrote it."""
    own = labels.select("doc_id", "reader", clean_subject(F.col("subject")).alias("subject")).distinct()
    own = own.filter(F.col("doc_id").isNotNull() & F.col("subject").isNotNull())
    n = own.groupBy("doc_id").agg(F.countDistinct("reader").alias("readers"))
    per = own.groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("k"))
    return (
        per.join(n, "doc_id")
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("subject", F.col("k") / F.greatest("readers", F.lit(1))))).alias("shares"))
    )


def trained(docs: DataFrame, subjects: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """The model fitted on at most ``fit_docs`` labelled documents, the same
    number of each language as far as there are (column ``lang``, if given):
    those with the smallest hash."""
    lang = F.coalesce(F.lower(F.trim("lang")), F.lit("")) if "lang" in docs.columns else F.lit("")
    shares = label_shares(labels)
    known = docs.select("doc_id", lang.alias("lang")).join(shares.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.withColumn("turn", turn).filter(F.col("turn") <= fit_docs).orderBy("turn", "lang").limit(fit_docs).select("doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.join(shares, "doc_id")), "doc_id").select("text", "shares").collect()
    names = [r.subject for r in subjects.select("subject").distinct().collect() if r.subject]
    rows.sort(key=lambda r: (r.text or "", sorted(r.shares.items())))
    return fit([(r.text, r.shares) for r in rows], names)


def subjects_of(docs: DataFrame, subjects: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """p9_found: doc_id, subject of every document, as many as it has.

    Null and empty texts and texts of notices only have no row.  Without labels
    nothing can be named and there are no rows.  A repeated row counts once.
    """
    model = trained(docs, subjects, labels, fit_docs)
    held = docs.sparkSession.sparkContext.broadcast((model.subjects, model.label, model.weights))
    src = docs.select("doc_id", "text")
    schema = T.StructType([src.schema["doc_id"], T.StructField("subject", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, label, weights = held.value
        for b in batches:
            ids, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = sorted({subject_of(p, weights, label)[0] for p in paragraphs(text)} - {-1})
                ids += [i] * len(got)
                out += [names[k] for k in got]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema).dropDuplicates()


def composition(docs: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """subject, n_docs: how many documents of the corpus deal with each area;
    a document with several counts under each."""
    return subjects_of(docs, subjects, labels).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))

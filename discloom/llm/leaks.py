"""Evaluation texts that leak into a corpus.

Every run of words of the corpus gets a SimHash fingerprint, and so does every
run of the items.  A multi-index of Hamming blocks (four blocks of 16 bits)
finds all item windows within radius 3 of a corpus window, then the weighted
similarity of the shingles around the pair verifies it, and an alignment of the
words tests the definition (at most one word in eight altered).

The window is the longest run that any case must leave unaltered: a passage of
n words with e = floor(n/8) altered ones holds a run of at least
ceil((n - e) / (e + 1)) unaltered words, and that is 6 or more for every
n >= 18.  So no case is lost to the index; wider windows would need a radius
that blocks cannot serve (see README).

From most runs a look at the words within three alterations is enough.  A case
of which no run of 6 words or more reaches 18 words with three alterations has
e >= 4, and its e + 1 runs hold 7e equal words or more.  Any four runs in a row
hold 17 words at most, or 20 if none is of 6 words.  That leaves e = 4 with both
outer runs of 11 words or more, and e = 4k with a run of 8k for k >= 2.  So such
a case has a run of 11 words, and from those runs the whole is looked at.

Scale: a single narrow pass over the corpus.  Only the items are broadcast; if
they hold more words than ``block_words`` they are taken in blocks, one pass
each.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, RADIUS, BLOCKS = 6, 3, 4
LEAST_WORDS, ONE_IN = 18, 8
LONG_RUN = 11
BLOCK_WORDS = 2_000_000
CHUNK = 131_072

_TAGS = re.compile(r"<[^<>]{1,200}>|&(?:[a-z]{2,8}|#\d{1,6});")
_PAGE = re.compile(r"(?m)^[^\w\n]*(?:page|pg|p)\.?\s*\d+(?:\s*(?:of|/)\s*\d+)?[^\w\n]*$|\[\s*page\s+\d+\s*\]|^[^\w\n]*-\s*\d+\s*-[^\w\n]*$")
_PAGE_HINTS = ("page", "\np. ", "\npg", "\n- ")
_BROKEN = re.compile("(?<=\\w)[-\u2010]\\n(?=\\w)")
_DROPPED = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff\u2019"))
_WORD = re.compile(r"\d+(?:,\d+)+|[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words in lower case without markup, page marks and punctuation; a
    number keeps its commas here and loses them in :class:`Words`."""
    if not text:
        return []
    t = text.lower()
    if "<" in t or "&" in t:
        t = _TAGS.sub(" ", t)
    if any(h in t for h in _PAGE_HINTS):
        t = _PAGE.sub(" ", t)
    if "'" in t:
        t = t.replace("'", "")
    if not t.isascii():
        t = t.translate(_DROPPED)
    if "-\n" in t or "\u2010\n" in t:
        t = _BROKEN.sub("", t)
    return _WORD.findall(t)


class Words:
    """Word numbers and the 64 hash bits of each word."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.size = 0
        self.bits = np.zeros((1024, 64), np.uint8)

    def number(self, words: list[str]) -> np.ndarray:
        got = list(map(self.ids.get, words))
        if None in got:
            got = [self._add(w) if k is None else k for w, k in zip(words, got, strict=True)]
        return np.array(got, np.int64)

    def _add(self, word: str) -> int:
        k = self.ids.get(word)
        if k is not None:
            return k
        plain = word.replace(",", "")
        k = self.ids.get(plain)
        if k is None:
            k = self.ids[plain] = self.size
            self.size += 1
            if k >= len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            h = np.frombuffer(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint8)
            self.bits[k] = np.unpackbits(h)
        self.ids[word] = k
        return k


def fingerprints(bits: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of every run of ``window`` words: each bit by majority, a tie
    by the run's first word."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = bits[ids]
    votes = b[:n].copy()
    for k in range(1, window):
        votes += b[k : k + n]
    votes += votes
    votes += b[:n]
    return np.packbits(votes > window, axis=1).view(np.uint64).ravel()


class HammingIndex:
    """All stored fingerprints within RADIUS of a query: by the pigeonhole
    principle one of RADIUS + 1 blocks is equal."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        self.order, self.start = [], []
        for b in range(BLOCKS):
            self.order.append(np.argsort(blocks[:, b], kind="stable"))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(blocks[:, b], minlength=65536))]))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, stored number) of every pair within the radius."""
        q = queries.view(np.uint16).reshape(-1, BLOCKS)
        found = []
        for b in range(BLOCKS):
            lo = self.start[b][q[:, b]]
            n = self.start[b][q[:, b].astype(np.int64) + 1] - lo
            at = np.flatnonzero(n)
            n, lo = n[at], lo[at]
            rows = np.repeat(at, n)
            inside = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            stored = self.order[b][np.repeat(lo, n) + inside]
            ok = np.bitwise_count(queries[rows] ^ self.prints[stored]) <= RADIUS
            found.append(rows[ok] * np.int64(len(self.prints)) + stored[ok])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        m = max(1, len(self.prints))
        return pairs // m, pairs % m


def reach(a: list[int], b: list[int], most: int) -> list[int]:
    """For e = 0..most: how many words of ``a`` a run can take that starts at
    both beginnings, alters at most e words and ends in an equal word."""
    la, lb = len(a), len(b)

    def slide(i, j):
        while i < la and j < lb and a[i] == b[j]:
            i += 1
            j += 1
        return i

    front = {0: slide(0, 0)}
    out = [front[0]]
    for _ in range(most):
        new: dict[int, int] = {}
        for d, i in front.items():
            for dd, ii in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                if ii <= la and 0 <= ii + dd <= lb:
                    r = slide(ii, ii + dd)
                    if new.get(dd, -1) < r:
                        new[dd] = r
        front = new
        best = out[-1]
        for d, r in front.items():
            if r > best and r + d > 0 and a[r - 1] == b[r + d - 1]:
                best = r
        out.append(best)
    return out


def holds_passage(item: list[int], doc: list[int], q: int, p: int, window: int = WINDOW) -> bool:
    """Whether a passage through the equal run at item word q and corpus word
    p has LEAST_WORDS words and at most one in ONE_IN altered."""
    most = len(item) // ONE_IN
    span = len(item) + most + 1
    later, sooner = item[q + window :], item[:q][::-1]
    ahead, behind = doc[p + window : p + window + span], doc[max(0, p - span) : p][::-1]
    # A case without a long run has LEAST_WORDS words with three altered at most
    # around one of its runs; what falls short of that needs no longer look.
    for limit in sorted({min(3, most), most}):
        after, before = reach(later, ahead, limit), reach(sooner, behind, limit)
        longest = 0
        for e1, x in enumerate(after):
            for e2, y in enumerate(before):
                n = window + x + y
                if n >= LEAST_WORDS and (e1 + e2) * ONE_IN <= n:
                    return True
                if e1 + e2 <= 3:
                    longest = max(longest, n)
        if longest < LEAST_WORDS and window + after[0] + before[0] < LONG_RUN:
            return False
    return False


class Items:
    """Items with their fingerprints, index and shingle bounds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.words = Words()
        self.keys, self.texts, owner, place, prints, begin, at = [], [], [], [], [], [], 0
        for key, text in rows:
            ids = self.words.number(words_of(text))
            if len(ids) < LEAST_WORDS:
                continue
            f = fingerprints(self.words.bits, ids)
            owner.append(np.full(len(f), len(self.keys)))
            place.append(np.arange(len(f)))
            prints.append(f)
            begin.append(at + np.arange(len(f)))
            at += len(ids)
            self.keys.append(key)
            self.texts.append(ids.tolist())
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.owner, self.place = cat(owner, np.int64), cat(place, np.int64)
        self.origin = cat(begin, np.int64)
        self.stream = cat([np.array(t) for t in self.texts], np.int64)
        self.index = HammingIndex(cat(prints, np.uint64))
        self.bound: dict[int, tuple[frozenset, float]] = {}
        seen = Counter(w for t in self.texts for w in set(t))
        self.weight = {w: math.log(1 + len(self.texts) / n) for w, n in seen.items()}

    def shingles(self, k: int) -> tuple[frozenset, float]:
        """Shingles (of one word, weighted by how rare they are in the items)
        around stored window k and the weight that a case without a long run
        must share with the corpus there: each of three alterations takes one
        shingle, at worst the heaviest."""
        got = self.bound.get(k)
        if got is None:
            t, q = self.texts[self.owner[k]], int(self.place[k])
            runs = [set(t[s : s + LEAST_WORDS]) for s in range(max(0, q + WINDOW - LEAST_WORDS), min(q, len(t) - LEAST_WORDS) + 1)]
            least = min(sum(w) - sum(sorted(w)[-3:]) for w in ([self.weight[x] for x in run] for run in runs))
            got = self.bound[k] = (frozenset(t[max(0, q - LEAST_WORDS) : q + WINDOW + LEAST_WORDS]), least)
        return got


def search(items: Items, docs: list[tuple[object, str | None]]) -> list[tuple[int, object]]:
    """(item key, document key) of every leak in a batch of documents."""
    out: list[tuple[int, object]] = []
    if not items.keys:
        return out
    ids, first, key = [], [0], []
    for k, text in docs:
        x = items.words.number(words_of(text))
        if len(x) >= LEAST_WORDS - LEAST_WORDS // ONE_IN:
            ids.append(x)
            first.append(first[-1] + len(x))
            key.append(k)
    if not ids:
        return out
    stream, first = np.concatenate(ids), np.array(first)
    hits_p, hits_k = [], []
    for s in range(0, len(stream), CHUNK):
        f = fingerprints(items.words.bits, stream[s : s + CHUNK + WINDOW - 1])
        p, k = items.index.near(f)
        hits_p.append(p + s)
        hits_k.append(k)
    p, k = np.concatenate(hits_p), np.concatenate(hits_k)
    doc = np.searchsorted(first, p, "right") - 1
    inside = p + WINDOW <= first[doc + 1]
    for j in range(WINDOW):  # the run itself must be equal; an altered one has an equal run beside it
        at = np.flatnonzero(inside)
        inside[at] = stream[p[at] + j] == items.stream[items.origin[k[at]] + j]
    p, k, doc = p[inside], k[inside], doc[inside]
    # Of equal runs that go on, one start is enough.
    order = np.lexsort((p, p - items.place[k], items.owner[k], doc))
    p, k, doc = p[order], k[order], doc[order]
    own, diagonal = items.owner[k], p - items.place[k]
    new = np.ones(len(p), bool)
    new[1:] = ~((doc[1:] == doc[:-1]) & (own[1:] == own[:-1]) & (diagonal[1:] == diagonal[:-1]) & (p[1:] == p[:-1] + 1))
    length = np.diff(np.append(np.flatnonzero(new), len(new))) + WINDOW - 1
    done = set()
    for pp, kk, dd, run in zip(p[new].tolist(), k[new].tolist(), doc[new].tolist(), length.tolist(), strict=True):
        it = int(items.owner[kk])
        if (it, dd) in done:
            continue
        lo, hi = int(first[dd]), int(first[dd + 1])
        if run < LONG_RUN:
            around, least = items.shingles(kk)
            near = stream[max(lo, pp - LEAST_WORDS - 3) : min(hi, pp + WINDOW + LEAST_WORDS + 3)].tolist()
            if sum(items.weight[x] for x in around.intersection(near)) < least - 1e-9:
                continue
        text, q = items.texts[it], int(items.place[kk])
        span = 2 * len(text) + 8
        a = max(lo, pp - span)
        if holds_passage(text, stream[a : min(hi, pp + span)].tolist(), q, pp - a):
            done.add((it, dd))
            out.append((items.keys[it], key[dd]))
    return out


#: The items last used by this worker, so that its next task need not build them.
_READY: dict[str, Items] = {}


def _ready(token: str, held) -> Items:
    got = _READY.get(token)
    if got is None or len(got.words.ids) > 1_000_000:
        _READY.clear()
        got = _READY[token] = Items(held.value)
    return got


def leaks(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """p8_found: item_id, doc_id of every document that holds a passage of an
    item of at least 18 running words, one word in eight altered at most.

    Null and empty texts leak nothing; items under 18 words cannot leak.
    Repeated rows give one row.  Whole texts are read.
    """
    spark = docs.sparkSession
    n_words = items.select(F.sum(F.length("text") / 4)).first()[0] or 0
    blocks = int(n_words // block_words) + 1
    schema = T.StructType([items.schema["item_id"], docs.schema["doc_id"]])
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        held = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.select("item_id", "text").dropDuplicates().collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            ready = _ready(token, held)
            for batch in batches:
                if len(ready.words.ids) > 1_000_000:  # the vocabulary met so far is dropped, not the words
                    ready = Items(held.value)
                for s in range(0, batch.num_rows, 2000):
                    part = batch.slice(s, 2000)
                    got = search(ready, list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x, _ in got], batch_types[0]), pa.array([y for _, y in got], batch_types[1])],
                        names=["item_id", "doc_id"],
                    )

        from pyspark.sql.pandas.types import to_arrow_type

        batch_types = [to_arrow_type(f.dataType) for f in schema.fields]
        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()

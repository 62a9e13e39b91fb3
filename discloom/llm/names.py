"""Names as people type them: their parts, and a trie join of close spellings.

A brand is split into its core (the words that tell it apart) and its trade
(bakery, lawn care ...), a company into its core and the words of its legal
form.  Which words are common is learnt from the names themselves; they are
recognised with typing errors and abbreviations.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A common word stands in this share of the different names at least, in as
#: many names, and in names that begin in as many ways; no beginning may hold
#: more than TOP_CONTEXT of them, so one frequent system makes no common words.
#: At most (words of a name / COMMON_SHARE) words can reach the share.
COMMON_SHARE, LEAST_NAMES, LEAST_CONTEXTS, TOP_CONTEXT = 1 / 500, 4, 4, 0.4
#: A word is of the legal form if companies have it so much more often than brands.
FORM_RATIO = 4
#: How much rarer a word must be to count as another one typed badly.
RARER = 0.25

NOTHING = frozenset(("", "n/a", "na", "none", "null", "unknown", "-", "--", "tbd", "same", "not available", "not applicable", "."))
LINKING = frozenset(("the", "by", "and", "of", "a", "an", "tm"))
_MARKS = re.compile(r"\((?:tm|r|sm)\)|[®™℠©]", re.I)
_DBA = re.compile(r"\b(?:d/?b/?a/?|t/a|a/k/a|f/k/a|doing business as|trading as|also known as)\b", re.I)
_STATE_FORM = re.compile(r",?\s+an?\s+[a-z ]+?\s+(?:limited liability|corporation|corpor\w*|company|limited partnership|partnership|llc).*$", re.I)


def fold(text: str | None) -> str:
    """Lower case without accents, marks and possessives; words by spaces."""
    if text is None:
        return ""
    t = unicodedata.normalize("NFKD", _MARKS.sub(" ", text))
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    t = re.sub(r"['’`]", "", t)
    t = re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", t)  # l.l.c
    return " ".join(re.findall(r"[^\W_]+", t))


def within(a: str, b: str, k: int) -> bool:
    """Whether the Levenshtein distance is at most k."""
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        if min(new) > k:
            return False
        row = new
    return row[-1] <= k


def abbreviates(short: str, word: str) -> bool:
    """Same first letter and all letters in order, at most two thirds as long."""
    if not 2 <= len(short) <= max(4, len(word) * 2 // 3) or short[0] != word[0] or len(short) >= len(word):
        return False
    it = iter(word)
    return all(c in it for c in short)


def _letters(s: str) -> int:
    """The letters of a word as bits."""
    m = 0
    for c in s:
        m |= 1 << (ord(c) & 63)
    return m


def _closest(token: str, words: tuple[str, ...]) -> str | None:
    if token in words:
        return token
    if len(token) <= 5 and len(token) >= 3:
        # Abbreviations leave out vowels or the end.
        hits = [w for w in words if len(w) >= 5 and abbreviates(token, w) and (w.startswith(token) or sum(c in "aeiou" for c in token[1:]) <= 1)]
        if hits:
            return min(hits, key=lambda w: (not w.startswith(token), len(w), w))
    if len(token) >= 5:
        mine = _letters(token)
        for k in (1, 2) if len(token) >= 8 else (1,):
            for w in words:
                # An edit changes two letters of the set at most.
                if abs(len(w) - len(token)) <= k and len(w) >= 4 and (mine ^ _letters(w)).bit_count() <= 2 * k and within(token, w, k):
                    return w
    return None


def common_words(names: DataFrame) -> list[tuple[str, int, int]]:
    """word, brands, companies: the common words of names (column ``name``,
    ``legal``: whether it is a company's), most frequent first.

    Distinct names are counted; a name's first word is its context and is not
    counted itself.  The list is bounded by COMMON_SHARE, not by the data.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower("name"), "['\u2019`]", ""), r"\b([a-z])\.(?=[a-z]\b)", "$1")
    texts = names.filter(F.length("name") > 0).select(plain.alias("t"), "legal").distinct()
    words = texts.select("legal", F.filter(F.split("t", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0).alias("w"))
    each = words.select("legal", F.substring(F.get("w", F.lit(0)), 1, 3).alias("context"), F.explode(F.array_distinct(F.slice("w", 2, 1000))).alias("word"))
    first = words.select(F.get("w", F.lit(0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("leads"))
    per = each.groupBy("word", "context").agg(F.count_if(~F.col("legal")).alias("b"), F.count_if("legal").alias("c"))
    n = F.col("brands") + F.col("companies")
    found = per.groupBy("word").agg(
        F.sum("b").alias("brands"), F.sum("c").alias("companies"), F.count(F.lit(1)).alias("contexts"), F.max(F.col("b") + F.col("c")).alias("top")
    )
    total = texts.count()
    least = max(LEAST_NAMES, total * COMMON_SHARE)
    found = found.filter((n >= least) & (F.col("contexts") >= LEAST_CONTEXTS) & (F.col("top") <= TOP_CONTEXT * n))
    found = found.join(first, "word", "left").filter(n > F.coalesce("leads", F.lit(0)))
    return sorted(((r.word, r.brands, r.companies) for r in found.collect()), key=lambda r: (-r[1] - r[2], r[0]))


def named(rows: DataFrame) -> DataFrame:
    """name, legal of rows with brand and legal, as :func:`common_words` asks."""
    return rows.select(F.explode(F.array(F.struct(F.col("brand").alias("name"), F.lit(False).alias("legal")), F.struct(F.col("legal").alias("name"), F.lit(True).alias("legal")))).alias("x")).select("x.*")


class Words:
    """The common words, and what a token as typed stands for."""

    def __init__(self, learnt: Iterable[tuple[str, int, int]] = ()):
        canon: dict[str, str] = {}
        count: dict[str, int] = {}
        self.form: set[str] = set()
        for word, brands, companies in learnt:
            if word in LINKING:
                continue
            form = companies > FORM_RATIO * brands
            # A word is another one typed badly if it is far rarer and of the same kind.
            fuller = tuple(w for w, n in count.items() if brands + companies <= RARER * n and (w in self.form) == form)
            head = _closest(word, fuller) if len(word) >= 3 else None
            canon[word] = head or word
            if head is None:
                count[word] = brands + companies
                if form:
                    self.form.add(word)
        heads = tuple(count)
        self.canon, self.heads = canon, heads
        self.short = tuple(w for w in heads if len(w) <= 4)
        self.known: dict[str, str | None] = {}

    def common(self, token: str) -> str | None:
        """The common word that a token is, spells badly or abbreviates."""
        got = self.canon.get(token)
        if got is not None:
            return got
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = _closest(token, self.heads)
        return self.known[token]

    def ending(self, token: str) -> bool:
        """Whether a word at a company's end is a short common word typed badly."""
        return len(token) <= 5 and any(within(token, w, 1) for w in self.short)


def brand_parts(text: str | None, words: Words) -> tuple[list[str], str]:
    """Core words and trade (its words in alphabetical order) of a brand."""
    if text is None or text.strip().lower() in NOTHING:
        return [], ""
    t = fold(text)
    if "," in text:  # "Trade, The Name" and "Name, The"
        head, _, tail = text.partition(",")
        t = f"{fold(tail)} {fold(head)}"
    all_ = [w for w in t.split() if w not in LINKING]
    core, trade = [], []
    for w in all_:
        x = words.common(w)
        if x is None:
            core.append(w)
        elif x not in words.form:
            trade.append(x)
    if not core:
        core, trade = all_, []
    return core, " ".join(sorted(set(trade)))


def without_form(text: str) -> str:
    """The name without a trailing "a Delaware limited liability company"."""
    return _STATE_FORM.sub("", text)


def company_parts(text: str | None, words: Words) -> tuple[str, str]:
    """Core of a company's name, and the trading name given with it."""
    if text is None or text.strip().lower() in NOTHING:
        return "", ""
    head, *rest = _DBA.split(text, maxsplit=1)
    head = without_form(head)
    if "," in head:
        a, _, b = head.partition(",")
        if any(words.common(w) is None and not words.ending(w) for w in fold(b).split()):
            head = f"{b} {a}"
    all_ = [w for w in fold(head).split() if w not in LINKING]
    core = [w for i, w in enumerate(all_) if words.common(w) is None and not (i > 0 and i >= len(all_) - 4 and words.ending(w))] or all_
    return " ".join(core), rest[0] if rest else ""


def is_initials(text: str, core: str) -> bool:
    letters = re.sub(r"[^A-Za-z]", "", text or "")
    return bool(core) and 2 <= len(letters) <= 6 and letters.isupper() and " " not in text.strip()


def is_cut(text: str | None, core: list[str], initials: bool, most: int = 8) -> bool:
    """Whether a brand is missing, in initials, cut off (its last core word
    ends in a full stop) or one word of ``most`` letters at most."""
    if not core or initials or (len(core) == 1 and len(core[0]) <= most):
        return True
    return (text or "").strip().endswith(".") and fold(text).split()[-1:] == core[-1:]


def _pet_form(s: str, word: str) -> bool:
    """Whether s is the beginning of a word with the ending of a pet form."""
    for end in ("iess", "yss", "oss", "ies", "ys", "os", "es", "ie", "s", "y", "o", ""):
        if s.endswith(end):
            stem = s[: len(s) - len(end)]
            if len(stem) >= 3 and word.startswith(stem):
                return True
    return False


def fits(short: list[str], short_trade: str, core: list[str], trade: str, raw: str) -> bool:
    """Whether a shortened brand can stand for a full one of the same company:
    initials, beginnings of its words, or a pet form of its first word."""
    if not short:
        return True
    if short_trade and trade and not (set(short_trade.split()) & set(trade.split())):
        return False
    joined, full = "".join(short), "".join(core)
    if len(short) == 1:
        s = short[0]
        letters = sorted(w[0] for w in core)
        tl = [w[0] for w in trade.split()]
        if 2 <= len(s) <= 6 and s[0] == core[0][0]:
            need = list(s)
            if all(c in need for c in letters) or len(s) <= len(core):
                rest = list(s)
                for c in letters:
                    if c in rest:
                        rest.remove(c)
                strange = sum(c not in tl and c not in full for c in rest)  # a word of the legal form
                if len(rest) <= 1 + len(tl) and len(s) >= min(2, len(core)) and strange <= (len(s) >= 4):
                    if sum(c in letters for c in s) >= min(len(s), len(letters)):
                        return True
        if any(_pet_form(s, w) for w in core):
            return True
    if len(short) == len(core) and all(
        a.startswith(b) or b.startswith(a) or within(a, b, 2) or _pet_form(a, b) or _pet_form(b, a) for a, b in zip(short, core, strict=True)
    ):
        return True
    # Some of the words, in any order, apart or written as one.
    if sum(map(len, short)) >= 5 and len(short) < len(core) and all(any(a == b or (len(a) >= 5 and within(a, b, 1)) for b in core) for a in short):
        return True
    if len(joined) >= 8 and len(short) <= 3 and any("".join(o) in full for o in permutations(short)):
        return True
    if len(short) >= 2:
        # The first word in a pet form, the last whole: beside a word left out
        # before them, or written as one word.
        tail = core[-len(short) :]
        if len(core) == len(short) + 1 and within(short[-1], tail[-1], 1) and all(_pet_form(a, b) or within(a, b, 2) for a, b in zip(short, tail, strict=True)):
            return True
        if len(core) == 1 and len(short) == 2 and len(short[1]) >= 5 and full.endswith(short[1]) and _pet_form(short[0], full):
            return True
    if len(core) < len(short) <= len(core) + 2 and trade:
        # Words left over may be a trade too badly spelt to be known as one.
        rest = short[len(core) :]
        if all(a == b or within(a, b, 2) for a, b in zip(short, core, strict=False)) and all(any(within(r, t, 3) or within(r, t[: len(r)], 2) for t in trade.split()) for r in rest):
            return True
    return within("".join(sorted(short)), "".join(sorted(core)), 4) and len(full) >= 12 and len(joined) >= 8


# ---------------------------------------------------------------- trie join

#: Names to a bucket; the number of buckets follows the number of names.
BUCKET_NAMES = 2000
#: Stored names of one shard that a task takes; beyond, the shard is split.
SHARD_NAMES = 5000


def bound(n: int) -> int:
    """Edits allowed in a name of n letters."""
    return 0 if n < 5 else 1 if n < 10 else 2


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 even pieces of n letters: one of them survives k edits."""
    base, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def pieces_of(n: int) -> int:
    """For how many edits a stored name of n letters is cut: the most that any
    name it is close to may ask for."""
    return max(bound(m) for m in range(n, n + 3) if m - n <= bound(m))


def shards_of(s: str) -> Iterator[tuple[int, int, str]]:
    """Shard keys under which a name is stored."""
    n = len(s)
    for i, (at, size) in enumerate(segments(n, pieces_of(n))):
        yield n, i, s[at : at + size]


def probes_of(s: str) -> Iterator[tuple[int, int, str]]:
    """Shard keys that hold every stored name no longer than ``s`` within the
    bound of ``s``.

    Piece i of the stored name, if it is the first that survives, has at most
    i edits to its left and k - i to its right, which limits how far it moved.
    """
    n = len(s)
    k = bound(n)
    seen = set()
    for m in range(max(1, n - k), n + 1):
        longer = n - m
        for i, (at, size) in enumerate(segments(m, pieces_of(m))[: k + 1]):
            left, right = i, k - i
            low, high = max(0, at - left, at + longer - right), min(n - size, at + left, at + longer + right)
            for p in range(low, high + 1):
                key = (m, i, s[p : p + size])
                if key not in seen:
                    seen.add(key)
                    yield key


def orders(words: list[str]) -> list[str]:
    """The name with its words in other orders: all of up to three words; of
    more the rotations and the alphabetical order, in which :func:`stored`
    keeps such names too, so that every order meets."""
    if len(words) <= 3:
        return list(dict.fromkeys("".join(p) for p in permutations(words)))
    return list(dict.fromkeys([*("".join(words[i:] + words[:i]) for i in range(len(words))), "".join(sorted(words))]))


def stored(words: list[str]) -> list[str]:
    """The forms a name is stored under."""
    return list(dict.fromkeys(["".join(words), *(["".join(sorted(words))] if len(words) > 3 else [])]))


class Trie:
    """Stored names; :meth:`near` walks it with a Levenshtein automaton whose
    state is the row of distances to the prefixes of the query."""

    def __init__(self):
        self.root: dict = {}

    def add(self, s: str) -> None:
        node = self.root
        for c in s:
            node = node.setdefault(c, {})
        node[""] = s

    def near(self, q: str, k: int) -> list[tuple[str, int]]:
        out = []
        stack = [(self.root, list(range(len(q) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= k:
                        out.append((child, row[-1]))
                    continue
                new = [row[0] + 1]
                low = new[0]
                for j, y in enumerate(q, 1):
                    v = row[j - 1] if y == c else 1 + min(row[j - 1], row[j], new[-1])
                    new.append(v)
                    if v < low:
                        low = v
                if low <= k:
                    stack.append((child, new))
        return out


def trie_join(names: DataFrame, buckets: int | None = None, shard_names: int = SHARD_NAMES) -> DataFrame:
    """a, b, distance: pairs of different names (column ``name``, words parted
    by spaces) whose letters are within the bound in some order of words.

    Names are sharded by surviving pieces; shards are dealt to buckets by hash
    and each bucket builds the tries of its shards.  A piece that more than
    ``shard_names`` names share is split into a grid of cells (stored names by
    row, probing ones by column), so no task gets it whole and no pair is lost.
    Repeated and null names are taken once and not at all.
    """
    own = names.select("name").filter(F.length("name") > 0).distinct()
    n_buckets = buckets or max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.count() // BUCKET_NAMES)

    def spread(probing: bool):
        def run(batches):
            import pandas as pd

            for pdf in batches:
                rows = []
                for name in pdf["name"]:
                    words = name.split()
                    for s in stored(words):
                        for n, i, piece in shards_of(s):
                            rows.append((f"{n}.{i}.{piece}", True, name, s))
                    for form in orders(words) if probing else ():
                        for n, i, piece in probes_of(form):
                            rows.append((f"{n}.{i}.{piece}", False, name, form))
                yield pd.DataFrame(rows, columns=["shard", "stored", "name", "form"])

        return run

    schema = "shard string, stored boolean, name string, form string"
    even = own.repartition(n_buckets, "name")
    hot = (
        even.mapInPandas(spread(False), schema)
        .groupBy("shard")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > shard_names)
        .select("shard", F.ceil(F.col("n") / shard_names).cast("int").alias("parts"))
    )
    rows = even.mapInPandas(spread(True), schema).join(hot, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumns({"mine": F.pmod(F.xxhash64("name"), "parts"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    cell = F.when(F.col("stored"), F.concat_ws(".", "mine", "other")).otherwise(F.concat_ws(".", "other", "mine"))
    rows = rows.select(
        F.when(F.col("parts") > 1, F.concat_ws("#", "shard", cell)).otherwise(F.col("shard")).alias("shard"), "stored", "name", "form"
    ).withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(n_buckets)).cast("int"))

    def join(pdf):
        import pandas as pd

        tries: dict[str, Trie] = {}
        names_of: dict[tuple[str, str], list[str]] = {}
        st = pdf[pdf["stored"]]
        for shard, name, form in zip(st["shard"], st["name"], st["form"], strict=True):
            t = tries.get(shard)
            if t is None:
                t = tries[shard] = Trie()
            t.add(form)
            names_of.setdefault((shard, form), []).append(name)
        best: dict[tuple[str, str], int] = {}
        walked: dict[tuple[str, str], list] = {}
        qs = pdf[~pdf["stored"]]
        for shard, name, form in zip(qs["shard"], qs["name"], qs["form"], strict=True):
            t = tries.get(shard)
            if t is None:
                continue
            near = walked.get((shard, form))
            if near is None:
                near = walked[(shard, form)] = t.near(form, bound(len(form)))
            for other, d in near:
                for b in names_of[(shard, other)]:
                    if b != name:
                        key = (name, b) if name < b else (b, name)
                        if best.get(key, 99) > d:
                            best[key] = d
        return pd.DataFrame([(a, b, d) for (a, b), d in best.items()], columns=["a", "b", "distance"])

    pairs = rows.groupBy("bucket").applyInPandas(join, "a string, b string, distance int")
    return pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"))

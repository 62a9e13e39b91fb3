"""Columnar shredding of nested JSON records and reconstruction of flat tables.

Each record is split into leaf columns in the manner of column stores: a leaf
path has one entry per place where it occurs or where an enclosing value stops
short of it, with a repetition level (which array was advanced) and a
definition level (how much of the path exists).  Tables of repeated ancestors
are rebuilt from these level sequences alone.

Both steps are narrow: no shuffle, one record never meets another, so a hot
parent (one filing with a third of the rows) needs no special care.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "#"  # pseudo leaf of every object: s1 closed, s0 cut off
STEP = "[]"  # path step of an array element


class OpenObject(dict):
    """An object whose text ended before its closing brace."""


class OpenArray(list):
    """An array whose text ended before its closing bracket."""


class OpenText(str):
    """A string whose text ended before its closing quote."""


_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_BLANKS = {more: re.compile(rf"[\s{more}]*") for more in ("", ",", ":")}
_PLAIN = re.compile(r'[^"\\]*')
_BARE = re.compile(r"[^\s,\]}:]*")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class _Reader:
    """A forgiving JSON reader: missing ends yield the Open classes, stray
    characters between elements are skipped."""

    def __init__(self, text: str):
        self.s, self.i, self.n = text, 0, len(text)

    def blank(self, more: str = "") -> None:
        self.i = _BLANKS[more].match(self.s, self.i).end()

    def text(self) -> str:
        out, self.i = [], self.i + 1
        while self.i < self.n:
            m = _PLAIN.match(self.s, self.i)
            out.append(m.group())
            self.i = m.end()
            if self.i >= self.n:
                break
            if self.s[self.i] == '"':
                self.i += 1
                return "".join(out)
            if self.i + 1 >= self.n:
                break
            e = self.s[self.i + 1]
            if e == "u":
                code = self.s[self.i + 2 : self.i + 6]
                if len(code) < 4:
                    break
                try:
                    out.append(chr(int(code, 16)))
                except ValueError:
                    out.append("�")
                self.i += 6
            else:
                out.append(_ESCAPES.get(e, e))
                self.i += 2
        self.i = self.n
        return OpenText("".join(out))

    def value(self):
        """The value at the cursor; raises EOFError where none begins."""
        self.blank()
        if self.i >= self.n:
            raise EOFError
        c = self.s[self.i]
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c == '"':
            return self.text()
        for word, v in (("true", True), ("false", False), ("null", None)):
            if self.s.startswith(word, self.i):
                self.i += len(word)
                return v
            if word.startswith(self.s[self.i :]):
                self.i = self.n
                raise EOFError
        m = _NUMBER.match(self.s, self.i)
        if m:
            self.i = m.end()
            if self.i >= self.n:
                raise EOFError  # its last digits may be missing
            t = m.group()
            return float(t) if any(x in t for x in ".eE") else int(t)
        m = _BARE.match(self.s, self.i)
        self.i = max(m.end(), self.i + 1)
        return OpenText(m.group())

    def object(self):
        out, self.i = {}, self.i + 1
        while True:
            self.blank(",")
            if self.i >= self.n:
                return OpenObject(out)
            if self.s[self.i] == "}":
                self.i += 1
                return out
            if self.s[self.i] == "]":  # the brace is missing
                return OpenObject(out)
            if self.s[self.i] != '"':
                self.i += 1
                continue
            key = self.text()
            self.blank(":")
            if isinstance(key, OpenText) or self.i >= self.n:
                return OpenObject(out)
            if self.s[self.i] in ",}":
                out[key] = None
                continue
            try:
                out[key] = self.value()
            except EOFError:
                return OpenObject(out)

    def array(self):
        out, self.i = [], self.i + 1
        while True:
            self.blank(",")
            if self.i >= self.n:
                return OpenArray(out)
            if self.s[self.i] == "]":
                self.i += 1
                return out
            if self.s[self.i] in "}:":
                self.i += 1
                continue
            try:
                out.append(self.value())
            except EOFError:
                return OpenArray(out)


def _deep(f, *args):
    """``f``, again with room for any depth of nesting if it ran out of it."""
    try:
        return f(*args)
    except RecursionError:
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(10**6)
        try:
            return f(*args)
        finally:
            sys.setrecursionlimit(before)


def read_json(text: str | None):
    """The tree of a payload and its state: ``ok``, ``repaired``, ``empty``.

    Fences and words before the first bracket or after the last are dropped.
    A payload that ends early gives what was there, with the parts that were
    not closed marked by the Open classes.
    """
    if text is None or not text.strip():
        return None, "empty"
    try:
        tree = json.loads(text, strict=False)
        state = "ok"
    except ValueError:
        at = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
        if at < 0:
            return None, "empty"
        body = text[at:]
        try:
            tree, _ = json.JSONDecoder(strict=False).raw_decode(body)
            state = "ok"
        except ValueError:
            try:
                tree = _Reader(body).value()
            except EOFError:
                return None, "empty"
            state = "repaired"
    except RecursionError:
        # Too deep for the strict parser: the forgiving one reads it in full.
        at = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
        try:
            tree = _deep(_Reader(text[at:]).value)
        except EOFError:
            return None, "empty"
        state = "repaired" if isinstance(tree, (OpenObject, OpenArray)) else "ok"
    if isinstance(tree, str) and tree.lstrip()[:1] in ("{", "["):
        return read_json(tree)
    return tree, state


def _unwrap(v):
    """A string that is itself JSON stands for its content."""
    if isinstance(v, str):
        t = v.lstrip()
        if t[:1] not in ("[", "{"):
            return v
        try:
            inner = json.loads(t, strict=False)
        except ValueError:
            if not re.match(r'\[\s*(\{|$)|\{\s*("|$)', t):
                return v
            try:
                inner = _Reader(t).value()
            except EOFError:
                return v
        return inner if isinstance(inner, (dict, list)) else v
    return v


def _open_tree(v):
    v = _unwrap(v)
    if isinstance(v, dict):
        return type(v)({k: _open_tree(x) for k, x in v.items()})
    if isinstance(v, list):
        return type(v)([_open_tree(x) for x in v])
    return v


class _Schema:
    __slots__ = ("leaf", "keys", "element")

    def __init__(self):
        self.leaf, self.keys, self.element = False, None, None

    def learn(self, v) -> None:
        if isinstance(v, dict):
            self.keys = {} if self.keys is None else self.keys
            for k, x in v.items():
                if k not in self.keys:
                    self.keys[k] = _Schema()
                self.keys[k].learn(x)
        elif isinstance(v, list):
            if self.element is None:
                self.element = _Schema()
            for x in v:
                self.element.learn(x)
        else:
            self.leaf = True


def _step(key: str) -> str:
    """The path step of a key; keys that look like a mark get a dot in front."""
    return "." + key if key[:1] in ("[", "#", ".") else key


def _code(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "b" + ("true" if v else "false")
    if isinstance(v, str):
        return "s" + v
    return "n" + repr(v)


def shred_tree(tree, names: frozenset[str] | None = None) -> dict[tuple[str, ...], tuple[list[int], list[int], list[str | None]]]:
    """Leaf columns of one tree: path -> (repetition, definition, value).

    Values carry their JSON kind in front: ``s`` string, ``n`` number, ``b``
    boolean; None is a null or an absent value, told apart by the definition
    level.  Every object has the pseudo leaf ``#``, every array element that
    is neither object nor array is a leaf of the element path.  With
    ``names`` only values under these names and the marks of objects are kept.
    """
    return _deep(_shred_tree, tree, names)


def _shred_tree(tree, names):
    tree = _open_tree(tree)
    schema = _Schema()
    schema.learn(tree)
    out: dict = {}

    def emit(path, r, d, v):
        if names is not None and path[-1:] and path[-1] not in names:
            return
        c = out.get(path)
        if c is None:
            c = out[path] = ([], [], [])
        c[0].append(r)
        c[1].append(d)
        c[2].append(v)

    def absent(node, path, r, d):
        if node.keys is not None:
            emit((*path, MARK), r, d, None)
            for k, x in node.keys.items():
                absent(x, (*path, _step(k)), r, d)
        if node.element is not None:
            absent(node.element, (*path, STEP), r, d)
            emit((*path, STEP, STEP[0]), r, d, None)
        if node.leaf:
            emit(path, r, d, None)

    def walk(node, path, v, r, d, depth):
        """d counts the defined steps of path; depth its arrays."""
        if node.keys is not None:
            if isinstance(v, dict):
                emit((*path, MARK), r, d + 1, "s0" if isinstance(v, OpenObject) else "s1")
                for k, x in node.keys.items():
                    if k in v:
                        walk(x, (*path, _step(k)), v[k], r, d + 1, depth)
                    else:
                        absent(x, (*path, _step(k)), r, d)
            else:
                emit((*path, MARK), r, d, None)
                for k, x in node.keys.items():
                    absent(x, (*path, _step(k)), r, d)
        if node.element is not None:
            if isinstance(v, list) and v:
                for j, x in enumerate(v):
                    rr = depth + 1 if j else r
                    emit((*path, STEP, STEP[0]), rr, d + 1, "s1")
                    walk(node.element, (*path, STEP), x, rr, d + 1, depth + 1)
            else:
                emit((*path, STEP, STEP[0]), r, d, None)
                absent(node.element, (*path, STEP), r, d)
        if node.leaf:
            emit(path, r, d, None if isinstance(v, (dict, list)) else _code(v))

    walk(schema, (), tree, 0, 0, 0)
    return out


SHREDDED = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField(
            "leaves",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("path", T.ArrayType(T.StringType())),
                        T.StructField("reps", T.ArrayType(T.IntegerType())),
                        T.StructField("defs", T.ArrayType(T.IntegerType())),
                        T.StructField("vals", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)
_ARROW_LEAVES = pa.list_(
    pa.struct(
        [
            ("path", pa.list_(pa.string())),
            ("reps", pa.list_(pa.int32())),
            ("defs", pa.list_(pa.int32())),
            ("vals", pa.list_(pa.string())),
        ]
    )
)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that the trees of few records are held at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shred(df: DataFrame, key: str = "raw_id", payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """One row per record: key, kept columns, ``state`` and its leaf columns.

    Null, blank and unreadable payloads give state ``empty`` and no leaves.
    Repeated rows are shredded each by itself.  Columns not named are not read.
    """
    cols = [key, *keep]
    src = df.select(*cols, F.col(payload).cast("string").alias("__payload"))
    schema = T.StructType([src.schema[c] for c in cols] + SHREDDED.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            states, leaves = [], []
            for text in b.column(b.schema.get_field_index("__payload")).to_pylist():
                tree, state = read_json(text)
                states.append(state)
                leaves.append(
                    [
                        {"path": list(p), "reps": r, "defs": d, "vals": v}
                        for p, (r, d, v) in (shred_tree(tree).items() if isinstance(tree, (dict, list)) else ())
                    ]
                )
            arrays = [b.column(i) for i in range(len(cols))]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(states, pa.string()), pa.array(leaves, _ARROW_LEAVES)],
                names=[*cols, "state", "leaves"],
            )

    return src.mapInArrow(run, schema)


@dataclass(frozen=True)
class Child:
    """A table to rebuild: objects found under one of ``keys`` inside
    ``section``, as array elements or standing alone.

    ``label`` is the field that names a row; where the object has no string of
    that name the nearest enclosing object that has one gives it.
    """

    kind: str
    section: str
    keys: tuple[str, ...]
    label: str
    fields: tuple[str, ...] = ()


def positions(reps: Sequence[int], defs: Sequence[int], depth: int) -> list[tuple[int, ...]]:
    """Element positions (one per enclosing array) of the entries of a leaf."""
    at, out = [0] * (depth + 1), []
    for r in reps:
        if r == 0 and not out:
            at = [0] * (depth + 1)
        elif r > 0:
            at[r] += 1
            for k in range(r + 1, depth + 1):
                at[k] = 0
        out.append(tuple(at[1:]))
    return out


def leaf_names(children: Sequence[Child], fields: bool = True) -> frozenset[str]:
    """Names of the leaves that tables of these children are rebuilt from."""
    return frozenset({MARK, *(k.label for k in children), *(f.split(".")[-1] for k in children for f in (k.fields if fields else ()))})


def assemble_leaves(leaves: dict, children: Sequence[Child], fields: bool = True) -> Iterator[tuple]:
    """(kind, parent_no, child_no, label, {field: value}, path, place) of every
    closed child object, from the level sequences of its leaf columns.

    ``path`` names the way to the object with ``[]`` for each array, ``place``
    has its position in each of them: the two together are unique in a record,
    and all but the last place is that of the enclosing object.
    """

    def column(path):
        c = leaves.get(path)
        return {} if c is None else dict(zip(positions(c[0], c[1], path.count(STEP)), c[2], strict=True))

    for mark in [p for p in leaves if p and p[-1] == MARK]:
        base = mark[:-1]
        names = [x for x in base if x != STEP]
        for kind in children:
            if not names or names[-1] not in kind.keys or kind.section not in names[:-1]:
                continue
            depth = base.count(STEP)
            ends = (STEP, names[-1])
            standing = base[-1] != STEP
            if base[-1] not in ends:
                continue
            own = column((*base, kind.label))
            outer = []
            for cut in range(len(base) - 1, 0, -1):  # enclosing objects, nearest first
                if (*base[:cut], MARK) in leaves and base[:cut] != base:
                    c = column((*base[:cut], kind.label))
                    if c:
                        outer.append((base[:cut].count(STEP), c))
            wanted = {f: column((*base, *f.split("."))) for f in kind.fields} if fields else {}
            way = ".".join(base).replace(f".{STEP}", STEP)
            reps, defs, vals = leaves[mark]
            for where, closed in zip(positions(reps, defs, depth), vals, strict=True):
                if closed != "s1":
                    continue
                label = own.get(where)
                if label is None or label[0] != "s":
                    label = next((x for d, c in outer if (x := c.get(where[:d])) is not None and x[0] == "s"), "s")
                if standing:
                    child_no, parent_no = 0, where[-1] if where else 0
                else:
                    child_no, parent_no = where[-1], where[-2] if len(where) > 1 else 0
                yield kind.kind, parent_no, child_no, label[1:], {f: c.get(where) for f, c in wanted.items()}, way, where


FPR_CHILDREN = (
    Child(
        "item19_record",
        "item19_fpr",
        ("records", "metrics"),
        "cohort_raw",
        (
            "metric_name", "metric_raw", "cohort_name", "outlet_count", "unit_period", "reporting_year",
            "value_avg", "value_median", "percentiles.p25", "percentiles.p75", "source.page_number", "source.raw_text",
        ),
    ),
    Child("yearly_summary", "item20_outlets", ("yearly_summary",), "outlet_type", ("year", "outlets_start", "outlets_end")),
    Child(
        "state_year_status",
        "item20_outlets",
        ("state_year_status", "years"),
        "state",
        ("year", "outlets_start", "outlets_opened", "outlets_terminated", "outlets_end"),
    ),
)


def assemble(shredded: DataFrame, key: str = "raw_id", children: Sequence[Child] = FPR_CHILDREN) -> DataFrame:
    """Child rows of all kinds: key, child_kind, parent_no, child_no, label,
    ``fields`` (map from field path to value with its kind in front), path and
    place (see :func:`assemble_leaves`)."""
    leaves = lambda x: {tuple(c["path"]): (c["reps"], c["defs"], c["vals"]) for c in x or ()}
    return _assembled(shredded.select(key, "leaves"), key, children, leaves, True)


def children_of(df: DataFrame, key: str = "raw_id", payload: str = "payload", children: Sequence[Child] = FPR_CHILDREN, fields: bool = True) -> DataFrame:
    """The same as :func:`assemble` of :func:`shred` in one pass that keeps no
    leaf column which the asked tables do not need; without ``fields`` the maps
    are empty."""
    names = leaf_names(children, fields)

    def leaves(text):
        tree, _ = read_json(text)
        return shred_tree(tree, names) if isinstance(tree, (dict, list)) else {}

    return _assembled(df.select(key, F.col(payload).cast("string")), key, children, leaves, fields)


def _assembled(src: DataFrame, key: str, children: Sequence[Child], leaves_of, fields: bool) -> DataFrame:
    """Child rows of (key, something ``leaves_of`` makes leaf columns of)."""
    schema = T.StructType(
        [
            src.schema[key],
            T.StructField("child_kind", T.StringType()),
            T.StructField("parent_no", T.IntegerType()),
            T.StructField("child_no", T.IntegerType()),
            T.StructField("label", T.StringType()),
            T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
            T.StructField("path", T.StringType()),
            T.StructField("place", T.ArrayType(T.IntegerType())),
        ]
    )
    kinds = tuple(children)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            at, rows = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                mine = list(assemble_leaves(leaves_of(x), kinds, fields))
                at += [i] * len(mine)
                rows += mine
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at, pa.int64())),
                    pa.array(cols[0], pa.string()),
                    pa.array(cols[1], pa.int32()),
                    pa.array(cols[2], pa.int32()),
                    pa.array(cols[3], pa.string()),
                    pa.array([list(x.items()) for x in cols[4]], pa.map_(pa.string(), pa.string())),
                    pa.array(cols[5], pa.string()),
                    pa.array([list(x) for x in cols[6]], pa.list_(pa.int32())),
                ],
                names=schema.names,
            )

    return src.mapInArrow(run, schema)


def text_of(c: Column) -> Column:
    """The value without its kind mark."""
    return F.substring(c, 2, 2**31 - 1)


def number_of(c: Column, kind: str = "double") -> Column:
    """A number, also where it was written as text; null if it is none."""
    clean = F.regexp_replace(text_of(c), r"[,$\s]", "")
    value = clean.try_cast("double")
    return value.cast(kind) if kind == "double" else F.when(value == F.round(value), value).try_cast(kind)


def flag_of(c: Column) -> Column:
    """A flag written as boolean, number or word."""
    t = F.lower(F.trim(text_of(c)))
    return F.when(t.isin("true", "1", "yes", "y", "1.0"), True).when(t.isin("false", "0", "no", "n", "0.0"), False)


def child_rows(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """p1_found: one row per child object, see :func:`assemble`."""
    return children_of(df, key, payload, fields=False).select(key, "child_kind", "parent_no", "child_no", "label")


def parents_table(df: DataFrame, key: str = "raw_id", payload: str = "payload", kind: str = "state_year_status") -> DataFrame:
    """The enclosing objects of children that stand in arrays of arrays (a
    state above its years): key, path, place, label, n_children; a child's
    place without its last number is its parent's."""
    rows = children_of(df, key, payload, fields=False).filter((F.col("child_kind") == kind) & (F.size("place") > 1))
    above = F.regexp_replace("path", r"\.[^.\[\]]+\[\]$", "").alias("path")
    place = F.slice("place", 1, F.size("place") - 1).alias("place")
    return rows.groupBy(key, above, place).agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n_children"))


def filings_table(df: DataFrame, key: str = "raw_id", payload: str = "payload", keep: Sequence[str] = ("fdd_id",)) -> DataFrame:
    """The parent table: one row per payload with its scalars.

    ``has_item19`` is true if any section says so, else false if any does, else
    null; ``state`` tells whether the payload was whole.
    """
    s = shred(df, key, payload, keep)

    def leaf(*tail: str) -> Column:
        found = F.filter(
            "leaves",
            lambda x: F.filter(x["path"], lambda p: p != STEP) == F.array(*map(F.lit, tail)),
        )
        return F.flatten(F.transform(found, lambda x: F.filter(x["vals"], lambda v: v.isNotNull())))

    first = lambda *t: F.get(leaf(*t), F.lit(0))
    flags = F.transform(leaf("item19_fpr", "has_item19"), flag_of)
    return s.select(
        key,
        *keep,
        "state",
        text_of(first("metadata", "legal_name")).alias("legal_name"),
        text_of(first("metadata", "brand_name")).alias("brand_name"),
        number_of(first("metadata", "filing_year"), "int").alias("filing_year"),
        number_of(first("metadata", "confidence")).alias("confidence"),
        F.when(F.exists(flags, lambda f: f), True)
        .when(F.exists(flags, lambda f: ~f), False)
        .alias("has_item19"),
    )


def item19_table(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """Item-19 records with typed fields, tied to their filing by ``key``."""
    rows = children_of(df, key, payload, FPR_CHILDREN[:1])
    f = lambda n: F.col("fields")[n]
    return rows.select(
        key,
        "path",
        "place",
        "parent_no",
        "child_no",
        F.col("label").alias("cohort_raw"),
        *[text_of(f(n)).alias(n) for n in ("metric_name", "metric_raw", "cohort_name", "unit_period")],
        *[number_of(f(n), "int").alias(n) for n in ("outlet_count", "reporting_year")],
        *[number_of(f(n)).alias(n) for n in ("value_avg", "value_median")],
        number_of(f("percentiles.p25")).alias("percentile_25"),
        number_of(f("percentiles.p75")).alias("percentile_75"),
        number_of(f("source.page_number"), "int").alias("page_number"),
        text_of(f("source.raw_text")).alias("raw_text"),
    )


def item20_table(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """Item-20 rows (system-wide and by state), tied to their filing."""
    rows = children_of(df, key, payload, FPR_CHILDREN[1:])
    f = lambda n: F.col("fields")[n]
    yearly = F.col("child_kind") == "yearly_summary"
    return rows.select(
        key,
        "child_kind",
        "path",
        "place",
        "parent_no",
        "child_no",
        F.when(yearly, F.lit("TOTAL")).otherwise(F.col("label")).alias("state"),
        F.when(yearly, F.col("label")).alias("outlet_type"),
        *[
            number_of(f(n), "int").alias(n)
            for n in ("year", "outlets_start", "outlets_opened", "outlets_terminated", "outlets_end")
        ],
    )

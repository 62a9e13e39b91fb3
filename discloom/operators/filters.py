"""Filters as data: conjunctions that come from parameters, sorts, presets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """A conjunctive filter.  A bound of zero or None is no bound; a bound that
    is set drops nulls.  ``has`` asks a field to be there or not."""

    contains: Mapping[str, str] = field(default_factory=dict)
    equals: Mapping[str, str] = field(default_factory=dict)
    least: Mapping[str, float] = field(default_factory=dict)
    most: Mapping[str, float] = field(default_factory=dict)
    has: Mapping[str, bool] = field(default_factory=dict)
    sort: str = ""
    descending: bool = False
    limit: int = 0

    def condition(self) -> Column:
        tests = [F.lower(F.col(c)).contains(v.lower()) for c, v in self.contains.items() if v]
        tests += [F.col(c) == v for c, v in self.equals.items() if v not in (None, "")]
        tests += [F.col(c) >= v for c, v in self.least.items() if v]
        tests += [F.col(c) <= v for c, v in self.most.items() if v]
        tests += [F.col(c).isNotNull() if v else F.col(c).isNull() for c, v in self.has.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def apply(self, df: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
        """Filtered, sorted with nulls last either way, limited."""
        out = df.filter(self.condition())
        if self.sort:
            c = F.desc_nulls_last(self.sort) if self.descending else F.asc_nulls_last(self.sort)
            out = out.orderBy(c, *tie)
        return out.limit(self.limit) if self.limit else out

    def to_params(self) -> str:
        out = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Mapping):
                out += [(f"{f.name}.{k}", x if not isinstance(x, bool) else int(x)) for k, x in v.items()]
            elif v:
                out.append((f.name, int(v) if isinstance(v, bool) else v))
        return urlencode(out)

    @classmethod
    def from_params(cls, text: str) -> Spec:
        got: dict = {}
        for k, v in parse_qsl(text):
            name, _, c = k.partition(".")
            if c:
                kind = {"least": float, "most": float, "has": lambda x: x == "1"}.get(name, str)
                got.setdefault(name, {})[c] = kind(v)
            elif name in ("limit", "descending"):
                got[name] = int(v) if name == "limit" else v == "1"
            elif name == "sort":
                got[name] = v
        return cls(**got)


def within_budget(c: Column, most: float) -> Column:
    """At most a budget; unknown and zero pass."""
    return c.isNull() | (c == 0) | (c <= most)


def visible(df: DataFrame, columns: Sequence[str], hidden: Sequence[str] = ()) -> DataFrame:
    """The chosen columns that exist, in their order."""
    return df.select(*[c for c in columns if c in df.columns and c not in hidden])


def sort_key(c: str, descending: bool = False, nulls: str = "engine", nocase: bool = False) -> Column:
    """A sort column: ``nulls`` first, last, or as small as the engine has them
    (first upwards, last downwards); ``nocase`` orders without case."""
    x = F.lower(c) if nocase else F.col(c)
    if nulls == "engine":
        nulls = "last" if descending else "first"
    return getattr(x, f"{'desc' if descending else 'asc'}_nulls_{nulls}")()

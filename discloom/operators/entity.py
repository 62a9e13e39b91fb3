"""Entities and duplicates: keys, matches in tiers, groups, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloom.operators.latest import latest
from discloom.session import write_cut


def match_entity(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming rows (name_key, industry, state) with ``match_id`` of a known
    entity (id, name_key, industry, state): same key and industry; of several
    one in the same state, else the lowest id.  Null or empty keys match none."""
    k = known.select(F.col("id").alias("__id"), "name_key", "industry", F.col("state").alias("__st")).filter(
        (F.col("name_key") != "") & F.col("industry").isNotNull()
    )
    any_ = k.groupBy("name_key", "industry").agg(F.min("__id").alias("__any"))
    same = k.groupBy("name_key", "industry", F.col("__st").alias("state")).agg(F.min("__id").alias("__same"))
    return (
        incoming.join(any_, ["name_key", "industry"], "left")
        .join(same, ["name_key", "industry", "state"], "left")
        .withColumn("match_id", F.coalesce("__same", "__any"))
        .drop("__same", "__any")
        .select(*incoming.columns, "match_id")
    )


def link_components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, component: the smallest node each one is linked to.

    ``edges`` has a, b.  Labels spread along links and through the label's own
    label (which halves long chains); each round is written to the shared
    folder.  Raises if ``rounds`` do not suffice, so no half result is given.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = write_cut(both, "links")
    label = write_cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    for _ in range(rounds):
        spread = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(spread, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        nxt = write_cut(step.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label")), "labels")
        if not nxt.filter(F.col("old") != F.col("label")).limit(1).count():
            return nxt.select("node", F.col("label").alias("component"))
        label = nxt.select("node", "label")
    raise RuntimeError(f"links are longer than {rounds} rounds reach")


def registry(filings: DataFrame) -> DataFrame:
    """filing, entity: filings (filing, ord, sha, name_key, industry, slug) of
    one entity share a hash, or key and industry, or slug; the entity is the
    first of them in ``ord``."""
    keys = F.array_compact(
        F.array(
            F.when(F.col("sha").isNotNull(), F.concat(F.lit("h:"), "sha")),
            F.when((F.col("name_key") != "") & F.col("industry").isNotNull(), F.concat(F.lit("n:"), "name_key", F.lit("|"), "industry")),
            F.when(F.col("slug").isNotNull(), F.concat(F.lit("s:"), "slug")),
        )
    )
    hubs = filings.select("ord", F.explode(keys).alias("k"))
    first = hubs.groupBy("k").agg(F.min("ord").alias("b"))
    edges = hubs.join(first, "k").select(F.col("ord").alias("a"), "b").distinct()
    lone = filings.select(F.col("ord").alias("a"), F.col("ord").alias("b"))
    c = link_components(edges.unionByName(lone))
    return filings.join(c, filings["ord"] == c["node"]).select("filing", F.col("component").alias("entity"))


def duplicate_groups(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """key, n, keeper of each key with several rows; the lowest id is kept."""
    return df.select(key.alias("key"), F.col(id_)).filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(id_).alias("keeper")
    ).filter(F.col("n") > 1)


def merge_plan(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """id, keeper of every row that a merge would drop."""
    keyed = df.select(key.alias("key"), F.col(id_).alias("id"))
    return keyed.join(duplicate_groups(df, key, id_), "key").filter(F.col("id") != F.col("keeper")).select("id", "keeper")


def repoint(facts: DataFrame, plan: DataFrame, fk: str) -> DataFrame:
    """Facts whose foreign key follows a merge plan."""
    p = plan.select(F.col("id").alias(fk), F.col("keeper").alias("__k"))
    return facts.join(p, fk, "left").withColumn(fk, F.coalesce("__k", fk)).select(*facts.columns)


def content_classes(df: DataFrame, text: str, id_: str) -> DataFrame:
    """id, class_id: rows of equal bytes share the smallest id (null texts are
    a class of their own each)."""
    h = df.select(F.col(id_).alias("id"), F.sha2(F.col(text), 256).alias("sha"))
    first = h.filter(F.col("sha").isNotNull()).groupBy("sha").agg(F.min("id").alias("class_id"))
    return h.join(first, "sha", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def new_or_update(incoming: DataFrame, known: DataFrame, key: str, year: str) -> DataFrame:
    """NEW for a key not known, UPDATE for a later year, else SKIP."""
    top = known.groupBy(key).agg(F.max(year).alias("__y"))
    status = F.when(F.col("__y").isNull(), "NEW").when(F.col(year) > F.col("__y"), "UPDATE").otherwise("SKIP")
    return incoming.join(top, key, "left").withColumn("status", status).drop("__y")


def upsert(old: DataFrame, new: DataFrame, key: str, fill_only: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Old rows with the non-null values of new ones, and new keys appended.
    Columns of ``fill_only`` keep what they have unless null or empty.  Of
    several new rows of a key the last in ``order`` counts, then the largest in
    the order of its columns."""
    cols = [c for c in old.columns if c != key]
    n = latest(new, [key], [*order, *[c for c in new.columns if c not in order]]).select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    j = old.join(n, key, "full")
    pick = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")).cast(old.schema[c].dataType), F.col(f"__{c}")) if c in fill_only else F.coalesce(F.col(f"__{c}"), F.col(c))
    return j.select(key, *[pick(c).alias(c) for c in cols])


def replace_by_key(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows of keys that come anew give way to the new ones."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def append_new(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New keys are appended, the first row of each; known ones stay as they are."""
    return old.unionByName(latest(new.join(old, key, "left_anti"), [key], [order], smallest=True))


def content_keys(df: DataFrame, slug: Column, date: Column, year: Column) -> DataFrame:
    """Adds content_key and confidence: name and date (high), else name and
    year (medium), else the name alone (low); null without a name."""
    s, d, y = F.nullif(slug, F.lit("")), date.cast("string"), year.cast("string")
    key = F.concat_ws("|", s, F.coalesce(d, y))
    sure = F.when(d.isNotNull(), "high").when(y.isNotNull(), "medium").otherwise("low")
    return df.withColumns({"content_key": F.when(s.isNotNull(), key), "confidence": F.when(s.isNotNull(), sure)})


def first_of_content(df: DataFrame, sha: str, id_: str) -> DataFrame:
    """id, same_as, by of rows (with :func:`content_keys`) that an earlier one
    (smaller id) already holds: by its bytes, else by its content key unless
    the key is of low confidence."""
    own = df.select(F.col(id_).alias("id"), F.col(sha).alias("sha"), F.when(F.col("confidence") != "low", F.col("content_key")).alias("key"))
    first = lambda c, n: own.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias(n))
    j = own.join(first("sha", "a"), "sha", "left").join(first("key", "b"), "key", "left")
    by = F.when(F.col("a") < F.col("id"), "sha").when(F.col("b") < F.col("id"), "content")
    return j.select("id", F.when(by == "sha", F.col("a")).when(by == "content", F.col("b")).alias("same_as"), by.alias("by")).filter(F.col("by").isNotNull())


def replace_issues(old: DataFrame, new: DataFrame, checked: DataFrame, key: str = "key", source: str = "source") -> DataFrame:
    """Old issues without those of the (key, source) that were checked anew
    (column pairs of ``checked``, with or without findings), and the new ones."""
    return old.join(checked.select(key, source).distinct(), [key, source], "left_anti").unionByName(new)

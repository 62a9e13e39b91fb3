"""Files whose fields change over time: one consistent table and a report.

Rows are read as path-value maps with raw JSON kinds (the VARIANT type, so all
of it stays in the JVM), path and kind statistics are aggregated by file, and
changes are found by comparing each file with the one before it in its feed.

A removed and an added field of one step are one renamed field if the same
content goes on: their value profiles agree over all files of the kind and the
two names never stand in one file together.

Scale: only (feed, file, field) statistics are shuffled, combined on the map
side first, so a feed with a third of all rows costs no more than its number
of files; pairs are formed only among fields removed and added in one step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from discloom.session import write_cut

NESTED = "records"
#: A profile agreement from which two fields hold the same content, and the
#: weight of the names beside it.
CONTENT_LEAST, NAME_WEIGHT = 0.45, 0.35
#: Names are different fields if they stand together in this share of the files
#: of the rarer one.
TOGETHER = 0.05


_KINDS = {
    "VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array", "OBJECT": "object",
    "BIGINT": "number", "DOUBLE": "number", "FLOAT": "number", "DECIMAL": "number", "INT": "number",
}


def json_kind(v: Column) -> Column:
    """string, number, boolean, array, object or null of a VARIANT."""
    names = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return F.coalesce(names[F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)], F.lit("null"))


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """A column that is computed once however often it is used: a generator
    of one row, which projections and filters are not merged with."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _objects(df: DataFrame, payload: str, keys: Sequence[str]) -> DataFrame:
    """keys and __v, the VARIANT of each payload that is one JSON object."""
    read = _once(df.select(*keys, payload), "__v", F.try_parse_json(F.col(payload))).drop(payload)
    return read.filter(F.schema_of_variant("__v").startswith("OBJECT"))


def _nested(v: Column, nested: str) -> Column:
    """The objects of the array ``nested``, or the one object it is, as maps;
    null for other elements."""
    many = F.try_variant_get(v, f"$.{nested}", "array<variant>")
    one = F.array(F.try_variant_get(v, f"$.{nested}", "variant"))
    return F.transform(F.coalesce(many, one), lambda x: F.try_variant_get(x, "$", "map<string,variant>"))


def path_values(df: DataFrame, payload: str = "payload", keys: Sequence[str] = ("row_id", "feed_id", "file_no", "item_kind"), nested: str = NESTED) -> DataFrame:
    """keys, field, value (VARIANT): the top-level keys of each readable row
    and, as ``records.x``, the keys of the objects in its array.

    Rows that are not one JSON object (null, blank, cut off, another kind, a
    key given twice) are unreadable and give nothing.  Each payload is parsed
    once.
    """
    pairs = lambda m, before: F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit(before), e["key"]).alias("field"), e["value"].alias("value")))
    none = F.expr("cast(array() as array<struct<field:string,value:variant>>)")
    top = F.coalesce(pairs(F.try_variant_get("__v", "$", "map<string,variant>"), ""), none)
    inner = F.flatten(F.transform(_nested(F.col("__v"), nested), lambda m: F.coalesce(pairs(m, f"{nested}."), none)))
    read = _objects(df, payload, keys)
    return read.select(*keys, F.explode(F.concat(top, F.coalesce(inner, none))).alias("__x")).select(*keys, "__x.field", "__x.value")


def _unwrapped(v: Column) -> Column:
    """The scalar of a value as text, out of a list of one or an object that
    holds it; longer lists stay whole."""
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(
        F.when(F.size(many) == 1, F.try_variant_get(v, "$[0]", "string")),
        F.try_variant_get(v, "$.value", "string"),
        F.try_variant_get(v, "$", "string"),
    )


def as_number(text: Column) -> Column:
    """A number also from text with dollar sign, commas or percent."""
    return F.regexp_replace(F.trim(text), r"[$,%\s]", "").try_cast("double")


def as_flag(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "y", "1", "1.0"), True).when(t.isin("false", "no", "n", "0", "0.0"), False)


def _features(text: Column) -> Column:
    """What a value is made of: numbers by quarter decade, flags, words and
    the shapes of words."""
    x = as_number(text)
    number = F.array(
        F.concat(
            F.lit("n"),
            F.when(x < 0, "-").otherwise(""),
            F.floor(F.log10(F.abs(x) + F.lit(0.001)) * 4).cast("string"),
        )
    )
    low = F.lower(F.trim(text))
    split = F.filter(F.split(F.trim(text), r"[^\p{L}\p{N}$]+"), lambda w: F.length(w) > 0)
    shape = lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\p{N}+", "9")
    words = F.concat(
        F.transform(split, lambda w: F.concat(F.lit("t"), F.lower(w))),
        F.transform(split, lambda w: F.concat(F.lit("s"), shape(w))),
    )
    return F.when(low.isin("true", "false", "yes", "no"), F.array(F.lit("b"))).when(x.isNotNull(), number).otherwise(words)


def file_statistics(values: DataFrame) -> DataFrame:
    """Path and kind statistics by file: one row per feed, file and field with
    ``n`` rows, ``n_value`` non-null values and the ``kind`` most of them have."""
    k = json_kind(F.col("value"))
    per_kind = values.groupBy("feed_id", "item_kind", "file_no", "field", k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    real = F.col("kind") != "null"
    return per_kind.groupBy("feed_id", "item_kind", "file_no", "field").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("n_value"),
        F.max_by("kind", F.when(real, F.struct("n", "kind"))).alias("kind"),
    ).withColumn("kind", F.when(F.col("n_value") > 0, F.col("kind")))


def _norm_name(c: Column) -> Column:
    """Words of a field name, camel case and snake case alike."""
    tail = F.regexp_replace(c, r"^.*\.", "")
    snake = F.lower(F.regexp_replace(tail, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.filter(F.split(snake, r"[^a-z0-9]+"), lambda w: F.length(w) > 0)


def _name_likeness(a: Column, b: Column) -> Column:
    """Shared words, or shared beginnings of the joined names."""
    wa, wb = _norm_name(a), _norm_name(b)
    ja, jb = F.array_join(wa, ""), F.array_join(wb, "")
    jaccard = F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(F.array_union(wa, wb)), F.lit(1))
    edits = 1 - F.levenshtein(ja, jb) / F.greatest(F.length(ja), F.length(jb), F.lit(1))
    return F.greatest(jaccard, edits, F.when(ja.contains(jb) | jb.contains(ja), 0.8).otherwise(0.0))


def changes(df: DataFrame, nested: str = NESTED, stats: DataFrame | None = None) -> DataFrame:
    """p4_found: feed_id, file_no, change_kind, field_old, field_new.

    Late and repeated rows belong to the file they name.  A file with no
    readable row has no fields.  The first file of a feed changes nothing.
    Ties between rename partners go to the alphabetically first names.
    ``stats``: the :func:`file_statistics` of the same rows, if at hand.
    """
    files = df.select("feed_id", "file_no").distinct()
    by_feed = W.partitionBy("feed_id")
    seq = files.select(
        "feed_id",
        "file_no",
        F.row_number().over(by_feed.orderBy("file_no")).alias("seq"),
        F.count(F.lit(1)).over(by_feed).alias("last_seq"),
        F.lead("file_no").over(by_feed.orderBy("file_no")).alias("next_file"),
    )
    values = path_values(df, nested=nested)
    stats = write_cut(file_statistics(values), "drift-stats") if stats is None else stats
    present = stats.join(seq, ["feed_id", "file_no"])
    by_field = W.partitionBy("feed_id", "field").orderBy("seq")
    steps = present.select(
        "feed_id",
        "item_kind",
        "file_no",
        "seq",
        "field",
        "kind",
        "next_file",
        F.lag("seq").over(by_field).alias("before"),
        F.lead("seq").over(by_field).alias("after"),
        F.last("kind", ignorenulls=True).over(by_field.rowsBetween(W.unboundedPreceding, -1)).alias("kind_before"),
        "last_seq",
    )
    new = (F.col("seq") > 1) & (F.coalesce("before", F.lit(0)) != F.col("seq") - 1)
    gone = (F.col("seq") < F.col("last_seq")) & (F.coalesce("after", F.lit(0)) != F.col("seq") + 1)
    other = F.col("kind") != F.col("kind_before")
    mark = lambda when, what, at: F.when(when, F.struct(F.lit(what).alias("what"), F.col(at).alias("file_no")))
    marks = steps.select(
        "feed_id",
        "item_kind",
        "field",
        F.explode(
            F.array_compact(F.array(mark(new, "added", "file_no"), mark(gone, "removed", "next_file"), mark(other, "retyped", "file_no")))
        ).alias("m"),
    ).select("feed_id", "item_kind", "field", "m.what", "m.file_no")
    marks = write_cut(marks, "drift-marks")
    of = lambda what, name: marks.filter(F.col("what") == what).select("feed_id", "item_kind", "file_no", F.col("field").alias(name))
    added, removed = of("added", "field_new"), of("removed", "field_old")
    retyped = of("retyped", "field_old").select(
        "feed_id", "file_no", F.lit("retyped").alias("change_kind"), "field_old", F.col("field_old").alias("field_new")
    )
    level = lambda c: F.col(c).startswith(f"{nested}.")
    pairs = removed.join(added, ["feed_id", "item_kind", "file_no"]).filter(level("field_old") == level("field_new"))
    names = pairs.select("item_kind", "field_old", "field_new").distinct()

    # Names that stand in one file together are different fields.
    own = stats.select("item_kind", "feed_id", "file_no", "field")
    sizes = own.groupBy("item_kind", "field").agg(F.count(F.lit(1)).alias("files"))
    size_of = lambda name: sizes.select("item_kind", F.col("field").alias(name), F.col("files").alias(f"n_{name}"))
    together = (
        names.join(own.withColumnRenamed("field", "field_old"), ["item_kind", "field_old"])
        .join(own.withColumnRenamed("field", "field_new"), ["item_kind", "feed_id", "file_no", "field_new"], "left_semi")
        .groupBy("item_kind", "field_old", "field_new")
        .agg(F.count(F.lit(1)).alias("both"))
        .join(size_of("field_old"), ["item_kind", "field_old"])
        .join(size_of("field_new"), ["item_kind", "field_new"])
        .filter(F.col("both") >= TOGETHER * F.least("n_field_old", "n_field_new"))
        .select("item_kind", "field_old", "field_new")
    )
    apart = write_cut(names.join(together, ["item_kind", "field_old", "field_new"], "left_anti"), "drift-names")

    # Value profiles over all files of the kind.
    used = apart.select("item_kind", F.explode(F.array("field_old", "field_new")).alias("field")).distinct()
    feats = (
        values.join(used, ["item_kind", "field"])
        .select("item_kind", "field", F.explode(_features(_unwrapped(F.col("value")))).alias("feature"))
        .groupBy("item_kind", "field", "feature")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    feats = write_cut(feats, "drift-features")
    total = feats.groupBy("item_kind", "field").agg(F.sum("n").alias("total"))
    profile = feats.join(total, ["item_kind", "field"]).select("item_kind", "field", "feature", (F.col("n") / F.col("total")).alias("p"))
    agreed = (
        apart.join(profile.select("item_kind", F.col("field").alias("field_old"), "feature", F.col("p").alias("p_old")), ["item_kind", "field_old"])
        .join(profile.select("item_kind", F.col("field").alias("field_new"), "feature", F.col("p").alias("p_new")), ["item_kind", "field_new", "feature"])
        .groupBy("item_kind", "field_old", "field_new")
        .agg(F.sum(F.least("p_old", "p_new")).alias("content"))
    )
    scored = (
        pairs.join(apart, ["item_kind", "field_old", "field_new"])
        .join(agreed, ["item_kind", "field_old", "field_new"], "left")
        .withColumn("content", F.coalesce("content", F.lit(0.0)))
        .withColumn("alike", _name_likeness(F.col("field_old"), F.col("field_new")))
        .withColumn("score", F.col("content") + NAME_WEIGHT * F.col("alike"))
        .filter(
            (F.col("content") >= CONTENT_LEAST)
            | ((F.col("content") >= CONTENT_LEAST / 2) & (F.col("alike") >= 0.5))
            | (F.col("alike") == 1)
        )
    )
    at = ["feed_id", "file_no"]
    best = scored.withColumns(
        {
            "r_old": F.row_number().over(W.partitionBy(*at, "field_old").orderBy(F.desc("score"), "field_new")),
            "r_new": F.row_number().over(W.partitionBy(*at, "field_new").orderBy(F.desc("score"), "field_old")),
        }
    ).filter((F.col("r_old") == 1) & (F.col("r_new") == 1))
    renamed = best.select(*at, F.lit("renamed").alias("change_kind"), "field_old", "field_new")
    out = [
        renamed,
        added.join(renamed.select(*at, "field_new"), [*at, "field_new"], "left_anti").select(
            *at, F.lit("added").alias("change_kind"), F.lit("").alias("field_old"), "field_new"
        ),
        removed.join(renamed.select(*at, "field_old"), [*at, "field_old"], "left_anti").select(
            *at, F.lit("removed").alias("change_kind"), "field_old", F.lit("").alias("field_new")
        ),
        retyped,
    ]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def canonical_names(found: DataFrame, stats: DataFrame) -> DataFrame:
    """item_kind, field, canonical: names joined by renames share the name
    most rows use, of equals the first.  The links are closed on the cluster."""
    from discloom.operators.entity import link_components

    node = lambda c: F.concat_ws("\u0001", "item_kind", c)
    kinds = stats.groupBy("item_kind", "field").agg(F.sum("n").alias("n"))
    feeds = stats.select("feed_id", "item_kind").distinct()
    edges = found.filter(F.col("change_kind") == "renamed").join(feeds, "feed_id").select(node("field_old").alias("a"), node("field_new").alias("b")).distinct()
    parts = link_components(edges.unionByName(kinds.select(node("field").alias("a"), node("field").alias("b"))))
    named = kinds.withColumn("node", node("field")).join(parts, "node")
    best = named.groupBy("component").agg(F.max_by("field", F.struct("n", F.lit(-1) * F.length("field"), F.translate("field", _UP, _DOWN))).alias("canonical"))
    return write_cut(named.join(best, "component").select("item_kind", "field", "canonical"), "canonical")


#: Letters turned round, so that the largest is the first in the alphabet.
_UP = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_DOWN = _UP[::-1]
#: Share of a field's values that a type must fit.
FITS = 0.75


def target_types(values: DataFrame, names: DataFrame) -> DataFrame:
    """item_kind, canonical, kind: the type each canonical field is read as, the
    one at least FITS of its non-null values fit (boolean before double), else
    string."""
    t = _unwrapped(F.col("value"))
    joined = values.join(names, ["item_kind", "field"]).withColumn("__t", t)
    rows = joined.groupBy("item_kind", "canonical").agg(
        F.count("__t").alias("n"),
        F.count(as_flag(F.col("__t"))).alias("flags"),
        F.count(as_number(F.col("__t"))).alias("numbers"),
        F.count_if((json_kind(F.col("value")).isin("array", "object")) & (F.col("field") == NESTED)).alias("lists"),
    )
    enough = lambda c: (F.col("n") > 0) & (F.col(c) >= FITS * F.col("n"))
    kind = F.when(F.col("lists") > 0, "string").when(enough("flags"), "boolean").when(enough("numbers"), "double").otherwise("string")
    return write_cut(rows.select("item_kind", "canonical", kind.alias("kind")), "types")


def _typed(text: Column, kind: str) -> Column:
    return {"double": as_number, "boolean": as_flag}.get(kind, lambda c: c)(text)


def schema_of(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_kind, field, canonical) and (item_kind, canonical, kind) of all
    fields of all files."""
    values = path_values(df)
    stats = write_cut(file_statistics(values), "drift-stats")
    names = canonical_names(changes(df, stats=stats), stats)
    return names, target_types(values, names)


def _columns(names: DataFrame, kinds: DataFrame, item_kind: str) -> list[tuple[str, str, list[str]]]:
    """(canonical, kind, spellings) of the fields of a kind: the columns of its
    tables, which the driver must know to declare them."""
    rows = names.join(kinds, ["item_kind", "canonical"]).filter(F.col("item_kind") == item_kind).groupBy("canonical", "kind").agg(F.array_sort(F.collect_set("field")).alias("f"))
    return sorted((r.canonical, r.kind, r.f) for r in rows.collect())


def consistent_table(df: DataFrame, item_kind: str) -> DataFrame:
    """All rows of a kind in one table: row_id, feed_id, file_no and a typed
    column per canonical top-level field (names in alphabetical order).

    A row that cannot be read keeps its keys with nulls.  A value that does
    not fit its column is null here and counted by :func:`failed_casts`.  The
    objects in ``records`` have a table of their own, see
    :func:`records_table`; beside it the field is a column of JSON text.
    """
    own = df.filter(F.col("item_kind") == item_kind)
    cols = [c for c in _columns(*schema_of(own), item_kind) if not c[0].startswith(f"{NESTED}.")]
    v = _once(own.select("row_id", "feed_id", "file_no", "payload"), "__v", F.try_parse_json("payload")).drop("payload")
    texts = F.transform_values(
        F.try_variant_get(F.when(F.schema_of_variant("__v").startswith("OBJECT"), F.col("__v")), "$", "map<string,variant>"),
        lambda k, x: F.when(k == NESTED, F.to_json(x)).otherwise(_unwrapped(x)),
    )
    src = _once(v, "__m", texts)
    pick = lambda names: F.coalesce(*[F.col("__m")[f] for f in names])
    return src.select("row_id", "feed_id", "file_no", *[_typed(pick(f), kind).alias(c) for c, kind, f in cols])


def records_table(df: DataFrame, item_kind: str, nested: str = NESTED) -> DataFrame:
    """The objects in the array of all rows of a kind, in one table: row_id,
    feed_id, file_no, record_no (0-based, all elements counted) and a typed
    column per canonical field, without the array's name in front.

    Elements that are no objects have no row; a lone object has number 0.
    """
    own = df.filter(F.col("item_kind") == item_kind)
    cut = len(nested) + 1
    cols = [(c[cut:], kind, [x[cut:] for x in f]) for c, kind, f in _columns(*schema_of(own), item_kind) if c.startswith(f"{nested}.")]
    keys = ("row_id", "feed_id", "file_no")
    each = _objects(own, "payload", keys).select(*keys, F.posexplode(_nested(F.col("__v"), nested)).alias("record_no", "__m")).filter(F.col("__m").isNotNull())
    src = _once(each, "__t", F.transform_values("__m", lambda k, x: _unwrapped(x)))
    pick = lambda names: F.coalesce(*[F.col("__t")[f] for f in names])
    return src.select(*keys, "record_no", *[_typed(pick(f), kind).alias(c) for c, kind, f in cols])


def failed_casts(df: DataFrame) -> DataFrame:
    """item_kind, feed_id, file_no, field, kind, n_failed, example: values that
    do not fit the type of their column, the smallest in text order as
    example."""
    names, kinds = schema_of(df)
    joined = path_values(df).join(names.join(kinds, ["item_kind", "canonical"]), ["item_kind", "field"]).withColumn("__t", _unwrapped(F.col("value")))
    t = F.col("__t")
    bad = ((F.col("kind") == "double") & as_number(t).isNull()) | ((F.col("kind") == "boolean") & as_flag(t).isNull())
    return joined.filter(t.isNotNull() & bad).groupBy("item_kind", "feed_id", "file_no", "field", "kind").agg(F.count(F.lit(1)).alias("n_failed"), F.min("__t").alias("example"))

"""Variant spellings of names that denote the same system.

Distinct brand cores and company cores are joined by tries (names.trie_join);
each spelling then goes to the most frequent spelling near it, if the rows
agree on the company.  Brands cut down to initials, pet forms or beginnings,
rows without a brand, and every system beside a larger one of its company or
website are settled by that company's or website's system.

All steps are equi-joins on names or systems, so nothing is compared within a
group; the only pairs formed are those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloom.llm.names import Words, brand_parts, common_words, company_parts, fits, is_cut, is_initials, named, trie_join, without_form
from discloom.session import write_cut

#: Letters up to which a single word may be a pet form or a beginning.
SHORT_NAME = 8
#: Letters from which names of one trade within the bound of edits are one brand.
LONG_NAME = 10
#: Edits between a brand and its company's name up to which the one is named after the other.
NAMED_AFTER = 4

PARSED = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("core", T.StringType()),
        T.StructField("trade", T.StringType()),
        T.StructField("comp", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("short", T.BooleanType()),
    ]
)


def parse(rows: DataFrame, words: Words | None = None) -> DataFrame:
    """key, core, trade, comp, site, short of rows (key, brand, legal, site).

    A trading name given with the company stands in for a brand that is missing
    or in initials; ``short`` marks brands that are (still) initials, cut off or one short word,
    which only a company or website can tell apart.
    Distinct texts are read once.
    """
    learnt = Words(common_words(named(rows))) if words is None else words
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ("brand", "legal")), *(PARSED[c] for c in ("core", "trade", "comp", "short"))])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for brand, legal in zip(pdf["brand"], pdf["legal"], strict=True):
                comp, dba = company_parts(legal, learnt)
                core, trade = brand_parts(brand, learnt)
                initials = len(core) == 1 and not trade and is_initials((brand or "").strip(), core[0])
                if dba and (not core or initials):
                    c2, t2 = brand_parts(without_form(dba), learnt)
                    if c2:
                        core, trade, initials = c2, t2, False
                cut = is_cut(brand, core, initials, SHORT_NAME)
                out.append((brand, legal, " ".join(core), trade, comp, cut))
            yield pd.DataFrame(out, columns=schema.names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = write_cut(rows.select("brand", "legal").distinct().repartition(n).mapInPandas(run, schema), "names").withColumnsRenamed({"brand": "__b", "legal": "__l"})
    host = F.regexp_extract(F.regexp_replace(F.lower(F.trim("site")), r"^(?:https?://)?(?:www\d?\.)?", ""), r"^([^/]*)", 1)
    site = F.coalesce(F.regexp_replace(host, r"\.[^.]*$", ""), F.lit(""))
    same = rows["brand"].eqNullSafe(texts["__b"]) & rows["legal"].eqNullSafe(texts["__l"])
    return rows.join(texts, same).select("key", "core", "trade", "comp", site.alias("site"), "short")


def _centers(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """name, center: the most frequent allowed spelling near a name, followed
    to the end.  ``edges`` has a, b in both directions.

    Every step leads to a more frequent spelling, so there are no rings; each
    round takes four times the steps, until nothing moves.
    """
    near = (
        edges.join(counts.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
        .join(counts.select(F.col("name").alias("a"), F.col("n").alias("na")), "a")
        .filter((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))
        .groupBy("a")
        .agg(F.min_by("b", F.struct(-F.col("nb"), F.col("b"))).alias("next"))
    )
    step = counts.select("name").join(near, F.col("name") == F.col("a"), "left").select("name", F.coalesce("next", "name").alias("center"))
    out = write_cut(step, "centers")
    while True:
        # Three more steps of the present length at once; few chains are longer.
        on = out.filter(F.col("name") != F.col("center")).select(F.col("name").alias("center"), F.col("center").alias("__c"))
        far = out
        for _ in range(3):
            far = far.join(on, "center", "left").select("name", F.coalesce("__c", "center").alias("center"))
        out = write_cut(far, "centers")
        ends = out.filter(F.col("name") != F.col("center")).select(F.col("name").alias("center"))
        if not out.join(ends, "center", "left_semi").limit(1).count():
            return out


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "distance").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def _subset(a: Column, b: Column) -> Column:
    """Whether all words of a stand in b."""
    return F.size(F.array_except(F.split(a, " "), F.split(b, " "))) == 0


def systems(rows: DataFrame) -> DataFrame:
    """key, system: the system each row names; rows that name none are absent.

    Input columns: key, brand, legal, site (nulls and fillers allowed).  A name
    that stands alone is a system of its own.
    """
    p = write_cut(parse(rows), "parsed")
    comp_counts = p.filter(F.col("comp") != "").groupBy(F.col("comp").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    comp_edges = _both(trie_join(comp_counts))
    comps = _centers(comp_counts, comp_edges)
    p = write_cut(p.join(comps.select(F.col("name").alias("comp"), F.col("center").alias("cid")), "comp", "left"), "companies")

    full = p.filter((F.col("core") != "") & ~F.col("short"))
    core_counts = full.groupBy(F.col("core").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    spelt_short = p.filter((F.col("core") != "") & F.col("short")).select(F.col("core").alias("name"))
    edges = write_cut(_both(trie_join(core_counts.select("name").unionByName(spelt_short))), "core-edges")
    all_edges, edges = edges, edges.join(core_counts.select(F.col("name").alias("a")), "a", "left_semi").join(core_counts.select(F.col("name").alias("b")), "b", "left_semi")
    with_comp = full.filter(F.col("cid").isNotNull()).select("core", "cid").distinct()
    trades = full.select("core", "trade").distinct()
    on = lambda df, side, *cols: df.select(F.col("core").alias(side), *cols)
    shared = edges.join(on(with_comp, "a", "cid"), "a").join(on(with_comp, "b", "cid"), ["b", "cid"]).select("a", "b", "distance").distinct()
    known = on(with_comp, "a", F.lit(True).alias("known")).distinct()
    near = edges.join(on(trades, "a", F.col("trade").alias("ta")), "a").join(on(trades, "b", F.col("trade").alias("tb")), "b")
    near = near.join(known.withColumnRenamed("known", "ka"), "a", "left").join(known.select(F.col("a").alias("b"), F.col("known").alias("kb")), "b", "left")
    same_trade = F.col("ta") == F.col("tb")
    # Long names of one trade are one brand, whoever offers it; without a trade
    # one side must not name a company.
    long = same_trade & (F.col("ta") != "") & (F.length(F.replace("a", F.lit(" "))) >= LONG_NAME)
    open_ = (F.col("ka").isNull() & (same_trade | (F.col("ta") == ""))) | (F.col("kb").isNull() & (same_trade | (F.col("tb") == "")))
    turned = (F.col("distance") == 0) & (same_trade | (F.col("ta") == ""))
    like = near.filter(long | open_ | turned).select("a", "b", "distance")
    allowed = write_cut(shared.unionByName(like).distinct(), "allowed")
    cores = _centers(core_counts, allowed)
    q = full.join(cores.select(F.col("name").alias("core"), F.col("center")), "core")

    # Trades: parts of a longer one, or none, go to the fuller one.
    seen = q.groupBy("center", "trade").agg(F.count(F.lit(1)).alias("n"))
    fuller = (
        seen.filter(F.col("trade") != "").alias("x")
        .join(seen.filter(F.col("trade") != "").alias("y"), "center")
        .filter((F.col("x.trade") != F.col("y.trade")) & (_subset(F.col("x.trade"), F.col("y.trade")) | _subset(F.col("y.trade"), F.col("x.trade"))))
        .filter((F.col("y.n") > F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.length("y.trade") > F.length("x.trade"))))
        .groupBy("center", F.col("x.trade").alias("trade"))
        .agg(F.max_by("y.trade", F.struct("y.n", "y.trade")).alias("better"))
    )
    q = q.join(fuller, ["center", "trade"], "left").withColumn("trade", F.coalesce("better", "trade")).drop("better")
    q = write_cut(q, "cored")
    named = q.filter(F.col("trade") != "")
    by_comp = named.filter(F.col("cid").isNotNull()).groupBy("center", "cid").agg(F.count_distinct("trade").alias("k1"), F.min("trade").alias("t1"))
    alone = named.groupBy("center").agg(F.count_distinct("trade").alias("k2"), F.min("trade").alias("t2"))
    bare = q.filter(F.col("trade") == "").join(by_comp, ["center", "cid"], "left").join(alone, "center", "left")
    no_other = F.col("cid").isNull() | (F.levenshtein("cid", "center") <= NAMED_AFTER)
    settled = F.when(F.col("k1") == 1, F.col("t1")).when(no_other & (F.col("k2") == 1), F.col("t2")).otherwise("")
    done = named.select("key", "cid", "site", "center", "trade", "core").unionByName(
        bare.withColumn("trade", settled).select("key", "cid", "site", "center", "trade", "core")
    )
    done = write_cut(done.withColumn("system", F.concat_ws("|", "center", "trade")), "systems")

    # Rows with a shortened or missing brand, and systems beside a larger one,
    # ask by distinct spellings whose they are.
    size = write_cut(done.groupBy("system").agg(F.count(F.lit(1)).alias("n")), "sizes")
    asking = F.concat_ws("\u0001", "core", "trade", F.coalesce("cid", F.lit("")), "site")  # no system holds the mark
    short = p.filter(F.col("short") | (F.col("core") == "")).select(asking.alias("ask"), "key", "core", "trade", "cid", "site")
    r = F.col("trade").alias("rtrade")
    asks = (
        short.select("ask", F.lit(None).cast("string").alias("own"), "core", r, "cid", "site")
        .unionByName(done.select(F.col("system").alias("ask"), F.col("system").alias("own"), "core", r, "cid", "site"))
        .distinct()
        .join(size.select(F.col("system").alias("own"), F.col("n").alias("own_n")), "own", "left")
    )
    spelt = done.select("cid", "site", "system", F.col("core").alias("center"), "trade")
    by_company = spelt.filter(F.col("cid").isNotNull()).drop("site").distinct().join(size, "system")
    by_site = spelt.filter(F.col("site") != "").drop("cid").distinct().join(size, "system")
    cands = (
        asks.filter(F.col("cid").isNotNull()).drop("site").distinct().join(by_company, "cid").drop("cid").withColumn("via", F.lit(1))
    ).unionByName(asks.filter(F.col("site") != "").drop("cid").distinct().join(by_site, "site").drop("site").withColumn("via", F.lit(2)))
    # A system moves only to a larger one, or to the smaller name of two equals.
    larger = (F.col("n") > F.col("own_n")) | ((F.col("n") == F.col("own_n")) & (F.col("system") < F.col("own")))
    cands = cands.filter(F.col("own").isNull() | larger)

    @F.pandas_udf("boolean")
    def can_stand(core, rtrade, center, trade, named):
        import pandas as pd

        # Of two systems either may be the cut-down one.
        return pd.Series(
            [
                fits(a.split(), b, c.split(), d, a) or (bool(x) and fits(c.split(), d, a.split(), b, c))
                for a, b, c, d, x in zip(core, rtrade, center, trade, named, strict=True)
            ]
        )

    good = cands.filter((F.col("via") == 2) | can_stand("core", "rtrade", "center", "trade", F.col("own").isNotNull()))
    good = write_cut(good.select("ask", "own", "system", "via").distinct(), "good")
    moves = _moves(good.filter(F.col("own").isNotNull()))
    moved = _picked(good.filter(F.col("own").isNull()), moves).select("ask", "to")
    # Shortened brands that no fuller name takes agree among themselves.
    among = _short_systems(short.join(moved, "ask", "left_anti").filter(F.col("core") != ""), all_edges)
    kept = done.join(moves, "system", "left").select("key", F.coalesce("to", "system").alias("system"))
    added = short.join(moved, "ask").select("key", F.col("to").alias("system"))
    return kept.unionByName(added).unionByName(among)


def _short_systems(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """key, system of short brands among themselves: equal or close spellings
    (``edges``: a, b) of one company, or of none; a spelling without a company
    goes to the one company that has it."""
    own = rows.select("key", "core", "trade", F.coalesce("cid", F.lit("")).alias("firm"))
    name = F.concat_ws("|", "core", "trade", "firm")
    counts = write_cut(own.groupBy("core", "trade", "firm", name.alias("name")).agg(F.count(F.lit(1)).alias("n")), "short-names")
    a, b = (counts.select(F.col("core").alias(x), F.col("trade").alias(f"t{x}"), "firm", F.col("name").alias(f"n{x}")) for x in "ab")
    near = edges.join(a, "a").join(b, ["b", "firm"]).filter((F.col("ta") == F.col("tb")) | (F.col("ta") == "") | (F.col("tb") == ""))
    centers = _centers(counts.select("name", "n"), near.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    one = counts.filter("firm <> ''").groupBy("core", "trade").agg(F.count(F.lit(1)).alias("k"), F.min("name").alias("firmed")).filter("k = 1")
    homes = counts.join(one, ["core", "trade"], "left").select("name", F.when(F.col("firm") == "", F.col("firmed")).alias("firmed"))
    to = homes.join(centers, "name").join(centers.select(F.col("name").alias("firmed"), F.col("center").alias("home")), "firmed", "left")
    to = to.select("name", F.coalesce("home", "center").alias("system"))
    return own.select("key", name.alias("name")).join(to, "name").select("key", "system")


def _picked(good: DataFrame, moves: DataFrame) -> DataFrame:
    """ask, to: the one system an asking name can be, else the one its website
    names, after ``moves`` (system, to)."""
    now = good.join(moves, "system", "left").withColumn("system", F.coalesce("to", "system"))
    pick = now.groupBy("ask").agg(
        F.count_distinct("system").alias("k"),
        F.count_distinct(F.when(F.col("via") == 2, F.col("system"))).alias("k_site"),
        F.min("system").alias("one"),
        F.min(F.when(F.col("via") == 2, F.col("system"))).alias("site_one"),
    )
    return pick.select("ask", F.when(F.col("k") == 1, F.col("one")).when(F.col("k_site") == 1, F.col("site_one")).alias("to")).filter(F.col("to").isNotNull())


def _moves(good: DataFrame) -> DataFrame:
    """system, to: where whole systems end.  A system with several homes has
    one once these have moved to the same, so it is asked again until nothing
    changes; every step leads to a larger system, so that ends."""
    moves, before = good.select("system", F.col("system").alias("to")).limit(0), None
    while True:
        moves = write_cut(_picked(good, moves).select(F.col("ask").alias("system"), "to"), "moves")
        now = moves.agg(F.count(F.lit(1)), F.sum(F.xxhash64("system", "to").cast("decimal(38,0)"))).first()
        if now == before:
            return moves
        before = now


def keyed(franchisors: DataFrame, filing_metadata: DataFrame) -> DataFrame:
    """Both tables as key, brand, legal, site; keys are F + id and M + meta_id.
    Rows equal in these columns are one; a key with several texts keeps them."""
    cols = [F.col(a).alias(b) for a, b in (("brand_name", "brand"), ("legal_name", "legal"), ("website", "site"))]
    f = franchisors.select(F.concat(F.lit("F"), F.col("id")).alias("key"), *cols)
    m = filing_metadata.select(F.concat(F.lit("M"), F.col("meta_id")).alias("key"), *cols)
    return f.unionByName(m).filter(F.col("key").isNotNull()).distinct()


def members(franchisors: DataFrame, filing_metadata: DataFrame) -> DataFrame:
    """key, system, n_links: one row per row that names a system, with how many
    other rows name it; the pairs are not formed."""
    s = write_cut(systems(keyed(franchisors, filing_metadata)).distinct(), "links")
    n = s.groupBy("system").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return s.join(n, "system").select("key", "system", "n_links")


def links(franchisors: DataFrame, filing_metadata: DataFrame) -> DataFrame:
    """p5_found: key_a, key_b of rows that name the same system.

    Rows are keyed F + id and M + meta_id; a repeated row counts once.  Rows
    without any name link to nothing.  The result is quadratic in the rows of
    a system because it is defined so; :func:`members` is not.
    """
    s = write_cut(systems(keyed(franchisors, filing_metadata)).distinct(), "links")
    return (
        s.select("system", F.col("key").alias("key_a"))
        .join(s.select("system", F.col("key").alias("key_b")), "system")
        .filter(F.col("key_a") < F.col("key_b"))
        .select("key_a", "key_b")
        .distinct()
    )

"""Sections of paged documents, found by their headings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A page with more other references to items, or not longer than this, is not
#: where a section begins; one with more references is not where it ends.
OTHER_REFERENCES, LEAST_LENGTH, END_REFERENCES = 4, 1500, 5
# The words that head each item of a disclosure document.
TITLES = {
    1: r"THE FRANCHISOR(?:,?\s+AND\s+ANY\s+PARENTS)?", 2: r"BUSINESS[\s,]+EXPERIENCE", 3: "LITIGATION", 4: "BANKRUPTCY",
    5: r"INITIAL[\s,]+FEES?", 6: r"OTHER[\s,]+FEES", 7: r"ESTIMATED[\s,]+INITIAL[\s,]+INVESTMENT", 8: r"RESTRICTIONS[\s,]+ON[\s,]+SOURCES",
    9: r"FRANCHISEE'?S?[\s,]+OBLIGATIONS", 10: "FINANCING", 11: r"FRANCHISOR'?S?[\s,]+ASSISTANCE", 12: "TERRITORY", 13: "TRADEMARKS", 14: "PATENTS",
    15: r"OBLIGATION[\s,]+TO[\s,]+PARTICIPATE", 16: r"RESTRICTIONS[\s,]+ON[\s,]+WHAT", 17: "RENEWAL", 18: r"PUBLIC[\s,]+FIGURES",
    19: r"FINANCIAL[\s,]+PERFORMANCE[\s,]+REPRESENTATIONS?", 20: r"OUTLETS[\s,]+AND[\s,]+FRANCHISEE?S?[\s,]+INFORMATION",
    21: r"FINANCIAL[\s,]+STATEMENTS", 22: "CONTRACTS", 23: "RECEIPTS?",
}
_BETWEEN = r"[\.\-:,?–—\s]*"
REFERENCE = r"(?i)\bITEM\s+\d{1,2}\b"
CONTENTS = r"(?i)\.{5,}|TABLE\s+OF\s+CONTENTS"
NEXT_HEADING = rf"(?i)\bITEM\s+(\d+)\b{_BETWEEN}[A-Z][A-Za-z\s,/'’]{{6,}}"


def heading_pattern(item: int, title: str) -> str:
    """The three forms of an item's heading: with its title anywhere, alone on
    a line, or number and title at the start of one."""
    return rf"(?im)\bITEM\s+{item}\b{_BETWEEN}{title}|^\s*ITEM\s+{item}\b\s*$|^\s*{item}\b{_BETWEEN}{title}"


def pages_of(docs: DataFrame, doc: str, text: str, mark: str = "\f") -> DataFrame:
    """doc, page_num (from 1), text of texts parted by a page mark."""
    return docs.select(doc, F.posexplode(F.split(text, mark)).alias("__i", "text")).select(doc, (F.col("__i") + 1).alias("page_num"), "text")


def headings(pages: DataFrame, doc: str, titles: Mapping[int, str] = TITLES) -> DataFrame:
    """doc, page_num, item, others, contents, long: item headings by page;
    ``others`` counts the references to items beside one."""
    # Only numbers that stand where a heading may begin are looked at more closely.
    numbers = F.concat(F.regexp_extract_all("text", F.lit(r"(?i)\bITEM\s+(\d{1,2})\b"), 1), F.regexp_extract_all("text", F.lit(r"(?m)^\s*(\d{1,2})\b"), 1))
    pages = pages.select(doc, "page_num", "text", F.explode(F.array(F.array_distinct(numbers))).alias("__n"))
    may = lambda i: F.array_contains("__n", str(i))
    found = F.array_compact(F.array(*[F.when(may(i) & F.col("text").rlike(heading_pattern(i, t)), F.lit(i)) for i, t in titles.items()]))
    return pages.filter(F.size("__n") > 0).select(
        doc,
        "page_num",
        F.explode(found).alias("item"),
        F.greatest(F.lit(0), F.regexp_count("text", F.lit(REFERENCE)) - 1).alias("others"),
        F.col("text").rlike(CONTENTS).alias("contents"),
        (F.length("text") > LEAST_LENGTH).alias("long"),
    )


def section_ranges(pages: DataFrame, doc: str, body_start: int = 1, titles: Mapping[int, str] = TITLES) -> DataFrame:
    """doc, item, first_page, last_page of each item.

    The first page that heads the item, is no list of contents, holds few
    other references and is long; else the last page that heads it.  A section
    ends on the first later page that heads a higher item and is no list of
    references, else with the document.
    """
    h = headings(pages.filter(F.col("page_num") >= body_start), doc, titles)
    good = (F.col("others") <= OTHER_REFERENCES) & ~F.col("contents") & F.col("long")
    start = h.groupBy(doc, "item").agg(F.coalesce(F.min(F.when(good, F.col("page_num"))), F.max("page_num")).alias("first_page"))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(NEXT_HEADING), 1), lambda x: x.try_cast("int"))
    ends = pages.filter(F.regexp_count("text", F.lit(REFERENCE)) <= END_REFERENCES).select(doc, "page_num", F.array_max(numbers).alias("__high"))
    ends = ends.filter(F.col("__high").isNotNull()).withColumnRenamed("page_num", "__page")
    last = pages.groupBy(doc).agg(F.max("page_num").alias("__last"))
    later = (F.col("__page") > F.col("first_page")) & (F.col("__high") > F.col("item"))
    return (
        start.join(ends, doc, "left")
        .groupBy(doc, "item", "first_page")
        .agg(F.min(F.when(later, F.col("__page"))).alias("__end"))
        .join(last, doc)
        .select(doc, "item", "first_page", F.coalesce("__end", "__last").alias("last_page"))
    )


def body_start(pages: DataFrame, doc: str, cover: str, company: str, short: int = 2500) -> DataFrame:
    """doc, page: the first short page with a cover phrase and a company word,
    else 1."""
    hit = F.col("text").rlike(cover) & F.col("text").rlike(company) & (F.length("text") < short)
    return pages.groupBy(doc).agg(F.coalesce(F.min(F.when(hit, F.col("page_num"))), F.lit(1)).alias("page"))


# The signs of a cover page and their weights.
COVER_SIGNS = (
    (r"(?i)FRANCHISE\s+DISCLOSURE\s+DOCUMENT", 3),
    (r"(?i)\b(LLC|L\.L\.C\.|Inc\.?|Incorporated|Corporation|Corp\.?|Limited|Ltd\.?|Company|Co\.|LP|L\.P\.|LLP)\b", 2),
    (r"\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}", 1),
    (r"(?i)\bwww\.[A-Za-z0-9.-]+\.\w+\b", 1),
    (r"\b\d{5}(?:-\d{4})?\b", 1),
    (r"(?i)TABLE\s+OF\s+CONTENTS|How\s+to\s+Use\s+This", -2),
)
COVER_DATE = r"(?i)(Issuance|Effective)\s+Date\s*:?"


def cover_page(pages: DataFrame, doc: str, signs: Sequence[tuple[str, int]] = COVER_SIGNS, date: str = COVER_DATE, least: int = 4, scan: int = 25) -> DataFrame:
    """doc, page, score: the page (of the first ``scan``) with the best score
    of signs (pattern, weight), the earliest of equals; 1 under ``least``.  A
    date on the page or, of the pages looked at, on the next one counts one."""
    score = F.lit(0)
    for p, w in signs:
        score = score + F.when(F.col("text").rlike(p), w).otherwise(0)
    own = pages.filter(F.col("page_num") <= scan).select(doc, "page_num", score.alias("s"), F.col("text").rlike(date).alias("d"))
    w = W.partitionBy(doc).orderBy("page_num")
    dated = F.coalesce(F.col("d"), F.lit(False)) | F.coalesce(F.lead("d").over(w), F.lit(False))
    both = own.withColumn("s", F.col("s") + F.when(dated, 1).otherwise(0))
    best = both.groupBy(doc).agg(F.max_by(F.struct("page_num", "s"), F.struct("s", -F.col("page_num"))).alias("b"))
    return best.select(doc, F.when(F.col("b.s") >= least, F.col("b.page_num")).otherwise(1).alias("page"), F.col("b.s").alias("score"))


def section_text(pages: DataFrame, ranges: DataFrame, doc: str, most: int = 60_000) -> DataFrame:
    """doc, item, text: the pages of each section with page marks, cut to a
    budget of characters."""
    marked = F.concat(F.lit("\n--- page "), F.col("page_num"), F.lit(" ---\n"), F.col("text"))
    j = pages.join(ranges, doc).filter(F.col("page_num").between(F.col("first_page"), F.col("last_page")))
    parts = F.array_sort(F.collect_list(F.struct("page_num", marked.alias("t"))))
    return j.groupBy(doc, "item").agg(F.substring(F.array_join(F.transform(parts, lambda x: x["t"]), ""), 1, most).alias("text"))

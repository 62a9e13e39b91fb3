"""Column helpers: fallbacks that treat zero and blank as absent, rounding,
ordered rules, formats."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column, kind: str = "number") -> Column:
    """The value, or null where it is zero (numbers) or empty (text)."""
    return F.nullif(c, F.lit(0) if kind == "number" else F.lit(""))


def truthy_coalesce(*cs: Column, kind: str = "number") -> Column:
    """The first value that is neither null nor zero or empty."""
    return F.coalesce(*[truthy(c, kind) for c in cs])


def half_even(c: Column, digits: int = 0) -> Column:
    """Banker's rounding of the decimal text of a double."""
    return F.bround(c, digits)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.try_divide(a, b)


def ordered_when(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = F
    for test, value in rules:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def bands(c: Column, edges: Sequence[float], labels: Sequence[str], closed: str = "right") -> Column:
    """Label of the band a value lies in: ``edges`` are upper bounds, the last
    label has none.  Null stays null.  ``closed`` right counts the bound in."""
    rules = [((c <= e) if closed == "right" else (c < e), n) for e, n in zip(edges, labels, strict=False)]
    return F.when(c.isNotNull(), ordered_when(rules, labels[-1]))


def lookup(c: Column, values: Mapping[str, object], default: object = None) -> Column:
    """A value from a small fixed table."""
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


# ------------------------------------------------------------------ numbers

# Steps of rounded figures by size.
NICE_STEPS = ((100_000, 5_000), (500_000, 10_000), (2_000_000, 25_000), (10_000_000, 100_000))
NICE_LAST = 500_000


def nice_round(c: Column) -> Column:
    """A figure rounded to the step of its size, half to even, without sign."""
    a = F.abs(c)
    step = ordered_when([(a < top, s) for top, s in NICE_STEPS], NICE_LAST)
    return (F.bround(a / step) * step).cast("bigint")


# How many periods make a year.
PER_YEAR = {"weekly": 52, "monthly": 12, "daily": 365, "annual": 1}
# Words that tell a period where no unit is given, in order.
PERIOD_WORDS = (
    (52, ("weekly", "per week", "awus", "aws ")),
    (12, ("monthly", "per month")),
    (365, ("daily", "revpar", "adr", "per day", "per night")),
)


def annual_multiplier(unit: Column, words: Column) -> Column:
    """Periods in a year by the unit, else by the words, else one."""
    w = F.lower(F.coalesce(words, F.lit("")))
    said = ordered_when([(_any([w.contains(t) for t in words_]), n) for n, words_ in PERIOD_WORDS], 1)
    return F.coalesce(lookup(F.lower(F.trim(unit)), PER_YEAR), said).cast("int")


def _any(cs: Sequence[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def money_short(c: Column) -> Column:
    """$950, $12K, $1.2M."""
    a = F.abs(c)
    return (
        F.when(a >= 1e6, F.concat(F.lit("$"), F.format_string("%.1f", c / 1e6), F.lit("M")))
        .when(a >= 1e3, F.concat(F.lit("$"), F.format_string("%.0f", F.round(c / 1e3)), F.lit("K")))
        .when(c.isNotNull(), F.concat(F.lit("$"), F.format_string("%.0f", F.round(c))))
    )


def money_full(c: Column) -> Column:
    """$1,234,567."""
    return F.when(c.isNotNull(), F.concat(F.lit("$"), F.format_number(F.round(c), 0)))


def trim_number(c: Column, digits: int = 2) -> Column:
    """A number without trailing zeros: 6.50 is 6.5, 6.00 is 6."""
    t = F.format_string(f"%.{digits}f", c)
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def age_bucket(year: Column, as_of: int) -> Column:
    """current, 1, 2, 3, older or unknown (null and zero years)."""
    age = F.lit(as_of) - year
    return ordered_when(
        [(year.isNull() | (year == 0), "unknown"), (age <= 0, "current"), (age == 1, "1"), (age == 2, "2"), (age == 3, "3")], "older"
    )


def token_cost(reported: Column, parts: Mapping[str, tuple[Column, float]]) -> Column:
    """The reported cost, else the sum of tokens times their rate a million."""
    made = None
    for c, rate in parts.values():
        x = F.coalesce(c, F.lit(0)) * F.lit(rate / 1e6)
        made = x if made is None else made + x
    return F.coalesce(reported, made)


# --------------------------------------------------------------------- text


def compact_key(c: Column) -> Column:
    """Lower case letters and digits only; accents are dropped, not folded."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def slug(c: Column, most: int = 80, default: str = "unknown") -> Column:
    """Words joined by hyphens, ``most`` characters, a default for nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(truthy(F.substring(s, 1, most), "text"), F.lit(default))


@cache
def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the plain letters that their
    compatibility decomposition leaves."""
    pairs = []
    for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(n)) if not unicodedata.combining(x))
        if chr(n).islower() and len(plain) == 1 and plain.isascii():
            pairs.append((chr(n), plain.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded_slug(c: Column, drop: str) -> Column:
    """A slug of a name with accents folded and the words of ``drop`` (an
    alternation) taken from its end."""
    ascii_ = F.translate(F.lower(c), *_folding())
    bare = F.regexp_replace(ascii_, rf"[\s,.]*\b(?:{drop})\b\.?[\s,.]*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def title_label(c: Column, prefix: str = "", acronyms: Mapping[str, str] | None = None, default: str = "Other") -> Column:
    """A heading made of a slug: prefix off, hyphens to spaces, title case,
    acronyms restored."""
    t = F.initcap(F.replace(F.regexp_replace(c, f"^{prefix}", ""), F.lit("-"), F.lit(" ")))
    for a, b in (acronyms or {}).items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.coalesce(t, F.lit(default))


def year_in_text(c: Column) -> Column:
    """The first year 2000-2099 that stands alone in a text."""
    return F.regexp_extract(c, r"\b(20\d{2})\b", 1).try_cast("int")


def strip_html(c: Column) -> Column:
    """Tags to spaces, the common entities resolved, white space collapsed."""
    t = F.regexp_replace(c, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_fence(c: Column) -> Column:
    """A JSON text without code fence and without words before its first
    bracket."""
    t = F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")
    at = F.regexp_instr(t, F.lit(r"[\[{]"))
    return F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t)


def loose(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def loosely_contains(text: Column, needle: Column, long: int = 40, short: int = 25) -> Column:
    """Whether the beginning of a needle (40, else 25 characters) stands in a
    text, case and white space aside; null and empty needles do not."""
    t, n = loose(text), loose(needle)
    return F.coalesce((F.length(n) > 0) & (t.contains(F.substring(n, 1, long)) | t.contains(F.substring(n, 1, short))), F.lit(False))


def reading_minutes(words: Column, per_minute: int = 220) -> Column:
    return F.greatest(F.lit(1), F.bround(words / per_minute).cast("int"))


def word_count(c: Column) -> Column:
    """Words parted by white space; null and blank have none."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, " ")))


def fingerprint(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(c), 1, length)


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` characters, an ellipsis where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def csv_field(c: Column) -> Column:
    """A field quoted as RFC 4180 asks."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def rule_classify(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first pattern that is found, in order; null if none."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for p, label in rules])


def any_date(c: Column) -> Column:
    """A date from month names, M/D/Y (two-digit years are 20yy) or ISO."""
    t = F.trim(c)
    two = F.regexp_replace(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})$", "$1/$2/20$3")
    forms = [F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(F.replace(two, F.lit("-"), F.lit("/")), "M/d/yyyy")]
    forms += [F.try_to_date(t, p) for p in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")]
    return F.coalesce(*forms)


def deep_link(url: Column, page: Column, viewer: str = "viewer") -> Column:
    """A link to a page: &page= for viewers with a query, #page= else."""
    return (
        F.when(url.isNull() | page.isNull(), url)
        .when(url.contains(viewer) & url.contains("?"), F.concat(url, F.lit("&page="), page.cast("string")))
        .otherwise(F.concat(url, F.lit("#page="), page.cast("string")))
    )


def scan_quality(text: Column) -> Column:
    """Whether a page's text looks scanned: short, few letters or unprintable."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7E\n\r\t]", ""))
    return F.coalesce((n < 200) | (letters < 0.5 * n) | (printable < 0.85 * n), F.lit(True))


# The states and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}


def state_code(c: Column) -> Column:
    """The two-letter code of a state given by code or full name, case and
    outer blanks aside; null for anything else."""
    t = F.lower(F.trim(c))
    return lookup(t, STATES | {v.lower(): v for v in STATES.values()})


# Words in a label that make a value a percentage.
PERCENT_WORDS = ("margin", "rate", "%", "percent", "conversion")


def metric_text(value: Column, label: Column) -> Column:
    """A value as its label asks: percent with one place, small amounts a
    person and amounts under 1000 with cents, else whole dollars; a dash for
    none.  Halves of a percentage's place go up."""
    t = F.lower(F.coalesce(label, F.lit("")))
    percent = _any([t.contains(w) for w in PERCENT_WORDS])
    cents = F.concat(F.lit("$"), F.format_number(value, 2))
    return (
        F.when(value.isNull(), "—")
        .when(percent, F.concat(F.format_string("%.1f", value), F.lit("%")))
        .when(t.contains("per person") & (F.abs(value) < 100), cents)
        .when(F.abs(value) >= 1000, F.concat(F.lit("$"), F.format_number(value, 0)))
        .otherwise(cents)
    )


def html_escaped(c: Column) -> Column:
    """Text safe between tags and in quoted attributes; null is empty."""
    t = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def path_label(path: Column, rules: Sequence[tuple[str, str, str]], default: str = "UNKNOWN") -> Column:
    """The label of the first rule that fits a path: (folder, name, label) asks
    for a folder of that name or for a file name that contains one."""
    parts = F.split(F.lower(path), r"[/\\\\]")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    tests = [(F.array_contains(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), n) if kind == "folder" else stem.contains(n), v) for kind, n, v in rules]
    return ordered_when(tests, default)

"""Readers of nested documents, lists, manifests, pages and file inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloom.functions.cols import strip_html

SENTINELS = ("_section_not_found", "_parse_error", "_read_error")


def json_documents(spark: SparkSession, path: str, schema: T.StructType, stem: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """One row per JSON file below ``path``: its stem (folder name), a status
    (ok, parse_error or a sentinel) and the fields of ``schema``.

    Files are read whole and leniently; one that is cut off has status
    parse_error and null fields.
    """
    full = T.StructType([*schema.fields, *[T.StructField(s, T.StringType()) for s in SENTINELS if s not in schema.names], T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    status = F.when(F.col("_corrupt_record").isNotNull(), "parse_error")
    for s in SENTINELS:
        status = status.when(F.col(s).isNotNull(), s.lstrip("_"))
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), stem, 1).alias("stem"), status.otherwise("ok").alias("status"), *schema.names)


def expected_status(found: DataFrame, expected: DataFrame, on: str = "stem") -> DataFrame:
    """Expected documents with the status of what was found, else missing."""
    return expected.join(found.select(on, "status"), on, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def as_list(c: Column, kind: T.StructType) -> Column:
    """A JSON text holding one object or a list of them, as a list."""
    many = F.from_json(c, T.ArrayType(kind))
    return F.when(F.ltrim(c).startswith("["), many).otherwise(F.array(F.from_json(c, kind)))


def manifest(df: DataFrame, text: str, entry: str, root: str = "extractions") -> DataFrame:
    """stem and the fields of each entry of manifests {root: {stem: entry}};
    ``entry`` is the DDL of an entry."""
    m = F.from_json(F.col(text), f"struct<{root}: map<string, struct<{entry}>>>")
    return df.select(F.explode(m[root]).alias("stem", "__e")).select("stem", "__e.*")


def name_list(df: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """Trimmed names; of those that differ in case only the first by ``order``,
    without it the first in text order."""
    t = df.select(F.trim(column).alias("name"), (F.col(order) if order else F.lit(0)).alias("__i")).filter(F.length("name") > 0)
    return t.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("__i", "name"))["name"].alias("name")).select("name")


def html_tables(df: DataFrame, key: str, html: str, least_cells: int = 2) -> DataFrame:
    """key, row_no, cells, link of the rows of each page's first table with at
    least ``least_cells`` cells; pages without a table have none."""
    table = F.regexp_extract(F.col(html), r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    out = df.select(key, F.posexplode(rows).alias("row_no", "__r"))
    cells = F.transform(F.regexp_extract_all("__r", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), strip_html)
    return out.select(key, "row_no", cells.alias("cells"), F.nullif(F.regexp_extract("__r", r"href=[\"']([^\"']+)", 1), F.lit("")).alias("link")).filter(
        F.size("cells") >= least_cells
    )


def sitemap_urls(df: DataFrame, xml: str) -> DataFrame:
    """All addresses of sitemaps, each once."""
    return df.select(F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url")).distinct()


def portal_lines(df: DataFrame, key: str, text: str, id_pattern: str = r"^\d{6}$") -> DataFrame:
    """key, id, fields of result rows in plain text: fields are parted by two
    blanks or a tab, the first must look like a number of the portal."""
    lines = df.select(key, F.explode(F.split(text, r"\r?\n")).alias("line"))
    fields = F.transform(F.split(F.trim("line"), r"\s{2,}|\t"), F.trim)
    return lines.select(key, fields.alias("fields")).filter(F.get("fields", F.lit(0)).rlike(id_pattern)).select(key, F.get("fields", F.lit(0)).alias("id"), "fields")


def with_links(rows: DataFrame, links: DataFrame, href: str = "href", pattern: str = r"id=(\d+)") -> DataFrame:
    """Result rows with the link whose address holds their number."""
    l = links.select(F.regexp_extract(href, pattern, 1).alias("id"), F.col(href).alias("link")).filter(F.col("id") != "").groupBy("id").agg(F.min("link").alias("link"))
    return rows.join(l, "id", "left")


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """folder, n_files, megabytes of files below a path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    return f.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"), F.round(F.sum("length") / 1e6, 3).alias("megabytes")
    )


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """page, text of text or HTML files read whole."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page"), F.col("value").alias("text"))


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that every executor can reach, read in ranges
    of its row numbers; ``schema`` names the columns wanted, as DDL."""
    import sqlite3
    from contextlib import closing

    quoted = '"' + name.replace('"', '""') + '"'
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        low, high = con.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {quoted}").fetchone()
    kind = T.StructType.fromDDL(schema)
    columns = ", ".join('"' + c.replace('"', '""') + '"' for c in kind.names)
    step = max(1, -(-(high - low + 1) // parts))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at in pdf["id"]:
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
                    cur = con.execute(f"SELECT {columns} FROM {quoted} WHERE rowid >= ? AND rowid < ?", (int(at), int(at) + step))
                    while rows := cur.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=kind.names)

    return spark.range(low, high + 1, step, parts).mapInPandas(run, kind)


def pdf_pages(df: DataFrame, key: str, content: str, most: int | None = None) -> DataFrame:
    """key, page_num (from 1), text of PDF files given as bytes, of the first
    ``most`` pages if it is set.  Needs the optional library pypdf."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the library pypdf on the driver and the executors") from e
    src = df.select(key, content)
    schema = T.StructType([src.schema[key], T.StructField("page_num", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for pdf in batches:
            for k, data in zip(pdf[key], pdf[content], strict=True):
                if data:
                    texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(bytes(data))).pages[:most]]
                    yield pd.DataFrame({key: [k] * len(texts), "page_num": range(1, len(texts) + 1), "text": texts})

    return src.mapInPandas(run, schema)


def searches(found: Sequence[DataFrame], key: str) -> DataFrame:
    """Results of several searches, each key once: from the first search that
    found it, there the first in the order of its columns."""
    whole = None
    for i, df in enumerate(found):
        one = df.withColumn("__search", F.lit(i))
        whole = one if whole is None else whole.unionByName(one)
    rest = [c for c in whole.columns if c not in (key, "__search")]
    first = whole.groupBy(key).agg(F.min(F.struct("__search", *rest)).alias("x"))
    return first.select(key, *[F.col("x")[c].alias(c) for c in rest]).select(*found[0].columns)


def cut_searches(df: DataFrame, search: Sequence[str], cap: int = 500) -> DataFrame:
    """Searches that came back with as many rows as a page holds, so that more
    may be behind: they must be asked again in parts."""
    return df.groupBy(*search).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cap)

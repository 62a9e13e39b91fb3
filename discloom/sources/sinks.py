"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from discloom.session import write_cut


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with header and doubled quotes."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """JSON lines, in folders by some columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Rows numbered from 1 in an order.

    Numbers come from counts per range partition, so the rows are sorted in
    parallel and none of them pass through one task.
    """
    r = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    r = r.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("bigint"), 33))
    r = write_cut(r, "numbered")
    sizes = r.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return r.join(F.broadcast(before), "__p").withColumn(name, (F.col("__b") + F.col("__i") + 1).cast("bigint")).drop("__p", "__i", "__b")


def item_list(df: DataFrame, url: str, title: str, order: Sequence[str]) -> DataFrame:
    """One JSON list item per row: position, url, name."""
    n = numbered(df, order)
    return n.select("position", F.to_json(F.struct(F.lit("ListItem").alias("@type"), "position", F.col(url).alias("url"), F.col(title).alias("name"))).alias("item"))


def sitemap_lines(df: DataFrame, url: str) -> DataFrame:
    return df.select(F.concat(F.lit("<url><loc>"), F.replace(F.col(url), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")).alias("line"))


def batches(df: DataFrame, order: Sequence[str], size: int = 10_000) -> DataFrame:
    """Rows with the number of their batch of ``size`` rows."""
    return numbered(df, order, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")


def not_sent(df: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Rows that the last submission did not hold."""
    return df.join(sent.select(key).distinct(), key, "left_anti")


def with_missing_columns(df: DataFrame, ddl: dict[str, str]) -> DataFrame:
    """Columns that are not there yet, as nulls of their type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in ddl.items() if c not in df.columns})


def create_if_absent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path with at least the columns of ``schema`` (DDL): an
    empty one is written where there is none, missing columns are null."""
    wanted = T.StructType.fromDDL(schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], wanted).write.parquet(path)
    have = spark.read.parquet(path)
    return with_missing_columns(have, {f.name: f.dataType.simpleString() for f in wanted.fields})


def manifest_lines(done: DataFrame, key: str) -> DataFrame:
    """key and its entry as one JSON text, to be appended after every batch."""
    return done.select(key, F.to_json(F.struct(*[c for c in done.columns if c != key])).alias("entry"))


def to_resume(todo: DataFrame, manifest: DataFrame, key: str, ok: str = "$.ok") -> DataFrame:
    """What is still to do: keys whose entries, if any, never were ok."""
    done = manifest.filter(F.get_json_object("entry", ok) == "true").select(key).distinct()
    return todo.join(done, key, "left_anti")


def copied_from(df: DataFrame, same: DataFrame, id_: str, columns: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier one (``same``: id, same_as, by) with the
    chosen columns of that one, and ``source_id`` and ``method`` to mark them."""
    source = df.select(F.col(id_).alias("same_as"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = df.join(same.select(F.col("id").alias(id_), "same_as", "by"), id_).join(source, "same_as")
    kept = [F.col(f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return j.select(*kept, F.col("same_as").alias("source_id"), F.col("by").alias("method"))

"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "discloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a local session (tests on one machine) uses a
    folder of this machine; any other raises, as executors could not read it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"discloom-{os.getuid()}")
    return at.rstrip("/")


#: Tables written by each application, for :func:`drop_cuts`.
_CUTS: dict[str, list[str]] = {}


#: The folder of a table that was written in rounds or may be dropped early.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables this application has cut lineage with, and say how
    many; to be called when the results built on them have been consumed."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def write_cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start
    from files that outlive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run within are removed as it ends; for results
    that are written or collected, each by a query of its own."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def write_rounds(spark: SparkSession, part: Callable[[int], DataFrame], rounds: int, label: str, by: str | None = None) -> DataFrame:
    """Write the frames ``part(0)``, ``part(1)`` ... one after the other and
    read them as one, in folders by the number (column ``part``) or by the
    column ``by`` of the frames.

    A round's shuffle files are gone before the next one starts, so the disk
    they take at once falls with the number of rounds.  See :func:`drop_cut`.
    """
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    with shuffles_freed(spark):
        for i in range(rounds):
            df = part(i)
            to = df.write.option("compression", "zstd")
            if by:
                to.partitionBy(by).mode("append").parquet(path)
            else:
                to.parquet(f"{path}/part={i}")
    # An empty frame has no folders by column: the schema is given.
    out = (spark.read.schema(df.schema) if by else spark.read).parquet(path)
    _FOLDERS[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_part(cut: DataFrame, folder: str) -> None:
    """Delete a folder (``column=value``) of a table of :func:`write_rounds`."""
    _delete(cut.sparkSession, f"{_FOLDERS[cut]}/{folder}")


def drop_cut(*cuts: DataFrame) -> None:
    """Delete tables of :func:`write_rounds` that nothing reads any more."""
    for df in cuts:
        path, spark = _FOLDERS.pop(df), df.sparkSession
        _CUTS[spark.sparkContext.applicationId].remove(path)
        _delete(spark, path)

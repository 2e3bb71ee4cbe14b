"""What the operators of this subpackage share: input tables and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scans import spread

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, as a class to split at.
GAPS = r"[\x20\x09-\x0D]+"
#: A broadcast side may have this many rows at most; beyond it a shuffled join is planned.
BROADCAST_ROWS = 100_000
#: Rows that may share a join's key; keys of more are dealt with on their own.
HOT_ROWS = 1 << 13
#: Rows of an Arrow batch: texts may be long, and Python holds a batch several times over.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SETTING = threading.RLock()
#: Rows of a bitmap, of 4 KiB each, and files that it is written to.
BITMAP_ROWS, BITMAP_FILES = 2048, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; a file of fewer splits than cores is dealt out over all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexsift-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage of ``df`` by a Parquet table in the shared folder; the file system removes it at the session's end, or ``dropped`` before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexsift-{label}-{uuid.uuid4().hex}"
    schema, rows = df.schema, spark.conf.get(_ARROW)
    with _SETTING:  # a session's setting: writes of other threads wait for it to be put back
        spark.conf.set(_ARROW, min(int(rows), ARROW_ROWS) if int(rows) > 0 else ARROW_ROWS)
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_ARROW, rows)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    found = spark.read.schema(schema).parquet(path)
    found._written_at = path
    return found


def dropped(df: DataFrame | None) -> None:
    """Removes a table that ``written`` made and nothing reads any more."""
    if df is not None and (path := getattr(df, "_written_at", None)):
        place, system = _place(df.sparkSession, path)
        system.delete(place, True)


def prefix(*tables: DataFrame) -> str:
    """What no column of the tables begins with: columns of our own that begin with it meet none of the caller's."""
    found = "_"
    while any(c.lower().startswith(found) for t in tables for c in t.columns):
        found += "_"
    return found


def flagged(rows: DataFrame, by: Column, keys: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds ``name``: false for rows whose long ``by`` isn't among the longs ``key`` of ``keys``; true for all others and a few besides.

    The keys make a bitmap of BITMAP_ROWS * 32,768 bits (8 MiB, however many keys there
    are), which is broadcast: rows stay where they are, and only those that are marked
    need to move to be told exactly.  A null key is never marked.
    """
    p = prefix(rows)
    at, row, bits = f"{p}at", f"{p}row", f"{p}bits"
    place = lambda c: F.pmod(c, F.lit(BITMAP_ROWS << 15))
    maps = keys.select(place(key).alias(at)).where(F.col(at).isNotNull()).groupBy((F.col(at) % BITMAP_ROWS).alias(row)).agg(F.bitmap_construct_agg(F.expr(f"{at} div {BITMAP_ROWS}")).alias(bits))
    maps = written(maps.coalesce(BITMAP_FILES), "bitmap")
    joined = rows.withColumn(at, place(by)).join(F.broadcast(maps), F.col(at) % BITMAP_ROWS == F.col(row), "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({at} div {BITMAP_ROWS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr(f"cast({at} div {BITMAP_ROWS} % 8 as int)")
    return joined.withColumn(name, F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))).drop(at, row, bits)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` (a written table: counting is cheap) has at most ``limit`` rows, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def looked_up(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, one row for each key; ``n`` says how many of ``rows`` share it.

    Keys that very many rows share are few and join by broadcast, so they fill no task; all others join by shuffle.
    """
    hot = small(lookup.where(F.col(n) > HOT_ROWS))
    others = rows.join(hot.select(*keys), keys, "left_anti").join(lookup.where(F.col(n) <= HOT_ROWS), keys)
    return rows.join(hot, keys).unionByName(others)


def md5_long(col: Column) -> Column:
    """The first 60 bits of a string's MD5 as a non-negative long (the same number in any SQL engine)."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("long")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))

"""Tables written between jobs.

Lineage is cut by writing Parquet to the folder that the cluster names in
``spark.checkpoint.dir``; every executor sees it, so a lost executor only costs
the tasks it was running.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which ``sized`` lets a table be broadcast; keys of two or three
#: longs, so some tens of MB at most on each executor.
BROADCAST_ROWS = 1_000_000

_fallback: list[str] = []
#: Tables that this process has written, with their sessions.
_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor sees")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="deckframe-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return "file://" + _fallback[0]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as read again."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete the tables that this process has written; results that read them can't be read after it. Runs at the end of the process."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM has gone, or the folder
            return


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` if it has at most ``max_rows`` rows.

    ``df`` should be a stored table: it is counted first. Larger tables come back
    unchanged and are joined by shuffle.
    """
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


#: Rows of a sorted range, at most about.
RANGE_ROWS = 1 << 20


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, tag: str) -> DataFrame:
    """``df`` with upto: the sum of ``value`` up to and with each row in the order, among the rows alike in ``by``; written.

    Rows go to sorted ranges of bounded size. The sums of the ranges, as many as
    there are tasks, are added up first; then each range is added up for itself.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(tasks, df.count() // RANGE_ROWS + 1)
    dealt = stored(df.repartitionByRange(ranges, *by, *order).withColumn("range", F.spark_partition_id()), tag)
    sums = dealt.groupBy(*by, "range").agg(F.sum(value).alias("words"))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select(*by, "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier")), f"{tag}-sums")
    within = Window.partitionBy(*by, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("upto", F.sum(value).over(within)).join(sized(sums), [*by, "range"])
    return stored(summed.withColumn("upto", F.col("upto") + F.col("earlier")).drop("range", "earlier"), f"{tag}-upto")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

"""Borders between parts of a plan."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMALL = 300_000  # rows of a lookup that every executor may hold


def staged(df: DataFrame) -> DataFrame:
    """``df``, computed once, when it is first needed, and kept on the executors' disks.

    Long rules stay on one side of the border: the optimizer does not copy them into joins and filters, where they would be
    planned and evaluated again and again.  A lost block is computed anew from its lineage.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed now and cut from its lineage in the shared folder of ``spark.checkpoint.dir``; ``staged`` without one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else staged(df)


def small(df: DataFrame) -> DataFrame:
    """``df``, which is staged or saved, as a lookup without a shuffle if it is short enough; else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names; where it is unset, a temporary one, for local masters only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="matforge-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to all cores, or to as many partitions as shuffles have where those are more.

    For narrow rows that cost much time each: by their bytes alone they would be read, or joined after a shuffle, as one task.
    """
    session = df.sparkSession
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def spread_by_range(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order``, each sorted, with ``p``: the number of a row's range.  Keep it before it is used twice:
    ranges are drawn from samples."""
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())


def counted_before(df: DataFrame, keys: list[str], order: str, flag: str, name: str) -> DataFrame:
    """``df`` with ``name``: in how many rows before it, of its ``keys`` and in their ``order``, ``flag`` is true.

    Rows are counted range by range: what came in earlier ranges is known from their sums, so one long sequence of rows is
    spread over all tasks.
    """
    rows = saved(spread_by_range(df, *keys, order))
    one = lambda: F.col(flag).cast("long")
    sums = rows.groupBy("p", *keys).agg(F.sum(one()).alias("n"))  # one row for each range and key that meet
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.withColumn("_start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], F.col("r.p") == F.col("s.p"))
    within = Window.partitionBy("p", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("_run", F.coalesce(F.sum(one()).over(within), F.lit(0)))
    joined = running.alias("r").join(start.alias("s"), same)
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("r._run") + F.col("s._start")).alias(name))


def numbered(rows: DataFrame, start: int, order: str = "ord") -> DataFrame:
    """``rows`` with ``number``, from ``start`` on in the order of ``order``: ranges are sorted apart and offset by the sizes of
    the ranges before, so no task holds all rows."""
    # kept before it is counted: ranges are drawn from samples, which differ from one run of the plan to the next
    parts = saved(rows.repartitionByRange(max(1, rows.sparkSession.sparkContext.defaultParallelism), order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    sizes, total = {}, start
    for r in sorted(parts.groupBy("_p").count().collect()):
        sizes[r["_p"]], total = total, total + r["count"]
    offset = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map(F.lit(-1), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.withColumn("number", (F.element_at(offset, F.col("_p")) + within - 1).cast("long")).drop("_p")

"""Helpers shared by the training-data operators.

Python code runs in ``mapInArrow``: Arrow batches in, Arrow batches out, one pass, no unbounded state.  Tables that must
survive a lost executor are written to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"

_made: list[tuple[weakref.ref, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="matforge-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(__import__("shutil").rmtree, path, True)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((weakref.ref(spark), path))
    return path


def _clean() -> None:
    for ref, path in _made:
        spark = ref()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing is left to ask
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    path = getattr(table, "_written_at", None)
    if path:
        p = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
        _made[:] = [m for m in _made if m[1] != path]


def join_known(rows: DataFrame, known: DataFrame, keys: list[str], weight: str = "k", share: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``known``, which has one row for each key, and ``weight``: how many rows of ``rows`` bear it.

    Keys that a ``share``-th of all weight or more falls on would make hot tasks.  There are at most ``share`` of them, so
    these, and only these, are broadcast; the others meet in a shuffle.  Rows with a null in a key find nothing.
    """
    total = known.agg(F.sum(weight)).first()[0] or 0
    hot = known.filter(F.col(weight) * share >= total) if total else known.limit(0)
    names = [c for c in known.columns if c not in (*keys, weight)]
    near = rows.join(F.broadcast(hot.select(*keys, *(F.col(c).alias(f"_hot_{c}") for c in names), F.lit(True).alias("_hot"))), keys, "left")
    rest = known.filter(F.col(weight) * share < total).drop(weight)
    # rows that are served already go on without the shuffle
    cold = near.filter("_hot is null").drop("_hot", *(f"_hot_{c}" for c in names)).join(rest, keys, "left")
    served = near.filter("_hot").drop("_hot")
    served = served.withColumnsRenamed({f"_hot_{c}": c for c in names})
    return cold.unionByName(served)


def held_out(doc_id: str, folds: int):
    """True where crc32 of the id's decimal text leaves remainder 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def with_columns(df: DataFrame, added: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 512) -> DataFrame:
    """``df`` with columns that Python computes, ``rows`` rows at a time.

    ``added`` is their DDL; ``make()`` runs once in each task and gives a function from a batch to arrays by name.
    Columns of ``df`` that bear one of these names are replaced.
    """
    new = StructType.fromDDL(added)
    names = [f.name for f in new]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    schema = StructType([df.schema[c] for c in kept] + list(new))
    wanted = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for big in batches:
            for at in range(0, big.num_rows, rows):
                b = big.slice(at, rows)
                got = work(b)
                cols = [b.column(b.schema.get_field_index(c)) for c in kept]
                cols += [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, type=wanted.field(f.name).type) for f in new]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, wanted)], schema=wanted)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def single_threaded() -> None:
    """Spark gives a task one core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def many_objects() -> None:
    """For tasks that keep large dictionaries without cycles: the cycle collector would walk them again and again.

    What earlier tasks left in the worker goes first.
    """
    gc.collect()
    gc.set_threshold(500_000, 50, 1000)

"""Several tables that change together: versions in one folder, one of them current.

A version is a folder with all its tables.  Which one is current stands in a small pointer file, replaced by one atomic rename
after everything else is there.  A writer that fails leaves the pointer, and so every reader, as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


class Conflict(RuntimeError):
    """Another writer has made a version current since the tables were loaded."""


def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    return jvm, fs, fs.makeQualified(folder)


def pointed(spark: SparkSession, path: str) -> str | None:
    """The name of the current version, if there is one."""
    jvm, fs, folder = _files(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, path: str, schemas: dict[str, str]) -> tuple[str, dict[str, DataFrame]]:
    """The current version and its tables, by name."""
    name = pointed(spark, path)
    if name is None:
        raise FileNotFoundError(path)
    return name, {t: spark.read.schema(ddl).parquet(f"{path}/{name}/{t}") for t, ddl in schemas.items()}


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], base: str | None = None) -> str:
    """Writes ``tables`` as a new version and makes it current; raises ``Conflict`` if ``base`` is given and is so no longer."""
    _unchanged(spark, path, base)
    n = int(base.split("-")[0][1:]) + 1 if base else 1 + max([int(v.split("-")[0][1:]) for v in listed(spark, path)], default=0)
    name = f"v{n:08d}-{uuid.uuid4().hex}"
    for t, df in tables.items():
        df.write.parquet(f"{path}/{name}/{t}")
    _unchanged(spark, path, base)
    _point(spark, path, name)
    return name


def _unchanged(spark: SparkSession, path: str, base: str | None) -> None:
    if base is not None and pointed(spark, path) != base:
        raise Conflict(f"{path}: {base} is not current any more")


def _point(spark: SparkSession, path: str, name: str) -> None:
    jvm, fs, folder = _files(spark, path)
    ready = jvm.org.apache.hadoop.fs.Path(folder, f"{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(ready)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(ready, jvm.org.apache.hadoop.fs.Path(folder, POINTER), over)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of all versions, those that never became current among them, oldest first."""
    jvm, fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
    return sorted(n for n in names if n[:1] == "v" and n[1:9].isdigit())


def sweep(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes all but the newest ``keep`` versions and the current one; gives the names of those that went."""
    jvm, fs, folder = _files(spark, path)
    names, now = listed(spark, path), pointed(spark, path)
    old = [n for n in names[: max(0, len(names) - keep)] if n != now]
    for n in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, n), True)
    return old

"""Large CSV files, read by many tasks.

A line break may lie inside quotes, so where a record begins is known only from all lines before.  But a range of lines can
be summarised without them: whether a quote is open behind it, if none was open before it, and if one was.  These summaries, two
truth values for a range, are followed in order; then each range knows how it begins and is parsed apart.  A record that goes
on in the next range leaves its parts, which meet in a shuffle.

Lines are cut at ``\\n`` by Spark's text source, as bytes; the rest is the csv module's, on a range instead of a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stages import saved
from .catalogs import Header, _batches, _records, header_of


def open_after(line: bytes, delimiter: bytes, open_: bool) -> bool:
    """Whether a quote is open behind a line, as the csv module counts: a quote opens at the begin of a cell only, two quotes
    inside are one, and what follows a closing one is part of the cell."""
    ends, i, n = re.compile(b"[" + re.escape(delimiter) + b"\\r]"), 0, len(line)
    while True:
        if open_:
            j = line.find(b'"', i)
            if j < 0:
                return True
            if line[j + 1 : j + 2] == b'"':
                i = j + 2
                continue
            i, open_ = j + 1, False
        elif line[i : i + 1] == b'"':  # at the begin of a cell
            i, open_ = i + 1, True
            continue
        found = ends.search(line, i)
        if not found:
            return False
        i = found.end()
        if i >= n:
            return False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``path, at, line``: lines as bytes, ``at`` being where the range begins that a task reads; its lines come in order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """The ranges of a task, one after another, each with its lines."""
    rows = ((p, a, line or b"") for b in batches for p, a, line in zip(*(c.to_pylist() for c in b.columns)))
    row = next(rows, None)
    while row is not None:
        path, at = row[:2]

        def lines() -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[:2] == (path, at):
                yield row[2]
                row = next(rows, None)

        own = lines()
        yield path, at, own
        for _ in own:  # what was not read
            pass


def _text(raw: bytes, latin: bool) -> str:
    return raw.decode("latin-1") if latin else raw.decode("utf-8", "replace")


def _heads(lines: DataFrame) -> DataFrame:
    """``path, head``: the begin of each file, as far as its first record goes and 4096 bytes at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for path, at, own in _ranges(batches):
            held, size, open_ = [], 0, dict.fromkeys(b",;\t", False)
            for line in own if at == 0 else ():
                held.append(line)
                size += len(line) + 1
                open_ = {d: open_after(line, bytes([d]), o) for d, o in open_.items()}
                if size >= 4096 and not any(open_.values()):
                    break
            if held:
                out.append((path, b"\n".join(held) + b"\n"))
        yield from _batches(out, pa.schema([("path", pa.string()), ("head", pa.binary())]))

    return lines.mapInArrow(run, "path string, head binary")


def _summaries(lines: DataFrame, delimiters: dict[str, str]) -> DataFrame:
    """One row for each range, ``path, at, closed, opened, settles, latin``: whether a quote is open behind it, from either begin;
    whether one that is open at its begin closes in it; and whether it is not UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for path, at, own in _ranges(batches):
            d, closed, opened, settles, latin = delimiters[path].encode(), False, True, False, False
            for line in own:
                if b'"' in line:
                    closed, opened = open_after(line, d, closed), open_after(line, d, opened)
                    settles = settles or not opened
                if not latin and not line.isascii():
                    try:
                        line.decode("utf-8")
                    except UnicodeDecodeError:
                        latin = True
            out.append((path, at, closed, opened, settles, latin))
        flags = [(n, pa.bool_()) for n in ("closed", "opened", "settles", "latin")]
        yield from _batches(out, pa.schema([("path", pa.string()), ("at", pa.int64()), *flags]))

    return lines.mapInArrow(run, "path string, at long, closed boolean, opened boolean, settles boolean, latin boolean")


#: Records of a range (``cells``, numbered by ``n`` from 1), or a part of a record that began in the range ``at``: its bytes, with
#: the range that it lies in as ``n``.
_PART = pa.schema([("path", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("part", pa.binary())])


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of all CSV files at ``path``, as ``catalogs.read_rows`` says.  A header lies within the first range of its file.

    The driver holds the header of each file, and six values for each range of one.
    """
    lines = lines_of(spark, path)
    heads = {r["path"]: bytes(r["head"]) for r in _heads(lines).collect()}
    same = lambda f: re.sub("^([a-z0-9]+):/+", r"\1:/", unquote(f))
    known = set(map(same, heads))
    files = [*heads, *(f for f in spark.read.format("binaryFile").load(path).inputFiles() if same(f) not in known)]  # empty ones too
    delimiters = {p: header_of(h.decode("latin-1"), True).delimiter for p, h in heads.items()}  # it is ASCII, whatever the encoding
    begins: dict[tuple[str, int], tuple[bool, int]] = {}  # by range: whether a quote is open, and in which range it was opened
    latin: set[str] = set()
    state: dict[str, tuple[bool, int]] = {}
    for r in sorted(_summaries(lines, delimiters).collect()):
        open_, since = begins[r["path"], r["at"]] = state.get(r["path"], (False, 0))
        state[r["path"]] = (r["opened"] if open_ else r["closed"], since if open_ and not r["settles"] else r["at"])
        if r["latin"]:
            latin.add(r["path"])
    headers: dict[str, Header] = {}
    for p in {*files, *heads}:
        body = heads.get(p, b"").decode("latin-1" if p in latin else "utf-8-sig").lstrip("\ufeff")
        headers[p] = header_of(body, not body.strip())
    shared = spark.sparkContext.broadcast((begins, latin, headers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, latin, headers = shared.value
        for path, at, own in _ranges(batches):
            (open_, since), h = begins[path, at], headers[path]
            d, code, n = h.delimiter.encode(), "latin-1" if path in latin else "utf-8", 0

            def records(some: list[bytes], n: int) -> list[tuple]:
                text = (b"\n".join(some) + b"\n").decode(code)
                rows = list(_records(text.lstrip("\ufeff") if at == 0 and not n else text, h))
                return [(path, at, n + i, c, None) for i, c in enumerate(rows, 1)]

            held: list[bytes] = []  # lines of records that are not parsed yet
            for line in own:
                held.append(line)
                if open_ or b'"' in line:
                    was, open_ = open_, open_after(line, d, open_)
                    if was and not open_ and since != at:  # the end of a record of an earlier range
                        yield from _batches([(path, since, at, None, b"\n".join(held) + b"\n")], _PART)
                        held, since = [], at
                if len(held) >= 5000 and not open_:
                    out = records(held, n)
                    yield from _batches(out, _PART)
                    n, held = n + len(out), []
            if open_ and since != at:  # all of the range
                yield from _batches([(path, since, at, None, b"\n".join(held) + b"\n")], _PART)
            elif open_:
                whole = _closed(held, d)
                out = records(held[:whole], n) if whole else []
                yield from _batches([*out, (path, at, at, None, b"\n".join(held[whole:]) + b"\n")], _PART)
            elif held:
                yield from _batches(records(held, n), _PART)

    parts = saved(lines.mapInArrow(run, "path string, at long, n long, cells map<string,string>, part binary"))
    return _numbered(spark, parts, files, headers, latin)


def _closed(lines: list[bytes], delimiter: bytes) -> int:
    """How many of these lines make whole records."""
    open_, whole = False, 0
    for i, line in enumerate(lines, 1):
        open_ = open_after(line, delimiter, open_)
        if not open_:
            whole = i
    return whole


def _numbered(spark: SparkSession, parts: DataFrame, files: list[str], headers: dict[str, Header], latin: set[str]) -> DataFrame:
    """Rows with their number in the file, those that lie in several ranges among them; a file without any gives one row
    without cells, so that its report is not lost."""
    shared = spark.sparkContext.broadcast((headers, latin))

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        headers, latin = shared.value
        path, at = key
        text = b"".join(pdf.sort_values("n")["part"]).decode("latin-1" if path in latin else "utf-8")
        rows = [list(c) for c in _records(text, headers[path])]
        return pd.DataFrame({"path": [path] * len(rows), "at": [at] * len(rows), "n": [1 << 40] * len(rows), "cells": rows})

    # a record is one cell value to Spark anyway: its parts are one group
    some = parts.filter("part is not null").select("path", "at", "n", "part")
    across = some.groupBy("path", "at").applyInPandas(join, "path string, at long, n long, cells array<struct<k:string,v:string>>")
    rows = parts.filter("part is null").select("path", "at", "n", "cells").unionByName(across.select("path", "at", "n", F.map_from_entries("cells").alias("cells")))
    head = F.when(F.col("at") == 0, 1).otherwise(0)  # the header is the first record of its range
    order = Window.partitionBy("path", "at").orderBy("n")
    rows = saved(rows.withColumn("i", F.row_number().over(order) - head).filter("i > 0"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("path", "at").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    known = [(p, list(h.mapping.items()), h.unmapped, h.problem) for p, h in headers.items() if p in set(files)]
    info = spark.createDataFrame(known, "path string, m array<struct<k:string,v:string>>, unmapped array<string>, problem string").withColumn("mapping", F.map_from_entries("m")).drop("m")
    numbered = rows.join(starts, ["path", "at"]).select("path", (F.col("start") + F.col("i")).alias("row_idx"), "cells")
    return info.join(numbered, "path", "left").select("path", F.coalesce("row_idx", F.lit(0)).cast("long").alias("row_idx"), "cells", "mapping", "unmapped", "problem")

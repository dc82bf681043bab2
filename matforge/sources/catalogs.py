"""Reading and validating catalog files: CSV in several encodings and dialects, JSON lines, JSON arrays, text logs."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, specs, text
from ..functions.dialect import column
from ..stages import counted_before, numbered

FIELDS = list(rules.FIELD_ALIASES)
REQUIRED = FIELDS[:3]


def decode(content: bytes) -> str:
    """UTF-8, with or without a byte-order mark, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def delimiter_of(header: str) -> str:
    """The one of ``;`` and tab that is more frequent than both others in the first line, else a comma."""
    line = header.splitlines()[0] if header else ""
    n = {c: line.count(c) for c in ";\t,"}
    for c in ";\t":
        if all(n[c] > n[o] for o in n if o != c):
            return c
    return ","


def clean_name(name: str) -> str:
    return name.strip().strip("'\"").strip().lstrip("\ufeff").strip()


def map_columns(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """Canonical field by header, each field once, and the headers that are left."""
    spaced = lambda s: s.lower().replace("-", " ").replace("_", " ")
    known = {f: set(map(spaced, names)) for f, names in rules.FIELD_ALIASES.items()}
    mapped: dict[str, str] = {}
    left = []
    for h in filter(None, map(clean_name, headers)):
        field = next((f for f, names in known.items() if f not in mapped.values() and spaced(h) in names), None)
        if field:
            mapped[h] = field
        else:
            left.append(h)
    return mapped, left


#: Bound of the rows of one file, where rows of several are numbered together.
ROWS_OF_A_FILE = 1 << 40
_ROW = "path string, row_idx long, cells map<string,string>, mapping map<string,string>, unmapped array<string>, problem string"
_KIND = pa.schema(
    [("path", pa.string()), ("row_idx", pa.int64()), ("cells", pa.map_(pa.string(), pa.string())), ("mapping", pa.map_(pa.string(), pa.string())), ("unmapped", pa.list_(pa.string())), ("problem", pa.string())]
)


class Header(NamedTuple):
    """What the first record of a file tells about all others."""

    delimiter: str
    names: list[str]
    mapping: dict[str, str]
    unmapped: list[str]
    problem: str | None


def header_of(body: str, blank: bool) -> Header:
    """The header of a file that begins with ``body``; ``blank`` files have none."""
    delimiter = delimiter_of(body[:4096])
    names = [] if blank else [clean_name(h) for h in next(csv.reader(io.StringIO(body, newline=""), delimiter=delimiter), [])]
    mapping, left = map_columns(names)
    problem = "CSV file is empty." if blank else None if any(names) else "CSV header is missing or empty."
    missing = [f for f in REQUIRED if f not in mapping.values()]
    if not problem and missing:
        problem = f"Missing mandatory column mapping for: {', '.join(missing)}"
    return Header(delimiter, names, mapping, left, problem)


def _records(text: str, h: Header) -> Iterator[list[tuple[str, str]] | None]:
    """Cells by header of each record that has any; surplus cells are dropped, missing ones are absent."""
    for cells in csv.reader(io.StringIO(text, newline=""), delimiter=h.delimiter) if any(h.names) else ():
        if any(v.strip() for v in cells):
            yield list(dict(zip(h.names, cells)).items())


def _batches(rows: list[tuple], schema: pa.Schema = _KIND) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000]), schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole files.  A file without rows gives one row without cells, so that its report is not lost."""
    for b in batches:
        for path, content in zip(*(c.to_pylist() for c in b.columns)):
            body = decode(content).lstrip("\ufeff")
            h = header_of(body, not body.strip())
            out = []
            for n, cells in enumerate(_records(body, h)):
                if n:  # the first is the header
                    out.append((path, n, cells, list(h.mapping.items()), h.unmapped, h.problem))
            yield from _batches(out or [(path, 0, None, list(h.mapping.items()), h.unmapped, h.problem)])


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of the CSV files at ``path``: quoted delimiters and line breaks, any line ending.  Each file has a header.

    A large file is read by many tasks (``sources.ranges``); a row is what the csv module makes of the whole file.
    """
    from . import ranges

    return ranges.read_rows(spark, path)


def rows_of_bytes(spark: SparkSession, content: bytes, name: str = "upload.csv") -> DataFrame:
    """Raw rows of one uploaded file."""
    return spark.createDataFrame([(name, bytearray(content))], "path string, content binary").mapInArrow(_rows, _ROW)


def validated(rows: DataFrame, default_cpse: str | None = None) -> DataFrame:
    """Raw rows with canonical fields, ``errors`` (an array, empty for valid rows) and ``item_id``.

    The first row of a source and code is not a duplicate, even if it is otherwise invalid.
    """
    by_field = F.map_from_entries(F.transform(F.map_entries("mapping"), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    field = lambda f: F.trim(F.coalesce(F.try_element_at("cells", F.try_element_at(by_field, F.lit(f))), F.lit("")))
    got = rows.filter("cells is not null").withColumns({f: field(f) for f in FIELDS})
    default = F.lit(default_cpse or "GENERIC")
    got = got.withColumn("source_cpse", F.upper(F.trim(F.coalesce(F.nullif("source_cpse", F.lit("")), default))))
    no_code_column = F.try_element_at(by_field, F.lit("material_code")).isNull()
    number = F.col("row_idx").cast("string")
    got = got.withColumn("material_code", F.when((F.col("material_code") == "") & no_code_column, F.concat(F.lit("MAT-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).otherwise(F.col("material_code")))
    twin = F.row_number().over(Window.partitionBy("path", "source_cpse", "material_code").orderBy("row_idx")) > 1
    got = got.withColumn("_twin", twin & (F.col("material_code") != ""))
    missing = [F.when(F.col(f) == "", f"Missing {f}") for f in REQUIRED]
    repeated = F.when(F.col("_twin"), F.concat(F.lit("Duplicate source item '"), "material_code", F.lit("' for CPSE '"), "source_cpse", F.lit("'")))
    got = got.withColumn("errors", F.array_compact(F.array(*missing, repeated))).drop("_twin")
    prefixed = F.startswith(F.upper("material_code"), F.concat("source_cpse", F.lit("-")))
    return got.withColumn("item_id", F.when(prefixed, F.col("material_code")).otherwise(F.concat("source_cpse", F.lit("-"), "material_code")))


def report(rows: DataFrame, default_cpse: str | None = None) -> DataFrame:
    """One row for each file: counts of rows and errors, column mapping, and the errors in order."""
    files = rows.groupBy("path").agg(F.first("mapping").alias("column_mapping"), F.first("unmapped").alias("unmapped_columns"), F.first("problem").alias("problem"))
    has = lambda start: F.count_if(F.exists("errors", lambda e: F.startswith(e, F.lit(start))))
    line = F.when(F.size("errors") > 0, F.struct("row_idx", F.concat(F.lit("Row "), "row_idx", F.lit(": "), F.array_join("errors", "; ")).alias("text")))
    counted = validated(rows, default_cpse).groupBy("path").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.size("errors") == 0).alias("valid_rows"),
        F.count_if(F.size("errors") > 0).alias("invalid_rows"),
        has("Duplicate").alias("duplicate_source_rows"),
        has("Missing material_code").alias("missing_material_codes"),
        has("Missing material_description").alias("missing_descriptions"),
        has("Missing uom").alias("missing_uom"),
        F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]).alias("row_errors"),
    )
    counts = ["total_rows", "valid_rows", "invalid_rows", "duplicate_source_rows", "missing_material_codes", "missing_descriptions", "missing_uom"]
    errors = F.concat(F.array_compact(F.array("problem")), F.coalesce("row_errors", F.array().cast("array<string>")))
    return files.join(counted, "path", "left").select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "column_mapping", "unmapped_columns", errors.alias("errors"))


def standardized(rows: DataFrame, default_cpse: str | None = None) -> DataFrame:
    """Valid rows in the catalog's form, with nested ``specs``; ``ord`` follows the file, and ``_file`` (its number) if it is there."""
    before = F.col("_file") * ROWS_OF_A_FILE if "_file" in rows.columns else F.lit(0)
    ok = validated(rows, default_cpse).filter("size(errors) = 0")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    ok = ok.withColumn("clean_description", column(text.clean("material_description")))
    found = specs.extract(ok, "material_description")
    own = F.col("specification") != ""
    listed = F.expr("array_contains(split(standards, ','), specification)")
    found = found.withColumn("standards", F.when(own & ~listed, F.concat_ws(",", F.nullif("standards", F.lit("")), "specification")).otherwise(F.col("standards")))
    return found.select(
        (F.col("row_idx") + before).alias("ord"), "source_cpse", "material_code", "material_description", "uom",
        *(empty(c).alias(c) for c in FIELDS[3:] if c != "source_cpse"),
        F.col("cells").alias("raw_data"), "item_id",
        F.col("material_description").alias("raw_description"), F.col("clean_description").alias("normalized_description"), "clean_description",
        "category", "category_subtype", specs.nested(), column(text.unit("uom")).alias("unit_of_measure"), F.col("category").alias("category_hint"),
    )


def read_catalog(spark: SparkSession, path: str, cpse: str = "GENERIC") -> DataFrame:
    """The catalog of all CSV files at ``path``.  ``ord`` follows the files by name, then their rows: no two rows share one."""
    rows = read_rows(spark, path)
    files = numbered(spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path")), 0, "path").withColumnRenamed("number", "_file")
    return standardized(rows.join(files, "path"), cpse)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_keyed_jsonl(spark: SparkSession, path: str, key: str = "item_id", schema=None) -> DataFrame:
    """JSON lines by key; the last line of a key counts."""
    lines = read_jsonl(spark, path, schema).withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
    return last_by(lines, key, "_at").drop("_at")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest ``order`` of each key, by aggregation (no sort of whole groups)."""
    packed = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_r"))
    return packed.select("_r.*")


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def blocked_of_log(lines: DataFrame, line: str = "value", order: str = "line_no") -> DataFrame:
    """Blocked matches in a text log: ``match_id, item_a, item_b, confidence_score, status, block_reason``.

    A record ends at its SAFETY GATE TRIGGERED line; items and confidence are those last seen since the record before it.
    ``lines`` have an order within each ``file`` (a column, if there is one).
    """
    t = F.trim(F.col(line))
    keys = [c for c in ("file",) if c in lines.columns]
    ends = F.expr(f"trim({line}) like '%SAFETY GATE TRIGGERED:%'") & ~F.startswith(t, F.lit("A:")) & ~F.startswith(t, F.lit("B:")) & ~F.expr(f"trim({line}) like '%[BLOCKED%' and trim({line}) like '%SAFETY GATE%'")
    found = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    is_a, is_b = F.startswith(t, F.lit("A:")), F.startswith(t, F.lit("B:"))
    blocked = ~is_a & ~is_b & F.expr(f"{line} like '%[BLOCKED%' and {line} like '%SAFETY GATE%'")
    marked = lines.select(*keys, order, t.alias("t"), ends.alias("ends"), F.when(is_a, found(r"A:\s*([A-Z0-9-]+)")).alias("a"), F.when(is_b, found(r"B:\s*([A-Z0-9-]+)")).alias("b"), F.when(blocked, F.coalesce(found(r"confidence=([0-9.]+)"), F.lit("none"))).alias("c"))
    numbered = counted_before(marked, keys, order, "ends", "n")  # a log of any length is counted by all tasks
    # records are short: each is one group
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c]
    rec = numbered.groupBy(*keys, "n").agg(last("a").alias("item_a"), last("b").alias("item_b"), last("c").alias("c"), F.max(F.when(F.col("ends"), F.trim(F.regexp_extract("t", "SAFETY GATE TRIGGERED:(.*)$", 1)))).alias("block_reason"), F.max("ends").alias("done"))
    rec = rec.filter("done and item_a is not null and item_b is not null")
    return rec.select(
        *keys, F.concat(F.lit("BLOCKED-"), "item_a", F.lit("-"), "item_b").alias("match_id"), "item_a", "item_b",
        F.nullif("c", F.lit("none")).cast("double").alias("confidence_score"), F.lit("safety_gate_blocked").alias("status"), "block_reason",
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Blocked matches of the log files at ``path``; a large file is read by many tasks.

    Lines are in the order of their range of the file, and in it of the reading task.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))
    return blocked_of_log(lines.withColumn("line_no", F.struct("at", F.monotonically_increasing_id().alias("i"))).drop("at"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of ``df``."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_json_array(df: DataFrame) -> str:
    """A small result as a JSON array, for the exchange format of reports."""
    return json.dumps([json.loads(r) for r in df.toJSON().collect()], indent=2)

"""Substring search through an inverted index of trigrams.

Every distinct text is posted once under each of its three-letter parts, in lower case, sorted by part, so that a look-up reads
little of the table; a second table says which rows have which text.  What a search holds literally is cut the same way; texts
that are posted under all of its parts are candidates, and the search itself, run on their rows only, tells which are hits.  A
search without three letters in a row finds no help here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import shared_folder, spread

SIZE = 3


@dataclass(frozen=True)
class Index:
    """Postings ``gram, text`` of texts by number, and the rows ``text, key`` that have them."""

    postings: DataFrame
    rows: DataFrame

    def candidates(self, runs: list[str]) -> DataFrame | None:
        """``key`` of rows with one field that may hold all ``runs``, each as it is but for case; None if they are too short."""
        grams = sorted({r[i : i + SIZE] for r in map(str.lower, runs) for i in range(len(r) - SIZE + 1)})
        if not grams:
            return None
        found = self.postings.filter(F.col("gram").isin(grams)).groupBy("text").agg(F.count("*").alias("n"))
        return self.rows.join(found.filter(F.col("n") == len(grams)), "text", "left_semi").select("key").distinct()

    def narrowed(self, rows: DataFrame, key: str, runs: list[str]) -> DataFrame:
        """``rows`` that may hold ``runs``; all of them if the index cannot tell."""
        found = self.candidates(runs)
        return rows if found is None else rows.join(found.withColumnRenamed("key", key), key, "left_semi")


def build(*texts: tuple[DataFrame, str, list[str]], path: str | None = None) -> Index:
    """An index of the given columns of tables, each with the column that is its key; written to ``path`` or the shared folder.

    Null texts and such of fewer than three letters have no postings.  Repeated keys are one.
    """
    spark = texts[0][0].sparkSession
    parts = []
    for rows, key, columns in texts:
        fields = F.array_distinct(F.array(*(F.lower(F.col(c).cast("string")) for c in columns)))
        parts.append(rows.select(F.col(key).alias("key"), F.explode(fields).alias("letters")))
    path = path or shared_folder(spark, "postings")
    every = reduce(DataFrame.unionByName, parts).filter(F.length("letters") >= SIZE)
    # a text's number is its hash: texts that share one are found together, and the search tells them apart
    every = every.select(F.xxhash64("letters").alias("text"), "key", "letters")
    every.select("text", "key").write.parquet(f"{path}/rows")
    grams: Column = F.expr(f"array_distinct(transform(sequence(1, length(letters) - {SIZE - 1}), i -> substring(letters, i, {SIZE})))")
    distinct = spread(every.select("text", "letters").distinct(), "text")
    posted = distinct.select(F.explode(grams).alias("gram"), "text").distinct()
    # ranges of parts and texts: one part that most texts have is spread over many
    posted.repartitionByRange("gram", "text").sortWithinPartitions("gram", "text").write.parquet(f"{path}/postings")
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Index(read("postings", posted.schema), read("rows", every.select("text", "key").schema))


def literal_runs(pattern: str) -> list[str]:
    """What a pattern with the wildcards ``%`` and ``_`` holds literally; a backslash takes a wildcard's meaning."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            run += pattern[i]
        elif c in "%_":
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    return [r for r in [*runs, run] if r]

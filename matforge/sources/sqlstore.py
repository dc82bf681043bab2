"""The registry in a SQL database, through JDBC: constraints kept by the store, one transaction for all tables.

Executors write new rows to staging tables of this save side by side; one transaction then replaces the tables by what was
staged.  If a row breaks a constraint, or the driver dies, the tables are as they were.  A task that runs twice stages its rows
twice, so equal staged rows count once.  Of two writers that loaded the same tables the last one wins.  Reads are split by a
numeric column.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry
from ..operators.registry import ACTIONS, Tables

KEY, TEXT = "varchar(512)", "varchar(32672)"
#: Columns by table; ``no`` orders and splits the rows that have no number of their own.
COLUMNS = {
    "registry": {"cnmc_code": KEY, "canonical_description": TEXT, "confidence_at_merge": "double", "merge_type": KEY, "created_at": KEY, "no": "bigint"},
    "mapping": {"id": "bigint", "cnmc_code": KEY, "source_cpse": KEY, "original_code": KEY},
    "audit": {"entry_id": "bigint", "cnmc_code": KEY, "action": KEY, "actor": KEY, "details": TEXT, "timestamp": KEY},
    "decisions": {"match_id": KEY, "reviewer_decision": KEY, "decision": KEY, "reviewer_id": KEY, "reviewed_at": "bigint", "notes": TEXT},
}
SPLIT = {"registry": "no", "mapping": "id", "audit": "entry_id", "decisions": "reviewed_at"}
NEEDED = {"registry": ("cnmc_code", "canonical_description", "confidence_at_merge"), "mapping": ("id", "cnmc_code", "source_cpse", "original_code"), "audit": ("entry_id", "action"), "decisions": ("match_id", "decision")}
RULES = {
    "registry": ['PRIMARY KEY ("cnmc_code")'],
    "mapping": ['PRIMARY KEY ("id")', 'UNIQUE ("source_cpse", "original_code")', 'FOREIGN KEY ("cnmc_code") REFERENCES "registry" ("cnmc_code")'],
    "audit": ['PRIMARY KEY ("entry_id")', f"""CHECK ("action" IN ({', '.join(f"'{a}'" for a in ACTIONS)}))"""],
    "decisions": ["""CHECK ("decision" IN ('approved', 'rejected'))"""],
}


class Unreachable(ConnectionError):
    """The database cannot be reached."""


class Refused(ValueError):
    """The database refused the rows: one breaks a constraint."""


@dataclass(frozen=True)
class Store:
    url: str
    splits: int = 8  # tasks, and connections, that read or write one table
    driver: str | None = None

    def _options(self) -> dict[str, str]:
        return {"url": self.url} | ({"driver": self.driver} if self.driver else {})

    def _run(self, spark: SparkSession, statements: list[str]) -> None:
        """All statements in one transaction of the driver."""
        try:
            connection = spark._jvm.java.sql.DriverManager.getConnection(self.url)
        except Py4JJavaError as e:
            raise Unreachable(self.url) from e
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for sql in statements:
                statement.execute(sql)
            connection.commit()
        except Py4JJavaError as e:
            connection.rollback()
            raise Refused(str(e.java_exception.getMessage())) from e
        finally:
            connection.close()

    def create(self, spark: SparkSession) -> None:
        """Empty tables, with their rules."""
        kind = lambda t, c, k: f'"{c}" {k}' + (" NOT NULL" if c in NEEDED[t] else "")
        made = [f"""CREATE TABLE "{t}" ({', '.join([*(kind(t, c, k) for c, k in columns.items()), *RULES[t]])})""" for t, columns in COLUMNS.items()]
        self._run(spark, made)

    def drop(self, spark: SparkSession) -> None:
        self._run(spark, [f'DROP TABLE "{t}"' for t in ("mapping", "registry", "audit", "decisions")])

    def save(self, t: Tables) -> None:
        """Replaces all four tables at once; ``Refused``, and nothing changed, if a row breaks a rule.

        ``t`` may have been loaded from here: it is read to the end before anything is replaced.
        """
        spark = t.registry.sparkSession
        staged = {n: f"staged_{n}_{uuid.uuid4().hex}" for n in COLUMNS}
        self._run(spark, [f"""CREATE TABLE "{staged[n]}" ({', '.join(f'"{c}" {k}' for c, k in columns.items())})""" for n, columns in COLUMNS.items()])
        try:
            for name, df in _outward(t).items():
                df.coalesce(self.splits).write.format("jdbc").options(**self._options(), dbtable=f'"{staged[name]}"').mode("append").save()
            replace = [f'DELETE FROM "{n}"' for n in ("mapping", "registry", "audit", "decisions")]
            for n, columns in COLUMNS.items():
                plain = ", ".join(f"""CASE WHEN "{c}" LIKE 'v%' THEN SUBSTR("{c}", 2) END""" if k in (KEY, TEXT) else f'"{c}"' for c, k in columns.items())
                names = ", ".join(f'"{c}"' for c in columns)
                replace.append(f'INSERT INTO "{n}" ({names}) SELECT DISTINCT {plain} FROM "{staged[n]}"')
            self._run(spark, replace)
        finally:
            self._run(spark, [f'DROP TABLE "{x}"' for x in staged.values()])

    def load(self, spark: SparkSession) -> Tables:
        """The four tables, each read in ``splits`` ranges of its number; filters on columns go to the database."""
        return _inward({n: self._read(spark, n) for n in COLUMNS})

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        column = SPLIT[name]
        read = spark.read.format("jdbc").options(**self._options())
        try:
            low, high = read.option("query", f'SELECT MIN("{column}") AS "lo", MAX("{column}") AS "hi" FROM "{name}"').load().first()
        except Py4JJavaError as e:
            raise Unreachable(self.url) from e
        read = spark.read.format("jdbc").options(**self._options(), dbtable=f'"{name}"')
        if low is None or low == high:
            return read.load()
        return read.options(partitionColumn=column, lowerBound=low, upperBound=high + 1, numPartitions=self.splits).load()


def _outward(t: Tables) -> dict[str, DataFrame]:
    """Times go as text or microseconds, so that no time zone of a database changes them.

    Staged texts are marked (``v`` and the text, or ``n`` for null), as drivers disagree on the type of a null text.
    """
    number = F.coalesce(F.regexp_extract("cnmc_code", r"-(\d+)$", 1).try_cast("long"), F.lit(0))
    tables = {
        "registry": t.registry.withColumn("created_at", F.col("created_at").cast("string")).withColumn("no", number),
        "mapping": t.mapping,
        "audit": t.audit.withColumn("timestamp", F.col("timestamp").cast("string")),
        "decisions": t.decisions.withColumn("reviewed_at", F.unix_micros("reviewed_at")),
    }
    marked = lambda n, c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), c)) if COLUMNS[n][c] in (KEY, TEXT) else F.col(c)
    return {n: df.select(*(marked(n, c).alias(c) for c in COLUMNS[n])) for n, df in tables.items()}


def _inward(tables: dict[str, DataFrame]) -> Tables:
    return Tables(
        tables["registry"].drop("no").withColumn("created_at", F.col("created_at").cast("timestamp_ntz")),
        tables["mapping"],
        tables["audit"].withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")),
        tables["decisions"].withColumn("reviewed_at", F.timestamp_micros("reviewed_at")),
    )


def connect(spark: SparkSession, store: Store, path: str) -> tuple[Tables, str]:
    """The tables of ``store``, and ``"sql"``; if it cannot be reached, those of the folder ``path``, and ``"folder"``."""
    try:
        store._run(spark, [])
    except Unreachable:
        return registry.open_or_create(spark, path), "folder"
    return store.load(spark), "sql"

"""One definition of an expression, two engines.

Rules are built as SQL text by a dialect.  Spark evaluates them as columns; the other dialect lets an independent engine check
the same rules over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Dialect:
    """SQL text of the few constructs that differ between engines.  Regular expressions ignore case."""

    def text(self, value: str) -> str:
        raise NotImplementedError

    def matches(self, x: str, pattern: str) -> str:
        raise NotImplementedError

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        """The group of the leftmost match, null if there is none or it is empty."""
        raise NotImplementedError

    def replace(self, x: str, pattern: str, by: str) -> str:
        """All matches; ``\\1`` stands for the first group."""
        raise NotImplementedError

    def div(self, a: str, b: int) -> str:
        raise NotImplementedError

    def string(self, x: str) -> str:
        raise NotImplementedError

    def one_of(self, x: str, table: dict[str, str], otherwise: str = "NULL", numbers: bool = False) -> str:
        """Lookup of ``x`` in a fixed table; with ``numbers``, the keys are numbers."""
        raise NotImplementedError


class Spark(Dialect):
    def text(self, value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def matches(self, x, pattern):
        return f"({x} rlike {self.text('(?i)' + pattern)})"

    def extract(self, x, pattern, group=1):
        return f"nullif(regexp_extract({x}, {self.text('(?i)' + pattern)}, {group}), '')"

    def replace(self, x, pattern, by):
        by = by.replace("$", "\\$")
        for i in range(1, 4):
            by = by.replace(f"\\{i}", f"${i}")
        return f"regexp_replace({x}, {self.text('(?i)' + pattern)}, {self.text(by)})"

    def one_of(self, x, table, otherwise="NULL", numbers=False):
        # a literal map: ``x`` is evaluated once, whatever the size of the table
        pairs = ", ".join(f"{f'{k}D' if numbers else self.text(k)}, {self.text(v)}" for k, v in table.items())
        found = f"try_element_at(map({pairs}), {x})"
        return found if otherwise == "NULL" else f"coalesce({found}, {otherwise})"

    def div(self, a, b):
        return f"({a} div {b})"

    def string(self, x):
        return f"cast({x} as string)"


class Duck(Dialect):
    def text(self, value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, {self.text(pattern)}, 'i')"

    def extract(self, x, pattern, group=1):
        return f"nullif(regexp_extract({x}, {self.text(pattern)}, {group}, 'i'), '')"

    def replace(self, x, pattern, by):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'gi')"

    def one_of(self, x, table, otherwise="NULL", numbers=False):
        by_value: dict[str, list[str]] = {}
        for k, v in table.items():
            by_value.setdefault(v, []).append(f"{k}e0" if numbers else self.text(k))
        return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(k)}) THEN {self.text(v)}" for v, k in by_value.items()) + f" ELSE {otherwise} END"

    def div(self, a, b):
        return f"({a} // {b})"

    def string(self, x):
        return f"cast({x} as varchar)"


SPARK, DUCK = Spark(), Duck()

#: An expression by dialect.
Rule = Callable[[Dialect], str]
#: Layers of named expressions; a layer may use the names of those before it.
Layers = Sequence[dict[str, Rule]]


def column(rule: Rule) -> Column:
    return F.expr(rule(SPARK))


def with_layers(df: DataFrame, layers: Layers) -> DataFrame:
    for layer in layers:
        df = df.withColumns({name: column(rule) for name, rule in layer.items()})
    return df


def layered_sql(source: str, layers: Layers, d: Dialect = DUCK) -> str:
    """``source`` (SQL text of a table) with the layers as nested selects."""
    for layer in layers:
        items = ", ".join(f"{rule(d)} AS {name}" for name, rule in layer.items())
        source = f"SELECT *, {items} FROM ({source})"
    return source

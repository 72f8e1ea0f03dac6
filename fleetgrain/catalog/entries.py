"""How a query is registered: an operator on views, typed output, SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrain.catalog.views import Views, duck_with
from fleetgrain.session import prepare

# keeps exact halves, which sums in another order miss by 1e-12, on one side of the rounding
NUDGE = 1e-9

Build = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Entry:
    """`output` lists name:kind with kinds s, i, f, b, t and d.

    Both engines cast to the same flat types: text, 64-bit integer, double
    rounded to four digits, boolean, and text for timestamps and dates.
    """

    name: str
    output: str
    build: Build
    sql: str | None = None
    views: tuple[str, ...] = ()

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(part.split(":")) for part in self.output.replace(",", " ").split()]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        df = self.build(Views(spark, folder))
        return df.select(*[_spark_value(name, kind) for name, kind in self.columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        recursive = body.upper().startswith("WITH RECURSIVE ")
        if recursive:
            body = "WITH " + body[len("WITH RECURSIVE ") :]
        with_ = self._with(body)
        return with_.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else with_

    def _with(self, body: str) -> str:
        """`body` after the views it reads, with the typed output."""
        select = ", ".join(_duck_value(name, kind) for name, kind in self.columns())
        prefix = duck_with(list(self.views)) if self.views else ""
        if body.upper().startswith("WITH "):
            inner = body[5:]
            split = _main_select(inner)
            ctes, main = inner[:split].strip(), inner[split:]
            joined = f"{prefix},\n{ctes}" if prefix else f"WITH {ctes}"
            return f"{joined},\nresult_ AS ({main})\nSELECT {select} FROM result_"
        joined = f"{prefix},\n" if prefix else "WITH "
        return f"{joined}result_ AS ({body})\nSELECT {select} FROM result_"


def _main_select(text: str) -> int:
    """Offset of the SELECT that follows the common table expressions."""
    depth = 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and text[i : i + 7].upper() in ("SELECT ", "SELECT\n"):
            return i
    raise ValueError("no SELECT after WITH")


def _spark_value(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "s":
        value = c.cast("string")
    elif kind == "i":
        value = c.cast("bigint")
    elif kind == "f":
        value = F.round(c.cast("double") + NUDGE, 4) + F.lit(0.0)
    elif kind == "b":
        value = c.cast("boolean")
    elif kind == "t":
        value = c.cast("timestamp").cast("string")
    else:
        value = c.cast("date").cast("string")
    return value.alias(name)


def _duck_value(name: str, kind: str) -> str:
    types = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN"}
    if kind in types:
        return f"CAST({name} AS {types[kind]}) AS {name}"
    if kind == "f":
        return f"round(CAST({name} AS DOUBLE) + {NUDGE:.10f}, 4) + 0.0 AS {name}"
    base = "TIMESTAMP" if kind == "t" else "DATE"
    return f"CAST(CAST({name} AS {base}) AS VARCHAR) AS {name}"


class Registry:
    """Collects entries of one family."""

    def __init__(self) -> None:
        self.entries: list[Entry] = []

    def add(self, name: str, output: str, build: Build, sql: str | None = None, views: str = "") -> None:
        self.entries.append(Entry(name, output, build, sql, tuple(views.split())))

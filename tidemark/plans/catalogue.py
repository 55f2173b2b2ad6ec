"""The named queries over the driver's tables, with the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .lakehouse import LAKEHOUSE
from .relational import RELATIONAL
from .scalar import FUNCTIONS, SCALAR
from .tpch import TPCH

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temporary views of the tables a query names; nothing is read yet but footers."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _sql(text: str) -> Query:
    import re

    named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, named)
        return spark.sql(text)

    return run


TEXTS: dict[str, tuple[str, str | None]] = {**{name: (text, None) for name, text in TPCH.items()}, **RELATIONAL, **SCALAR}


def queries() -> dict[str, Query]:
    own = {name: _sql(text) for name, (text, _) in TEXTS.items()}
    return own | {name: f for name, (f, _) in {**FUNCTIONS, **LAKEHOUSE}.items()}


def oracle_sql() -> dict[str, str]:
    own = {name: other or text for name, (text, other) in TEXTS.items()}
    return own | {name: text for name, (_, text) in {**FUNCTIONS, **LAKEHOUSE}.items()}

"""Verbs on whole tables: order, samples, binding with sources, look-up by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import Measurements


def ordering(columns: list[str]) -> list[Column]:
    """Sort columns with nulls last; `-name` is descending."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns]


def arranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """df in order, nulls last whichever way; meant for sinks."""
    return df.orderBy(*ordering(columns))


def positions(df: DataFrame, within: list[str], columns: list[str], name: str = "position") -> DataFrame:
    """Adds each row's place (from 1) in its group's order, so that an order lasts beyond a shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*ordering(columns))))


def head_lines(df: DataFrame, text: Column, columns: list[str], shown: int = 9) -> list[str]:
    """The first lines in order, and "..." if there are more; only shown + 1 rows reach the driver."""
    found = [r[0] for r in arranged(df.withColumn("line_", text), columns).select("line_").limit(shown + 1).collect()]
    return found[:shown] + ["..."] * (len(found) > shown)


def slice_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by the least MD5 of seed and key: a random choice that stays the same."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("drawn_", drawn).orderBy("drawn_", key).limit(n).drop("drawn_")


def bind_named(tables: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """The tables' rows below each other, by column name, with their table's name first; absent columns are null."""
    out = None
    for key, df in tables.items():
        part = df.select(F.lit(key).alias(name), *df.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("bind_named: no tables")
    return out


def table_by_name(spark: SparkSession, name: str, known: dict[str, Measurements | dict[str, DataFrame] | DataFrame] | None = None) -> DataFrame:
    """A table by name: of `known` or the catalogue; `bundle$table` and `bundle[["table"]]` take one of a bundle."""
    found = re.fullmatch(r"""\s*([\w.]+)(?:\$(\w+)|\[\[["'](\w+)["']\]\])?\s*""", name)
    if found is None:
        raise ValueError(f"{name} is no table name")
    held, part = (known or {}).get(found[1]), found[2] or found[3]
    if held is None:
        return spark.table(f"{found[1]}.{part}" if part else found[1])
    if part:
        held = getattr(held, part, None) if isinstance(held, Measurements) else held.get(part) if isinstance(held, dict) else None
    if not isinstance(held, DataFrame):
        raise ValueError(f"{name} is no table")
    return held

"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts (fixed value).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words as an array: maximal runs of other characters than white space."""
    return F.array_remove(F.split(text, SPACE), "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

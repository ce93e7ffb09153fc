"""Shared small things: nesting whole rows so that an operator's own columns never clash with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java and RE2 pattern of the white space that parts words: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def nested(df: DataFrame, **own: str) -> DataFrame:
    """One struct column `row` with all of df's columns, besides own names for columns of it."""
    return df.select(F.struct("*").alias("row")).select("row", *[F.col(f"row.{v}").alias(k) for k, v in own.items()])


def words_of(text: Column) -> Column:
    """Words of a text that is not null, in order: runs of anything but space and the controls 9 to 13."""
    bare = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))

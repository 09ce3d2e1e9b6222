"""Computations in steps that the optimizer keeps apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(df: DataFrame, keep: list[str], *columns: Column | str) -> DataFrame:
    """``keep`` and the computed columns, by way of a generator: the optimizer neither merges the steps of a long
    computation into one expression nor copies them into filters above or lambdas, either of which multiplies the work."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))

"""Assertions inside the plan: a row that breaks one fails the query that needs it, and nothing runs before.

The message begins with the name of the exception that stands for the check;
:func:`named` gives a block of actions those exceptions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failing(error: type[Exception], what: str, *shown: Column | str) -> Column:
    """An expression that raises ``error`` with ``what`` and the values of ``shown``."""
    values = F.concat_ws(", ", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null")) for c in shown))
    return F.raise_error(F.concat(F.lit(f"{error.__name__}: {what}: ("), values, F.lit(")")))


def asserted(df: DataFrame, bad: Column, error: type[Exception], what: str, *shown: Column | str) -> DataFrame:
    """``df``, or ``error`` if any of its rows is ``bad``."""
    return df.where(F.when(F.coalesce(bad, F.lit(False)), failing(error, what, *shown)).otherwise(F.lit(True)))


def unique(df: DataFrame, keys: list[str], error: type[Exception], what: str) -> DataFrame:
    """``df``, or ``error`` if two rows have the same keys: one grouping by what the table is joined on."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__r") if rest else F.lit(1).alias("__r"))
    kept = asserted(one, F.col("__n") > 1, error, what, *keys)
    return kept.select(*(c if c in keys else F.col(f"__r.`{c}`").alias(c) for c in df.columns))


@contextmanager
def named(*errors: type[Exception]) -> Iterator[None]:
    """Failed assertions within become their exception, if it is one of ``errors``."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        for error in errors:
            if m := re.search(rf"\b{error.__name__}: (.*?\))", str(e), re.S):
                raise error(m[1]) from e
        raise

"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import spanned, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", twin: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name; ``twin`` is its SQL over the named views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = spanned(f)
        if twin is not None:
            ORACLES[f.__name__] = sql(views, twin) if views else twin
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits, and no negative zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


from . import alleles, annotation, cohort, copynumber, frequencies, populations, regions, scores, selections, sources, statistics  # noqa: E402, F401  (they register their queries)

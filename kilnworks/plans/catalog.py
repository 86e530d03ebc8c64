"""Registry of the library's queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnworks.session import configure
from kilnworks.sources.oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def steady_round(c, digits: int):
    """Round with ties decided a little early, so both engines decide them alike."""
    scaled = c * F.lit(10.0 ** digits) + F.lit(0.50001)
    return F.when(F.abs(c) < 1e12, F.floor(scaled) / F.lit(10.0 ** digits)).otherwise(c)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output types: rounded doubles, bigint counts, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = steady_round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None, digits: int = 6):
    """Register a query under its inventory id, with its SQL where one exists.

    The SQL may name the shared proxy views; their definitions are put in front.
    """
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return tidy(fn(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap

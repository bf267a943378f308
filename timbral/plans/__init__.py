"""The engine's named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, roundtrips
from .catalogue import QUERIES, views
from .dialect import Duck, Spark

TABLES = ("events", "documents", "embeddings", "pages")


def _run(spark: SparkSession, sf_dir: str, build: Callable) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = views(Spark) + build(Spark)
    for t in TABLES:
        text = text.replace(f" from {t}", f" from {{{t}}}").replace(f" join {t} ", f" join {{{t}}} ")
    return spark.sql(text, **tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: _run(spark, sf_dir, f)) for name, f in QUERIES.items()} | roundtrips.QUERIES | exact.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: views(Duck) + f(Duck) for name, f in QUERIES.items()} | roundtrips.SQL | exact.SQL

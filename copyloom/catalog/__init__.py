"""The registered queries: each runs an operator over whole driver tables, most with an equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver tables of one folder, read on access."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of `Tables` under its name, with its SQL if there is one."""

    def add(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder))

        run.__doc__ = function.__doc__
        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


# White space of any kind, for the SQL side.
WS = r"[\s\p{Z}\x{FEFF}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_parts(x: str, split: str) -> str:
    """Split by a regular expression, strip, drop blanks."""
    return (
        f"list_filter(list_transform(string_split_regex({x}, '{split}'), lambda v: {sql_strip('v')}),"
        f" lambda v: v <> '')"
    )


def sql_domain(x: str) -> str:
    full = f"CASE WHEN starts_with({x}, 'http') THEN {x} ELSE 'https://' || {x} END"
    return rf"lower(regexp_extract({full}, '^https?://(?:[^/?#]*@)?([^/:?#\s]+)(?:[/:?#]|$)', 1))"


from copyloom.catalog import copies, links, requests, texts, whole  # noqa: E402,F401

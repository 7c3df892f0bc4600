"""Registry of queries: name to callable, and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL text of the scalars in lectern.functions.text, for the oracles.
WS = r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_normalize(x: str) -> str:
    x = rf"regexp_replace(replace(coalesce({x}, ''), chr(160), ' '), '[ \t\r\f\x0b]+', ' ', 'g')"
    return sql_strip(rf"regexp_replace({x}, '{WS}*\n{WS}*', chr(10), 'g')")


def sql_collapse(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def sql_tags(x: str) -> str:
    return sql_collapse(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")


def sql_host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def sql_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'))::BIGINT"


from lectern.plans import article_queries, identifier_queries, markup_queries, merge_queries, ordered_queries, outcome_queries, page_queries, report_queries, text_queries  # noqa: E402, F401

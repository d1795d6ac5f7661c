"""Domain tables derived from the tables of a data folder.

A view is one SELECT that Spark and DuckDB both read; the few spellings that differ are macros. Queries read
views through ``view``; their SQL begins with ``ctes``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

REF = "2001-08-01"
SUPPORT_REF = "2024-01-31"
BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_SPARK = {
    "days": lambda a, b: f"datediff({b}, {a})",
    "text": lambda d, f: f"date_format({d}, '{f}')",
    "day": lambda t: f"to_date({t})",
    "since": lambda t: f"datediff(to_date({t}), DATE '2024-01-01')",
}
_DUCK_FORMAT = {"yyyy-MM-dd": "%Y-%m-%d", "yyyy/MM/dd": "%Y/%m/%d", "MM/dd/yyyy": "%m/%d/%Y", "dd MMM yyyy": "%d %b %Y"}
_DUCK = {
    "days": lambda a, b: f"date_diff('day', {a}, {b})",
    "text": lambda d, f: f"strftime({d}, '{_DUCK_FORMAT[f]}')",
    "day": lambda t: f"CAST({t} AS DATE)",
    "since": lambda t: f"date_diff('day', DATE '2024-01-01', CAST({t} AS DATE))",
}

#: name -> (tables and views it reads, SELECT). Macros: @days(a; b), @text(d; format), @day(t),
#: @since(t) (days since 2024 began).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sources: str, sql: str) -> None:
    VIEWS[name] = tuple(sources.split()), sql


def _expand(sql: str, macros: dict) -> str:
    def call(m: re.Match) -> str:
        return macros[m[1]](*(x.strip() for x in m[2].split(";")))

    return re.sub(r"@(\w+)\(([^()]*)\)", call, sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table or view as a DataFrame; lazily composed, nothing is registered."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources, sql = VIEWS[name]
    frames = {s: view(spark, sf_dir, s) for s in sources}
    sql = _expand(sql, _SPARK).replace("{", "{{").replace("}", "}}")
    for s in sources:
        sql = re.sub(rf"\b(FROM|JOIN) {s}\b", rf"\1 {{{s}}}", sql)
    return spark.sql(sql, **frames)


def ctes(*names: str) -> str:
    """``WITH ...`` of the views, with what they read, for DuckDB."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in BASE or name in ordered:
            return
        for s in VIEWS[name][0]:
            add(s)
        ordered.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_expand(VIEWS[n][1], _DUCK)})" for n in ordered)


define(
    "account_history",
    "customer orders",
    """SELECT c_custkey, c_nationkey, c_mktsegment, CAST(floor(c_acctbal) AS BIGINT) AS balance,
              n, first_day, last_day,
              CASE WHEN @days(last_day; DATE '2001-08-01') > 180 THEN 1 ELSE 0 END AS churned
       FROM customer LEFT JOIN (
         SELECT o_custkey, count(*) AS n, min(@day(o_orderdate)) AS first_day, max(@day(o_orderdate)) AS last_day
         FROM orders GROUP BY o_custkey) h ON c_custkey = o_custkey""",
)
define(
    "raw_accounts",
    "account_history",
    """SELECT c_custkey AS _row_id,
              CASE WHEN c_custkey % 97 = 13 THEN ' ' WHEN c_custkey % 50 = 49
                   THEN 'CUST-' || CAST(c_custkey - 1 AS STRING) ELSE ' CUST-' || CAST(c_custkey AS STRING) END AS customer_id,
              CASE WHEN c_custkey % 101 = 7 THEN '2002-01-01' WHEN c_custkey % 4 = 0 THEN @text(first_day; yyyy-MM-dd)
                   WHEN c_custkey % 4 = 1 THEN @text(first_day; yyyy/MM/dd) WHEN c_custkey % 4 = 2
                   THEN @text(first_day; MM/dd/yyyy) ELSE @text(first_day; dd MMM yyyy) END AS observation_start,
              CASE WHEN c_custkey % 103 = 9 THEN '2001-12-24' WHEN churned = 1
                   THEN @text(last_day; yyyy-MM-dd) || 'T10:00:00Z' END AS observation_end,
              CASE WHEN c_custkey % 89 = 5 THEN 'mystery' WHEN c_custkey % 83 = 6 THEN CAST(churned AS STRING)
                   WHEN churned = 1 THEN CASE c_custkey % 3 WHEN 0 THEN 'Churned' WHEN 1 THEN ' canceled ' ELSE 'YES' END
                   ELSE CASE c_custkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'current' ELSE 'no' END END AS event_observed,
              CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE c_mktsegment END AS plan_tier,
              CASE WHEN c_custkey % 13 = 4 THEN '' WHEN c_custkey % 211 = 20 THEN 'n/a'
                   ELSE CASE c_nationkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '12' ELSE '24' END END AS contract_length_months,
              CASE WHEN n >= 10 THEN '1,' || substr(CAST(1000 + n * 17 AS STRING), 2, 3) ELSE CAST(n AS STRING) END AS usage_frequency,
              'region ' || CAST(c_nationkey % 5 AS STRING) AS region,
              CASE WHEN c_custkey % 6 = 2 THEN NULL ELSE CAST(balance AS STRING) END AS balance,
              CASE WHEN churned = 1 THEN 'left in ' || substr(@text(last_day; yyyy-MM-dd), 1, 4) END AS exit_reason
       FROM account_history""",
)

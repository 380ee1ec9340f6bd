"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Register ``f(t)``; t reads a table by attribute: ``t.documents``."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


class Tables:
    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table):
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

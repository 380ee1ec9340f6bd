"""Shared plumbing of the training-data operators: shared-folder tables, gapless ranks, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..storage import materialize, shared_dir, tidy  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c):
    """Lower-case A-Z only. All-ASCII texts take the fast path; others keep their non-ASCII letters."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def gapless_rank(df: DataFrame, keys: list[str], order: str, n_rows: int, out: str = "rank", tier=None) -> DataFrame:
    """Number the rows of each key from 0 without gaps and without gathering a key in one task.

    Rows are dealt by (key, hash bucket); a key's rank is the bucket's running start plus the
    row number within the bucket. ``order`` must be unique. ``tier``: a small number; rows of a lower
    one are numbered before the others of their key.
    """
    n = max(16, n_rows // 4000)
    bucket = F.pmod(F.xxhash64(order, F.lit(17)), F.lit(n))  # a hash of its own, in case the key is a hash of the row
    if tier is not None:
        bucket = bucket + tier * F.lit(n)
    x = df.withColumn("_bucket", bucket)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = x.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    y = x.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(order)))
    return y.join(starts, [*keys, "_bucket"]).withColumn(out, F.col("_start") + F.col("_row") - 1).drop("_bucket", "_row", "_start")


HOT = 2000


def split_join(df: DataFrame, counted: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """``df`` inner-joined on ``keys`` with ``counted`` (one row a key, column ``k``: its rows in ``df``), hot keys apart.

    Keys with more than one in HOT of the ``n_rows`` rows of ``df`` are fewer than HOT by count, so they are broadcast and
    their rows stay where they are; the rest is shuffled, and no key of it has more rows than that.
    """
    least = n_rows // HOT
    hot = F.broadcast(materialize(counted.where(F.col("k") > least), "hot"))
    rest = df.join(hot.select(*keys), keys, "left_anti").join(counted.where(F.col("k") <= least), keys)
    return df.join(hot, keys).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table as (node, component), component = smallest node.

    Each round maps every node to its smallest neighbour's smallest neighbour and contracts the
    edges by that map; the map keeps components apart and keeps each smallest node, so rounds end
    when no edge is left. Only joins and minima are used: no hub is gathered in one task.
    """
    def tidy(df):
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    e = materialize(tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    label = None
    while True:
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).select(F.col("a").alias("v"), "p"), "parents")
        jumped = parent.join(parent.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))
        jumped = materialize(jumped, "jumped")
        to_a, to_b = jumped.select(F.col("v").alias("a"), F.col("p").alias("pa")), jumped.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        e = materialize(tidy(e.join(to_a, "a").join(to_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
        if label is None:
            label = jumped.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            step = jumped.select(F.col("v").alias("component"), F.col("p").alias("_next"))
            label = label.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
        label = materialize(label, "labels")
    if label is None:
        label = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label

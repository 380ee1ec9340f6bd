"""Exact chunk dedup and semantic near-duplicate bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..storage import materialize, scratch

MIN_CHARS, ERROR, REVIEW, BLOCK = 400, 0.90, 0.80, 4096
#: Rows of a block that meet another block at a time.
STRIP = 512


def dedup_losers(chunks: DataFrame, page: str = "page", order: str = "chunk_index", text: str = "raw_text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(page, order column, hash, keeper): chunks whose normalised text a better chunk holds.

    The keeper comes from the page with fewest chunks, then by page and order. The group's size never meets
    in one task: the keeper is a minimum, and the losers are found by a join with it.
    """
    x = chunks.select(F.col(page).alias("page"), F.col(order).alias("at"), T.dedup_key(F.col(text)).alias("k"))
    per = x.groupBy("page").agg(F.count("*").alias("per_page"))
    x = materialize(x.where(F.length("k") >= min_chars).select("page", "at", F.sha1("k").alias("hash")).join(per, "page"), "keys", keep=True)
    place = F.struct("per_page", "page", "at")
    best = x.groupBy("hash").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    y = x.join(best, "hash").where(place != F.col("keeper"))
    return y.select("page", F.col("at").alias(order), "hash", F.col("keeper.page").alias("keeper_page"), F.col("keeper.at").alias(f"keeper_{order}"))


def dedup_report(losers: DataFrame, top: int = 8) -> DataFrame:
    """Pages with most losers."""
    return losers.groupBy("page").agg(F.count("*").alias("losers")).orderBy(F.desc("losers"), "page").limit(top)


def similar_pairs(vectors: DataFrame, key: str = "key", vector: str = "vector", review: float = REVIEW, error: float = ERROR, block: int = BLOCK) -> DataFrame:
    """Exact all-pairs cosine at or above ``review``: (a, b, similarity, band).

    Rows are dealt into about n / block blocks, which are written once; every two blocks meet once as matrices, and
    tasks read the two from the shared folder. That is quadratic in work, as the question is, but no row is copied
    or shuffled again, and no task holds more than two blocks. Vectors of other lengths are not compared; rows with
    a null id are in no pair.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    n = max(1, -(-x.count() // block))
    root = scratch(spark, "blocks")
    x.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartition("block").write.partitionBy("block").parquet(root)
    kind = dict(x.dtypes)["id"]
    arrow = to_arrow_type(x.schema["id"].dataType)
    first = np.cumsum([0, *range(n, 1, -1)])  # the number of the first pair of each block

    def load(b):
        """Per length of vectors: ids and unit vectors of a block."""
        from pyarrow import dataset, fs

        files, top = fs.FileSystem.from_uri(root)
        if files.get_file_info(f"{top}/block={b}").type == fs.FileType.NotFound:
            return {}
        table = dataset.dataset(f"{top}/block={b}", filesystem=files, format="parquet").to_table(columns=["id", "v"]).combine_chunks()
        ids = np.array(table["id"].to_pylist(), None if pa.types.is_integer(arrow) else object)
        sizes, out = np.asarray(pc.list_value_length(table["v"])), {}
        for size in np.unique(sizes).tolist():
            flat = pc.list_flatten(table["v"].filter(pa.array(sizes == size))).combine_chunks()
            m = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape((sizes == size).sum(), size)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            out[size] = ids[sizes == size], np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        return out

    def compare(batches):
        at, left = None, {}
        for batch in batches:
            for pair in batch.column(0).to_pylist():
                i = int(np.searchsorted(first, pair, "right")) - 1
                j = i + pair - int(first[i])
                if at != i:
                    at, left = i, load(i)
                right = left if i == j else load(j)
                for size in left.keys() & right.keys():
                    (ids, m), (others, w) = left[size], right[size]
                    for k in range(0, len(ids), STRIP):
                        s = m[k : k + STRIP] @ w.T
                        p, q = np.nonzero(s >= review)
                        a, b, s = ids[p + k], others[q], s[p, q]
                        keep = (a < b) | ((a > b) & (i != j))
                        keep = keep.astype(bool)
                        a, b, s = a[keep], b[keep], s[keep]
                        low = (a < b).astype(bool)
                        yield pa.RecordBatch.from_arrays([pa.array(np.where(low, a, b).tolist(), arrow), pa.array(np.where(low, b, a).tolist(), arrow), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    meetings = n * (n + 1) // 2
    pairs = spark.range(0, meetings, 1, min(meetings, max(meetings // 8, 4 * spark.sparkContext.defaultParallelism)))
    pairs = pairs.mapInArrow(compare, f"a {kind}, b {kind}, similarity double").withColumn("similarity", F.round("similarity", 6))
    return pairs.withColumn("band", F.when(F.col("similarity") >= error, "error").otherwise("review"))

"""Sinks: chunk store, index snapshot, manifests, caches, stubs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.chunking import changed_chunks, stale_chunks
from ..operators.retrieval import Index, build_index, word_postings
from ..storage import materialize

KEY = ["page_address", "chunk_index"]


def chunk_store(new: DataFrame, old: DataFrame) -> DataFrame:
    """The chunk table after a run: changed chunks replace stored ones, those past a page's end go, the rest stay as they were."""
    gone = stale_chunks(new, old).select(*KEY).unionByName(changed_chunks(new, old).select(*KEY))
    return old.join(gone, KEY, "left_anti").unionByName(changed_chunks(new, old))


def write_index(index: Index, path: str, names: tuple = ("postings", "chunks", "terms", "stats")) -> None:
    """Four Parquet tables. Readers open a path, so a new index is written beside the old one and then named."""
    for name in names:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> Index:
    """The index written to ``path``. Without a table of postings, the words hold them."""
    postings, chunks, terms, stats = (f"{path}/{n}" for n in ("postings", "chunks", "terms", "stats"))
    found = spark.read.parquet(postings) if _written(spark, postings) else word_postings(spark.read.parquet(f"{path}/words"))
    return Index(found, *map(spark.read.parquet, (chunks, terms, stats)))


def _written(spark: SparkSession, table: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole index versions below a path, oldest first: those whose last table is written."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(top)]
    return sorted(v for v in found if v.startswith("v") and _written(spark, f"{path}/{v}/stats"))


def ensure_index(spark: SparkSession, path: str, chunks: DataFrame | None, newest: float, **columns: str) -> tuple[str, Index | None]:
    """(status, index) of the index kept below ``path``: 'ok', 'rebuilt+ok', or 'unavailable' with no index.

    ``newest`` is the time, in seconds, of the latest change to what is indexed; an index from before it, or none, is
    built anew from ``chunks`` beside the old versions, which readers may still hold. ``columns`` go to ``build_index``.
    """
    import time

    have = _versions(spark, path)
    if have and int(have[-1][1:]) / 1e6 >= newest:
        return "ok", read_index(spark, f"{path}/{have[-1]}")
    if chunks is None:
        return "unavailable", None
    version = f"v{time.time_ns() // 1000:020d}"
    write_index(build_index(chunks, **columns, at=f"{path}/{version}"), f"{path}/{version}", ("terms", "stats"))
    return "rebuilt+ok", read_index(spark, f"{path}/{version}")


def write_manifest(losers: DataFrame, path: str) -> None:
    """Ids that the index leaves out, sorted and distinct."""
    losers.select("chunk_id").distinct().orderBy("chunk_id").write.mode("overwrite").json(path)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(model, body_hash) without a stored vector."""
    return wanted.select("model", "body_hash").distinct().join(cache.select("model", "body_hash"), ["model", "body_hash"], "left_anti")


def merge_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The vector cache with new rows; a new vector replaces an old one."""
    return cache.join(fresh.select("model", "body_hash"), ["model", "body_hash"], "left_anti").unionByName(fresh)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (path, text) as a table by first folder."""
    pages.withColumn("folder", F.substring_index("path", "/", 1)).write.mode("overwrite").partitionBy("folder").parquet(path)


def report(df: DataFrame, title: str, *order: str) -> DataFrame:
    """One row, text: a small result as a Markdown table. Meant for top-k results, which one row can hold."""
    cols = df.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), F.lit(" |"))
    rows = df.select(F.struct(*order).alias("o"), line.alias("line")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("o", "line")))["line"], "\n").alias("rows"))
    head = f"# {title}\n\n| {' | '.join(cols)} |\n|{'---|' * len(cols)}\n"
    return rows.select(F.concat(F.lit(head), "rows", F.lit("\n")).alias("text"))


def write_conversion(converted: DataFrame, root: str) -> DataFrame:
    """Write a batch conversion (``files.convert_files``) below ``root`` and return (path, target, bytes) of the files written.

    Every converted text becomes ``<its path>.md`` in a tree like the source's. Beside it stand JSON lines: ``_done``
    (path, target), ``_flags`` (path, type, detail), ``_errors`` (path, error) and ``_skipped`` (path, route). Files are written by the
    tasks through the folder's own file system; a task that runs again writes the same files again.
    """
    converted = materialize(converted, "converted", keep=True)

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(root)
        for b in batches:
            sizes = []
            for target, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                content = text.encode()
                files.create_dir(f"{top}/{target}".rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{top}/{target}") as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["path", "target", "bytes"])

    target = F.when(F.lower("path").endswith(".md"), F.col("path")).otherwise(F.concat("path", F.lit(".md")))
    written = converted.where("text is not null").select("path", target.alias("target"), "text")
    done = materialize(written.mapInArrow(put, "path string, target string, bytes long"), "done", keep=True)
    done.select("path", "target").write.mode("overwrite").json(f"{root}/_done")
    converted.select("path", F.explode("flags").alias("f")).select("path", "f.*").write.mode("overwrite").json(f"{root}/_flags")
    converted.where("error is not null").select("path", "error").write.mode("overwrite").json(f"{root}/_errors")
    converted.where("text is null and error is null").select("path", "route").write.mode("overwrite").json(f"{root}/_skipped")
    return done


def conversion_status(converted: DataFrame) -> DataFrame:
    """(route, files, flagged, failed) of a conversion run."""
    return converted.groupBy("route").agg(F.count("*").alias("files"), F.count_if(F.size("flags") > 0).alias("flagged"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def read_document(docs: DataFrame, path: str, offset: int = 0, length: int = 20_000) -> DataFrame:
    """A stretch of one document, as the service wrapper reads it; paths outside the collection give no row."""
    from ..functions.text import confined

    return docs.where((F.col("path") == path) & confined(F.col("path"))).select("path", F.expr(f"substring(body, {offset + 1}, {length})").alias("text"), F.length("body").alias("total"))


def clamp_top(k: int) -> int:
    return max(1, min(20, k))

"""Chunking: paragraph folds, oversized splits, addresses and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

TARGET, OVERLAP, LIMIT = 2000, 200, 4000
PARAGRAPH = r"\n\s*\n"


def chunk_body(body: Column, target: int = TARGET, overlap: int = OVERLAP, paragraph: str = PARAGRAPH) -> Column:
    """Chunks of whole paragraphs that reach ``target``; each next one opens with the tail of the last.

    A tail with nothing after it is still a chunk, as is a short body; a blank body has none.
    """
    parts = F.filter(F.transform(F.split(body, paragraph), T.strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("size"))

    def add(a, p):
        cur = F.when(a["cur"].isNull(), p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p))
        full = a["size"] + F.length(p) + 2 >= target
        tail = F.substring(cur, -overlap, overlap) if overlap else F.lit(None).cast("string")
        return F.struct(
            F.when(full, F.array_append(a["out"], cur)).otherwise(a["out"]).alias("out"),
            F.when(full, tail).otherwise(cur).alias("cur"),
            F.when(full, F.coalesce(F.length(tail), F.lit(0))).otherwise(a["size"] + F.length(p) + 2).alias("size"),
        )

    def end(a):
        rest = F.coalesce(T.strip(a["cur"]), F.lit("")) != ""
        return F.when(rest, F.array_append(a["out"], a["cur"])).otherwise(a["out"])

    return F.aggregate(parts, start, add, end)


def split_oversized(chunks: Column, limit: int = LIMIT) -> Column:
    """Chunks over ``limit`` in runs of sentences; a longer sentence is cut hard."""
    def add(a, p):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))
        held = F.when(a["buf"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["buf"]))
        long, fits = F.length(p) > limit, F.length(a["buf"]) + 1 + F.length(p) <= limit
        return F.struct(
            F.when(T.strip(p) == "", a["out"]).when(long, F.concat(held, cut)).when(a["buf"].isNull() | fits, a["out"]).otherwise(held).alias("out"),
            F.when(T.strip(p) == "", a["buf"]).when(long, F.lit(None).cast("string")).when(a["buf"].isNotNull() & fits, F.concat(a["buf"], F.lit(" "), p)).otherwise(p).alias("buf"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("buf"))
    end = lambda a: F.when(a["buf"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["buf"]))
    return F.flatten(F.transform(chunks, lambda c: F.when(F.length(c) <= limit, F.array(c)).otherwise(F.aggregate(F.split(c, T.SENTENCE_END), start, add, end))))


def tier(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """Tier label of a path: none at the root, an override for its top folder, the number after 'tier', else a slug."""
    rel = F.replace(path, F.lit("\\"), F.lit("/"))
    top = F.substring_index(rel, "/", 1)
    number = F.regexp_extract(top, r"(?i)tier\s*(\d+)", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(top), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    out = F.when(F.instr(rel, "/") == 0, "")
    for folder, label in (overrides or {}).items():
        out = out.when(F.lower(top) == folder.lower(), label)
    return out.when(number != "", number).otherwise(slug)


def corpus_chunks(docs: DataFrame, path: str = "path", title: str = "title", folder: str = "folder", body: str = "body", paragraph: str = PARAGRAPH, target: int = TARGET, overlap: int = OVERLAP, limit: int = LIMIT, overrides: dict[str, str] | None = None) -> DataFrame:
    """Chunk table of the corpus tier: one row per chunk, keyed by (page_address, chunk_index)."""
    clean = T.normalize_filler(F.col(body))
    x = docs.select(F.col(path).alias("page_path"), F.col(title).alias("_title"), F.col(folder).alias("_folder"), clean.alias("_body"))
    x = x.withColumn("_prefix", T.source_prefix(F.col("_title"), F.col("_folder"), F.col("_body")))
    x = x.select("page_path", "_prefix", T.sha256_tag(F.col("_body")).alias("page_body_hash"), tier(F.col("page_path"), overrides).alias("tier"),
                 F.posexplode(split_oversized(chunk_body(F.col("_body"), target, overlap, paragraph), limit)).alias("chunk_index", "raw_text"))
    context = F.concat(F.col("_prefix"), F.lit("\n\n"), F.col("raw_text"))
    return x.select(
        F.lit(1).alias("schema_version"), "page_path", T.source_address(F.col("page_path")).alias("page_address"), F.col("chunk_index").cast("long").alias("chunk_index"), "raw_text",
        context.alias("contextualized_text"), F.col("_prefix").alias("prefix"), F.lit("synthetic").alias("prefix_source"), F.length("raw_text").cast("long").alias("char_count"),
        T.sha256_tag(F.col("raw_text")).alias("body_hash"), "page_body_hash", "tier")


def chunk_id(df: DataFrame) -> Column:
    return F.concat_ws(":", df["page_address"], df["chunk_index"].cast("string"))


def changed_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """Chunks to write: those whose hashes are not stored already."""
    return new.join(old.select("page_address", "chunk_index", "body_hash", "page_body_hash"), ["page_address", "chunk_index", "body_hash", "page_body_hash"], "left_anti").select(*new.columns)


def stale_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """Stored chunks past the last one that a rewritten page now has."""
    last = new.groupBy("page_address").agg(F.max("chunk_index").alias("_last"))
    return old.join(last, "page_address").where(F.col("chunk_index") > F.col("_last")).select(*old.columns)

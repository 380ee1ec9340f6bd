"""Benchmark decontamination with a broadcast hash set of test n-grams, in DataFrame functions only.

Every window of a benchmark item is a run of at most ``N`` words. A document's word windows are
scanned through one short gram in every stride, which no occurrence can avoid; the documents that
hit a gram of the set are then verified window by window, as words, not hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, materialize, tidy

N, GRAM = 10, 3
#: Up to so many grams the set is a hash set in the plan; up to BROADCAST_LIMIT (8 bytes each) it is broadcast as a table; beyond, it is joined by shuffle.
SET_LIMIT, BROADCAST_LIMIT = 50_000, 2_000_000
#: Up to so many windows their texts are broadcast.
WINDOW_LIMIT = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item_id, m, w): the windows of each item, each a string of m words."""
    x = benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    x = x.withColumn("m", F.least(F.size("words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)
    return x.select("item_id", "m", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("m")), " "))).alias("w")).distinct()


def gram_hashes(words: Column, starts: Column, g: int) -> Column:
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(g)]))


def windows_of(m: int) -> Column:
    """All runs of m words as (at, m, w)."""
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.struct((i - 1).alias("at"), F.lit(m).alias("m"), F.array_join(F.slice("words", i, m), " ").alias("w")))
    none = "array<struct<at:int,m:int,w:string>>"
    return F.coalesce(F.when(F.size("words") >= m, runs).cast(none), F.array().cast(none))


def scan(docs: DataFrame, windows: DataFrame, gram: int = GRAM) -> DataFrame:
    """(_row, doc_id, n_words, words), written: words only for documents that hold a gram of some window, else null."""
    x = docs.select(F.col("doc_id"), words_of(F.col("text").cast("string")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    sizes = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most N rows
    probes, sets = [], []
    for m in sizes:
        g = min(gram, m)
        stride = m - g + 1
        ws = F.split("w", " ")
        sets.append(windows.where(F.col("m") == m).select(F.explode(gram_hashes(ws, F.sequence(F.lit(0), F.lit(m - g)), g)).alias("h")))
        starts = F.when(F.col("n_words") >= m, F.sequence(F.lit(0), (F.col("n_words") - g).cast("int"), F.lit(stride)))
        probes.append(F.coalesce(gram_hashes(F.col("words"), starts, g), F.array().cast("array<bigint>")))
    row = F.monotonically_increasing_id().alias("_row")
    if not sizes:
        return materialize(x.select(row, "doc_id", "n_words", F.lit(None).cast("array<string>").alias("words")), "scanned", keep=True)
    grams = materialize(reduce(DataFrame.unionByName, sets).distinct(), "grams")
    n = grams.count()
    if n <= SET_LIMIT:
        found = [r["h"] for r in grams.collect()]
        hit = reduce(lambda a, b: a | b, [F.exists(p, lambda h: h.isin(*found)) for p in probes])
        return materialize(x.select(row, "doc_id", "n_words", F.when(hit, F.col("words")).alias("words")), "scanned", keep=True)
    x = materialize(x.select(row, "doc_id", "n_words", "words"), "words")
    tried = x.select("_row", F.explode(F.concat(*probes)).alias("h"))
    some = tried.join(F.broadcast(grams) if n <= BROADCAST_LIMIT else grams, "h", "left_semi").select("_row").distinct().withColumn("hit", F.lit(True))
    return materialize(x.join(some, "_row", "left").select("_row", "doc_id", "n_words", F.when(F.col("hit"), F.col("words")).alias("words")), "scanned", keep=True)


@tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words (positions from 0).

    A null or empty text has no words and is clean. An empty benchmark leaves all clean. Repeated
    items count each by its own item_id, rows of one item_id as one item, a null item_id as none.
    Rows are documents of their own, whatever their doc_id; there are no ties; other columns are ignored.
    """
    windows = materialize(item_windows(benchmark, n), "windows")
    base = scan(docs, windows)
    sizes = [r["m"] for r in windows.select("m").distinct().collect()]
    seen = base.where("words is not null")
    runs = seen.select("_row", F.explode(F.concat(F.array().cast("array<struct<at:int,m:int,w:string>>"), *map(windows_of, sizes))).alias("r")).select("_row", "r.at", "r.m", "r.w")
    known = windows.select("item_id", "w", "m")
    if windows.count() <= WINDOW_LIMIT:
        known = F.broadcast(known)
    hits = materialize(runs.join(known, ["m", "w"]).select("_row", "at", "m", "item_id"), "hits", keep=True)
    items = hits.select("_row", "item_id").distinct().groupBy("_row").agg(
        F.count("item_id").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    spots = hits.select("_row", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("at")).distinct()
    spots = spots.groupBy("_row").agg(F.count("*").alias("n_hit"), F.array_sort(F.collect_list("at")).alias("hit_words"))
    y = base.select("_row", "doc_id", "n_words").join(spots, "_row", "left").join(items, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return y.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "hit_words")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
  FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, i AS pos, m, array_to_string(ws[i : i + m - 1], ' ') AS w FROM d, ms, unnest(range(1, len(ws) - m + 2)) AS t(i)),
hits AS (SELECT doc_id, pos, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.w = bw.w),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(pos, pos + m)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""

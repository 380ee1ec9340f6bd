"""Conversion fidelity: vocabulary recall, text recovery, numbering checks and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import text as T

FLOOR, REPLACE, MIN_WORDS, LOW_TEXT = 0.97, 0.70, 50, 200
SECTION = r"\A(\d+)\.\s+\*{0,2}\S"
SUBITEM = r"\A\s*[-*]\s+(\d+)\.(\d+)\."
COMPOSITE = r"\A(\s+[-*]\s+)(\d+)((?:\.\d+)+)\.(\s)"


def recall(original: Column, converted: Column) -> Column:
    """Share of the original's words that the conversion holds; null below MIN_WORDS words."""
    words = T.vocabulary(original)
    return F.when(F.size(words) >= MIN_WORDS, F.size(F.array_intersect(words, T.vocabulary(converted))) / F.size(words))


def recall_audit(pairs: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(key, vocabulary, recall, flagged) of pairs (key, original, converted); null recall: too few words to tell."""
    x = pairs.select("key", F.size(T.vocabulary(F.col("original"))).cast("long").alias("vocabulary"), F.round(recall(F.col("original"), F.col("converted")), 6).alias("recall"))
    return x.withColumn("flagged", F.coalesce(F.col("recall") < floor, F.lit(False)))


def blocks(raw: Column) -> Column:
    """Paragraphs of a text layer, each on one line."""
    parts = F.split(F.replace(raw, F.lit("\f"), F.lit("\n\n")), r"\n\s*\n")
    joined = F.transform(parts, lambda p: F.array_join(F.filter(F.transform(F.split(p, r"\r\n|\n|\r"), T.strip), lambda s: s != ""), " "))
    return F.filter(joined, lambda p: p != "")


def recover(pairs: DataFrame) -> DataFrame:
    """(key, mode, text): 'replaced' below REPLACE, 'appended' with the blocks that are mostly gone, else null and unchanged."""
    x = pairs.select("key", "converted", blocks(F.col("original")).alias("blocks"), T.vocabulary(F.col("converted")).alias("have"), T.vocabulary(F.col("original")).alias("want"))
    gone = lambda b: F.size(F.array_except(T.vocabulary(b), F.col("have")))
    missing = F.filter("blocks", lambda b: (gone(b) >= 3) & (F.try_divide(gone(b), F.size(T.vocabulary(b))) > 0.4))
    x = x.withColumn("missing", missing).withColumn("share", F.try_divide(F.size(F.array_intersect("want", "have")), F.size("want")))
    low = (F.size("blocks") > 0) & (F.col("share") < REPLACE)
    some = F.size("missing") > 0
    mode = F.when(low, "replaced").when(some, "appended")
    added = F.concat(F.rtrim("converted"), F.lit("\n\n## Text recovered from the PDF text layer\n\n"), F.array_join("missing", "\n\n"), F.lit("\n"))
    return x.select("key", mode.alias("mode"), F.when(low, F.array_join("blocks", "\n\n")).when(some, added).otherwise(F.col("converted")).alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("key", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))


def _carry(value: Column) -> Column:
    return F.last(value, True).over(W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))


def sections(docs: DataFrame) -> DataFrame:
    """(key, pos, line, section): each line's enclosing top-level number."""
    return _lines(docs).withColumn("section", _carry(F.nullif(F.regexp_extract("line", SECTION, 1), F.lit(""))))


def check_numbering(docs: DataFrame) -> DataFrame:
    """(key, matches, mismatches, resets): bulleted sub-numbers against their section, and restarts of the section count."""
    x = sections(docs)
    top, sub = F.col("line").rlike(SECTION), F.regexp_extract("line", SUBITEM, 1)
    x = x.withColumn("top", F.when(top, F.regexp_extract("line", SECTION, 1).try_cast("long"))).withColumn("sub", F.when(~top & (sub != "") & F.col("section").isNotNull(), sub))
    before = F.last("top", True).over(W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("reset", F.coalesce(F.col("top") <= before, F.lit(False)))
    return x.groupBy("key").agg(F.count_if(F.col("sub") == F.col("section")).alias("matches"), F.count_if(F.col("sub") != F.col("section")).alias("mismatches"), F.count_if("reset").alias("resets"))


def numbering_flags(docs: DataFrame) -> DataFrame:
    """(key, mismatches, total): hierarchical numbers, bulleted or not, that disagree with the last top-level number."""
    bare = F.regexp_replace(T.strip(F.col("line")), r"\A[-*] ", "")
    sub, top = F.regexp_extract(bare, r"\A(\d+)(?:\.\d+)+[.)]?\s", 1), F.regexp_extract(bare, r"\A(\d+)[.)]\s", 1)
    x = _lines(docs).withColumn("sub", sub.try_cast("long")).withColumn("top", F.when(sub == "", top.try_cast("long")))
    x = x.withColumn("section", _carry(F.col("top")))
    return x.groupBy("key").agg(F.count_if(F.col("sub") != F.col("section")).alias("mismatches"), F.count("sub").alias("total"))


def fix_numbering(docs: DataFrame, mode: str, only: list[int] | None = None) -> DataFrame:
    """(key, pos, line, fixed, changed): composite numbers set to their section, dropped, or stripped to the last ordinal.

    mode: 'section', 'drop' or 'strip'. ``only``: line numbers from 1 that may change.
    """
    line = F.col("line")
    x = sections(docs)
    if mode == "section":
        rest = F.concat(F.regexp_extract(line, COMPOSITE, 1), "section", F.regexp_replace(line, r"\A\s+[-*]\s+\d+", ""))
        fixed = F.when(line.rlike(COMPOSITE) & ~line.rlike(SECTION) & F.col("section").isNotNull() & (F.regexp_extract(line, COMPOSITE, 2) != F.col("section")), rest).otherwise(line)
    elif mode == "drop":
        fixed = F.regexp_replace(line, COMPOSITE, "$1")
    elif mode == "strip":
        fixed = F.regexp_replace(line, r"\A(\s+)[-*]\s+(\d+)\.(\d+)\.(\s)", "$1$3.$4")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if only is not None:
        fixed = F.when((F.col("pos") + 1).isin(*only), fixed).otherwise(line)
    return x.select("key", "pos", "line", fixed.alias("fixed"), (fixed != line).alias("changed"))


def low_text(docs: DataFrame, limit: int = LOW_TEXT) -> DataFrame:
    """(key, visible): documents with fewer visible characters than ``limit``."""
    return docs.select("key", T.visible_length(F.col("text")).cast("long").alias("visible")).where(F.col("visible") < limit)

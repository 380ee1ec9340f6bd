"""Transcripts: parse, flag, merge, profile and render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import text as T

RUN, GAP, CHARS = 3, 10, 1500
STAMP = r"(?:\d{1,2}:)?\d{1,2}:\d{2}"
SEGMENT = rf"\A\[({STAMP})\s*-\s*({STAMP})\]\s*(?:([^:\n]{{1,40}}?):(?:\s|\z))?(.*)\z"
#: Phrases that speech recognition makes up in silence.
PHRASES = (
    "thank you for watching", "thanks for watching", "see you in the next video", "don't forget to subscribe", "please subscribe", "subscribe to the channel", "subtitles by", "subtitled by", "www.mooji.org",
    "ご視聴ありがとうございました", "チャンネル登録", "시청해 주셔서 감사합니다", "구독과 좋아요", "다음 영상에서 만나요", "gracias por ver", "no olvides suscribirte",
)


def lines(files: DataFrame) -> DataFrame:
    """(file, pos, line, segment_no) of files (file, raw); segment_no counts the time stamps so far, 0 before the first."""
    x = files.select("file", F.posexplode(F.split("raw", r"\r\n|\n|\r")).alias("pos", "line"))
    is_segment = F.col("line").rlike(SEGMENT).cast("int")
    return x.withColumn("segment_no", F.sum(is_segment).over(W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))


def parse_segments(files: DataFrame) -> DataFrame:
    """(file, pos, start, end, speaker, text): time-stamped segments with the lines that follow them."""
    x = lines(files).where("segment_no > 0")
    first = F.col("line").rlike(SEGMENT)
    part = lambda k: F.regexp_extract("line", SEGMENT, k)
    said = F.when(first, part(4)).otherwise(T.strip(F.col("line")))
    x = x.select("file", "segment_no", "pos", said.alias("said"), first.alias("first"), *[F.when(first, part(k)).alias(f"g{k}") for k in (1, 2, 3)]).where("first or said <> ''")
    y = x.groupBy("file", "segment_no").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("parts"), *[F.max(f"g{k}").alias(f"g{k}") for k in (1, 2, 3)])
    return y.select("file", (F.col("segment_no") - 1).cast("long").alias("pos"), T.seconds(F.col("g1")).cast("long").alias("start"), T.seconds(F.col("g2")).cast("long").alias("end"), F.nullif("g3", F.lit("")).alias("speaker"), F.array_join("parts.said", " ").alias("text"))


def headers(files: DataFrame) -> DataFrame:
    """(file, title, metadata, preamble) from the lines before the first segment."""
    x = lines(files).where("segment_no = 0")
    meta = r"\A-\s+([A-Za-z_][\p{L}\p{N}_ ]*):\s*(.+?)\s*\z"
    titled = F.min(F.when(F.col("line").startswith("# "), F.col("pos"))).over(W.partitionBy("file"))
    x = x.withColumn("kind", F.when(F.col("pos") == titled, "title").when(F.col("line").rlike(meta), "meta").when(T.strip(F.col("line")).isin("---", ""), "none").otherwise("preamble"))
    key = F.lower(T.strip(F.regexp_extract("line", meta, 1)))
    rows = F.sort_array(F.collect_list(F.when(F.col("kind") == "meta", F.struct("pos", key.alias("key"), F.regexp_extract("line", meta, 2).alias("value")))))
    y = x.groupBy("file").agg(F.max(F.when(F.col("kind") == "title", T.strip(F.substring("line", 3, 1 << 30)))).alias("title"), rows.alias("m"),
                              F.sort_array(F.collect_list(F.when(F.col("kind") == "preamble", F.struct("pos", "line")))).alias("p"))
    last = F.filter("m", lambda e: ~F.exists("m", lambda o: (o["key"] == e["key"]) & (o["pos"] > e["pos"])))
    return y.select("file", "title", F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))).alias("metadata"), F.col("p.line").alias("preamble"))


def flag(segments: DataFrame, phrases=PHRASES, run: int = RUN, keys=("file",)) -> DataFrame:
    """Adds flags: 'empty' or 'phrase', and 'repeat' for all but the first of a run of equal texts."""
    low = F.lower("text")
    w = W.partitionBy(*keys).orderBy("pos")
    x = segments.withColumn("_new", F.coalesce(F.lag(low).over(w) != low, F.lit(True)).cast("int"))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy(*keys, "_island")
    repeat = (F.col("text") != "") & (F.count("*").over(island) >= run) & (F.col("_new") == 0)
    found = F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(low, p))
    flags = F.array_compact(F.array(F.when(F.col("text") == "", F.lit("empty")).when(found, F.lit("phrase")), F.when(repeat, F.lit("repeat"))))
    return x.withColumn("flags", flags).drop("_new", "_island")


def merge(segments: DataFrame, gap: int = GAP, chars: int = CHARS) -> DataFrame:
    """Joins consecutive unflagged segments of one speaker that are near in time, up to a size.

    The size depends on what was joined before, so each file is folded in order, in one task of its own.
    """
    def fold(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        out = []
        for r in rows:
            last = out[-1] if out else None
            if last and not r["flags"] and not last["flags"] and r["speaker"] == last["speaker"] and r["start"] - last["end"] <= gap and len(last["text"]) + len(r["text"]) <= chars:
                last["text"], last["end"], last["n"] = f"{last['text']} {r['text']}", r["end"], last["n"] + 1
            else:
                out.append(r | {"n": 1})
        return pa.table({
            "file": pa.array([r["file"] for r in out], table.schema.field("file").type), "pos": pa.array([r["pos"] for r in out], pa.int64()), "start": pa.array([r["start"] for r in out], pa.int64()), "end": pa.array([r["end"] for r in out], pa.int64()),
            "speaker": pa.array([r["speaker"] for r in out], pa.string()), "text": pa.array([r["text"] for r in out], pa.string()), "flags": pa.array([r["flags"] for r in out], pa.list_(pa.string())), "n": pa.array([r["n"] for r in out], pa.int64())})

    kind = dict(segments.dtypes)["file"]
    x = segments.select("file", F.col("pos").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("speaker").cast("string"), "text", "flags")
    return x.groupBy("file").applyInArrow(fold, f"file {kind}, pos long, start long, end long, speaker string, text string, flags array<string>, n long")


def islands(segments: DataFrame, gap: int = GAP, keys=("file",)) -> DataFrame:
    """The merge without a size cap, as window functions: (keys, island, start, end, n)."""
    w = W.partitionBy(*keys).orderBy("pos")
    same = F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & (F.col("start") - F.lag("end").over(w) <= gap) & (F.size("flags") == 0) & (F.size(F.lag("flags").over(w)) == 0)
    x = segments.withColumn("island", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max_by("end", "pos").alias("end"), F.count("*").alias("n"))


def stats(segments: DataFrame, keys=("file",)) -> DataFrame:
    """(keys, segments, speakers, unlabeled, duration, chars): duration is the last segment's end."""
    return segments.groupBy(*keys).agg(
        F.count("*").alias("segments"), F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speakers"), F.count_if(F.col("speaker").isNull()).alias("unlabeled"),
        F.max_by("end", "pos").cast("long").alias("duration"), (F.sum(F.length("text")) + F.count("*") - 1).cast("long").alias("chars"))


def flag_counts(flagged: DataFrame, keys=("file",)) -> DataFrame:
    return flagged.select(*keys, F.explode("flags").alias("flag")).groupBy(*keys, "flag").agg(F.count("*").alias("n"))


def render(segments: DataFrame, head: DataFrame, drop_flagged: bool = False) -> DataFrame:
    """(file, text): the cleaned transcript."""
    x = segments.where(F.size("flags") == 0) if drop_flagged else segments
    note = F.when(F.size("flags") > 0, F.concat(F.lit(" [flagged: "), F.array_join("flags", ","), F.lit("]"))).otherwise("")
    label = F.when(F.col("speaker").isNotNull(), F.concat(F.lit(" "), "speaker", F.lit(":"))).otherwise("")
    line = F.concat(F.lit("["), T.timecode(F.col("start")), F.lit(" - "), T.timecode(F.col("end")), F.lit("]"), label, note, F.lit(" "), "text")
    body = x.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))["line"], "\n").alias("body"))
    meta = F.transform(F.map_entries("metadata"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    top = F.concat(F.when(F.col("title").isNotNull(), F.array(F.concat(F.lit("# "), "title"))).otherwise(F.array().cast("array<string>")), meta, "preamble")
    y = head.join(body, "file", "left").withColumn("top", top)
    return y.select("file", F.concat(F.array_join("top", "\n"), F.when(F.size("top") > 0, F.lit("\n---\n")).otherwise(""), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))


def date_audit(head: DataFrame) -> DataFrame:
    """(file, filename_date, recorded_date, match): a month-day in the name need only match the end."""
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*\z", "")
    named = F.nullif(F.regexp_extract(stem, r"(?:\A|__|_|-|\s)(\d{4}-\d{2}-\d{2}|\d{2}-\d{2})(?=[-_.\s])", 1), F.lit(""))
    told = F.nullif(F.regexp_extract(F.coalesce(F.col("metadata")["recorded"], F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    x = head.select("file", named.alias("filename_date"), told.alias("recorded_date"))
    return x.withColumn("match", F.when(F.col("filename_date").isNotNull() & F.col("recorded_date").isNotNull(), F.when(F.length("filename_date") == 5, F.endswith("recorded_date", F.col("filename_date"))).otherwise(F.col("filename_date") == F.col("recorded_date"))))

"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form (lower case, no copyright lines, one spelling for equivalent
words, no punctuation) and its digest is looked up among the digests of known licences. Whole
texts are looked up, and so is each line, which finds the notices that grant a licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, tidy
from .licence_texts import NOTICES, TEXTS

#: Spellings that count as one, from -> to, after lower-casing and punctuation removal.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "recognise": "recognize", "authorisation": "authorization",
    "favour": "favor", "honour": "honor", "labour": "labor", "programme": "program", "acknowledgement": "acknowledgment", "judgement": "judgment", "fulfil": "fulfill", "noncommercial": "non commercial", "noninfringement": "non infringement",
    "merchantibility": "merchantability", "copyright holder": "copyright owner", "copyright holders": "copyright owners",
}
#: Lines that only claim copyright (a sign, a year, a placeholder or a holder), in lower case, and licence text that begins like one.
CLAIM = r"^[^\p{L}\p{N}]*(copyright\b|©|c\)[ \t]*[<\[{©]|c\)[ \t]*copyright\b|c\).*\b(19|20)\d\d\b)|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
NO_CLAIM = r"^[^\p{L}\p{N}]*copyright[ \t]+(notices?|holders?|owners?|licen[cs]es?|laws?|statements?|and|or|in|on|of|to|the|this|that|is|are|as|may|shall|must|will|for|with|which|protection|interests?|ownership|treaty|treaties)\b"
BROADCAST_ROWS = 10_000


def canonical(line: Column) -> Column:
    """Canonical form of one line; copyright lines become empty."""
    low = F.lower(line)
    x = F.when(low.rlike(CLAIM) & ~low.rlike(NO_CLAIM), F.lit("")).otherwise(low)
    x = F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for was, now in SPELLINGS.items():
        was, now = (f" {w.replace(' ', '  ')} " for w in (was, now))
        x = F.replace(x, F.lit(was), F.lit(now))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def lines_of(text: Column) -> Column:
    """Canonical lines of a text."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), canonical)


def whole_of(lines: Column) -> Column:
    """Canonical form of a whole text, from its lines: one space between words."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def registry(spark: SparkSession, texts: dict[str, str] = TEXTS, notices: dict[str, tuple[str, ...]] = NOTICES) -> DataFrame:
    """(licence, kind 'text' or 'notice', body)."""
    rows = [(k, "text", v) for k, v in texts.items()] + [(k, "notice", v) for k, vs in notices.items() for v in vs]
    row = lambda k, kind, v: F.struct(F.lit(k).alias("licence"), F.lit(kind).alias("kind"), F.lit(v).alias("body"))
    none = F.array().cast("array<struct<licence:string,kind:string,body:string>>")
    return spark.range(1).select(F.inline(F.concat(none, F.array(*[row(*r) for r in rows]) if rows else none)))


def prints(line) -> tuple[Column, Column]:
    """The digest of a line, in two parts of 64 bits."""
    return F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit("licence")).alias("g")


def digest_table(known: DataFrame) -> DataFrame:
    """(digest, h, licence, kind), one licence for a digest: the first by name. Bodies without words have none."""
    x = known.select("licence", "kind", whole_of(lines_of(F.col("body"))).alias("w")).where("w <> ''")
    return x.groupBy("w").agg(F.min("licence").alias("licence"), F.min_by("kind", "licence").alias("kind")).select(F.sha2("w", 256).alias("digest"), *prints("w"), "licence", "kind")


@tidy
def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, n_lines, digest, text_licence, n_notices, notices (sorted, comma-joined).

    ``digest`` is of the canonical whole text; ``text_licence`` its licence or null. ``n_notices``
    counts lines that are a known licence or notice. Null and empty texts have no lines and no licence.
    Licences of one canonical text go by the first name. Rows are documents of their own, whatever
    their doc_id. An empty table gives no rows, an empty registry no licence; other columns are ignored.
    """
    known = digest_table(registry(docs.sparkSession) if known is None else known)
    known = materialize(known, "licences", keep=True)
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    x = docs.select("doc_id", lines_of(F.col("text").cast("string")).alias("lines")).withColumn("lines", F.filter("lines", lambda s: s != ""))
    x = x.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.sha2(whole_of(F.col("lines")), 256).alias("digest"), F.transform("lines", lambda s: F.struct(*prints(s))).alias("p"))
    x = materialize(x.withColumn("_row", F.monotonically_increasing_id()), "digests", keep=True)
    found = x.select("_row", F.explode("p").alias("p")).select("_row", "p.h", "p.g").join(known.select("h", "g", "licence"), ["h", "g"])
    found = found.groupBy("_row").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    y = x.drop("p").join(known.select("digest", F.col("licence").alias("text_licence")), "digest", "left").join(found, "_row", "left")
    return y.select("doc_id", "n_lines", "digest", "text_licence", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(k, v) for k, v in TEXTS.items()] + [(k, v) for k, vs in NOTICES.items() for v in vs]
    line = "(' ' || regexp_replace(CASE WHEN regexp_matches(lower(s), " + quote(CLAIM) + ") AND NOT regexp_matches(lower(s), " + quote(NO_CLAIM) + ") THEN '' ELSE lower(s) END, '[^\\p{L}\\p{N}]+', '  ', 'g') || ' ')"
    for was, now in SPELLINGS.items():
        was, now = (f" {w.replace(' ', '  ')} " for w in (was, now))
        line = f"replace({line}, {quote(was)}, {quote(now)})"
    line = f"trim(replace({line}, '  ', ' '))"
    lines = lambda c: f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[\\r\\n]+'), lambda s: {line}), lambda s: s <> '')"
    return f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)}) AS t(licence, body)),
known AS (SELECT w, min(licence) AS licence FROM (SELECT licence, array_to_string({lines("body")}, ' ') AS w FROM k) WHERE w <> '' GROUP BY w),
d AS (SELECT doc_id, {lines("text")} AS ls FROM documents),
n AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM (SELECT doc_id, unnest(ls) AS w FROM d) JOIN known USING (w) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, sha256(array_to_string(ls, ' ')) AS digest, licence AS text_licence, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON known.w = array_to_string(ls, ' ') LEFT JOIN n USING (doc_id)
"""


SQL = _sql()

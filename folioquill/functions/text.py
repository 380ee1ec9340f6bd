"""Text column expressions. Everything here is a built-in Spark expression: no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The stop words that neither index nor query keeps.
STOPWORDS = (
    "a an and are as at be by for from has have he her him his i if in is it its "
    "of on or that the their them they this to was were will with you your"
).split()
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_'\-]*"
SENTENCE_END = r"(?<=[.!?])\s+"
FRONTMATTER = r"(?s)\A---\n(.*?)\n---\n"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased words of at least two characters that are no stop words, in order; null text has none."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def sha256_tag(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def synthetic_address(path: Column) -> Column:
    return F.concat(F.lit("syn-"), F.substring(F.sha1(path), 1, 6))


def source_address(path: Column) -> Column:
    return F.concat(F.lit("src-"), F.substring(F.sha1(path), 1, 8))


def dedup_key(text: Column) -> Column:
    """Letters, digits and underscores of a text, lower-cased."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def normalize_filler(text: Column) -> Column:
    """Runs of four or more of one filler character become three."""
    return F.regexp_replace(text, r"([.\-_=·~*])\1{3,}", "$1$1$1")


def first_sentence(text: Column, limit: int = 300) -> Column:
    return F.substring(F.get(F.split(strip(text), SENTENCE_END, 2), F.lit(0)), 1, limit)


def wiki_prefix(title: Column, body: Column) -> Column:
    shown = F.coalesce(F.nullif(strip(title), F.lit("")), F.lit("(untitled)"))
    return F.concat(F.lit('This passage is from the wiki page "'), shown, F.lit('". The page opens: '), first_sentence(body))


def source_prefix(title: Column, folder: Column, body: Column) -> Column:
    where = F.when(F.coalesce(folder, F.lit("")) != "", F.concat(F.lit(" (filed under "), folder, F.lit(")"))).otherwise("")
    return F.concat(F.lit('This passage is from the source document "'), title, F.lit('"'), where, F.lit(". The document opens: "), first_sentence(body))


def snippet(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def flat_snippet(text: Column, limit: int = 300) -> Column:
    return F.substring(strip(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def slugify(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_\-]+", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"\A-+|-+\z", ""), F.lit("")), F.lit("untitled"))


def safe_name(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, r"[/\\\x00-\x1f]+", ""), r"\A[.\-]+", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def safe_filename(term: Column) -> Column:
    s = F.regexp_replace(strip(F.regexp_replace(term, r'[<>:"/\\|?*\x00-\x1f]', "-")), r"\A\.+|\.+\z", "")
    return F.when(s.rlike(r"[\p{L}\p{N}]"), s).otherwise("unnamed-term")


def strip_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)(\.(pdf|docx|doc|pptx|xlsx|csv|html))?\.md\z", "")


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", ""))


def vocabulary(text: Column) -> Column:
    """Distinct words of four or more letters a-z."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def frontmatter(text: Column) -> Column:
    return F.regexp_extract(text, FRONTMATTER, 1)


def field(block: Column, name: str) -> Column:
    """A scalar frontmatter field without quotes; empty where it is missing."""
    return F.regexp_extract(block, rf"(?m)^{name}:[ \t]*['\"]?(.*?)['\"]?[ \t]*$", 1)


def url_slug(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*\z", ""), r"/+\z", "")
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), " ", "-"))


def safe_url(url: Column) -> Column:
    """Only http and https to public hosts."""
    host = F.lower(F.regexp_extract(url, r"\A[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    private = host.rlike(r"\A(localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|169\.254\..*|0\.0\.0\.0|\[::1\])\z")
    return F.coalesce(url.rlike(r"(?i)\Ahttps?://") & (host != "") & ~private, F.lit(False))


def local_url(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"\A[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    return F.coalesce(host.isin("127.0.0.1", "localhost", "::1", "[::1]"), F.lit(False))


def confined(path: Column) -> Column:
    """Relative, without line ends and parent steps."""
    return ~path.rlike(r"\A(/|\\|[A-Za-z]:)|[\r\n]|(\A|[/\\])\.\.([/\\]|\z)")


def sanitize_body(body: Column, limit: int = 50_000) -> Column:
    """Web text without scripts, frames, styles, wiki links and frontmatter marks, cut to a size."""
    s = F.regexp_replace(body, r"(?is)<(script|iframe|style)\b.*?</\1\s*>|<(script|iframe|style)\b[^>]*/?>", "")
    s = F.regexp_replace(F.replace(s, F.lit("[["), F.lit("\\[\\[")), r"(?m)^---[ \t]*$", "")
    return F.substring(s, 1, limit)


def seconds(ts: Column) -> Column:
    """[H:]MM:SS as seconds."""
    p = F.split(ts, ":")
    return F.aggregate(p, F.lit(0), lambda a, x: a * 60 + x.try_cast("int"))


def timecode(total: Column) -> Column:
    h, m, s = (F.floor(total / 3600)).cast("int"), (F.floor(total / 60) % 60).cast("int"), (total % 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def cosine(a: Column, b: Column, mismatch=0.0) -> Column:
    """Cosine of two vectors; 0 for a zero vector, ``mismatch`` for vectors of unequal length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(mismatch)).when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def script_counts(text: Column) -> Column:
    """Letters by script: latin, hangul, cjk, other."""
    count = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]", "")).cast("long")
    latin, hangul, cjk = count(r"\p{L}&&\p{IsLatin}"), count(r"\p{L}&&\p{IsHangul}"), count(r"\p{L}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    return F.struct(latin.alias("latin"), hangul.alias("hangul"), cjk.alias("cjk"), (count(r"\p{L}") - latin - hangul - cjk).alias("other"))


#: Words that mark a Spanish text.
SPANISH = ("el", "la", "los", "las", "que", "de", "en", "es", "una", "para", "pero", "como")


def spanish_ratio(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúñü]+"), F.lit(0))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.round(F.size(F.filter(words, lambda w: w.isin(*SPANISH))) / F.size(words), 3))

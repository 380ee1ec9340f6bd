"""Text, chunk and dedup queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, dedup, fidelity
from ..sources import files
from .registry import query

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = f"list_filter(list_transform(regexp_extract_all(coalesce({{0}}, ''), '[\\p{{{{L}}}}\\p{{{{N}}}}_][\\p{{{{L}}}}\\p{{{{N}}}}_''\\-]*'), lambda w: lower(w)), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"
OVERRIDES = {"src1": "1", "src2": "2", "src0": "0"}
LONG = lambda c: c.cast("long")


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


def pages_of(documents):
    """Documents as corpus pages: (path, title, folder, body)."""
    name = F.concat(F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return documents.select(name.alias("path"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("folder"), F.col("text").alias("body"))


PARAGRAPH = r"\n"
#: The chunk table in SQL: the folds are recursive.
SENTENCES = "string_split(regexp_replace({0}, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))"
STRIP = "regexp_replace({0}, '\\A[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+\\z', '', 'g')"
FILLER = "regexp_replace({0}, '\\.{{4,}}|-{{4,}}|_{{4,}}|={{4,}}|·{{4,}}|~{{4,}}|\\*{{4,}}', '', 'g')"
CHUNKS = f"""
RECURSIVE pg AS (
  SELECT source || '/doc-' || doc_id || '.md' AS path, 'doc-' || doc_id AS title, source, coalesce(text, '') AS body FROM documents),
para AS (
  SELECT path, list_filter(list_transform(string_split(body, chr(10)), lambda s: {STRIP.format('s')}), lambda s: s <> '') AS ps FROM pg),
fold AS (
  SELECT path, ps, 1 AS i, CAST(NULL AS VARCHAR) AS cur, 0 AS size, CAST(NULL AS VARCHAR) AS chunk FROM para
  UNION ALL
  SELECT path, ps, i + 1,
    CASE WHEN size + length(ps[i]) + 2 >= 2000 THEN right(coalesce(cur || chr(10) || chr(10), '') || ps[i], 200) ELSE coalesce(cur || chr(10) || chr(10), '') || ps[i] END,
    CASE WHEN size + length(ps[i]) + 2 >= 2000 THEN length(right(coalesce(cur || chr(10) || chr(10), '') || ps[i], 200)) ELSE size + length(ps[i]) + 2 END,
    CASE WHEN size + length(ps[i]) + 2 >= 2000 THEN coalesce(cur || chr(10) || chr(10), '') || ps[i] END
  FROM fold WHERE i <= len(ps)),
chunk AS (
  SELECT path, i, chunk FROM fold WHERE chunk IS NOT NULL
  UNION ALL SELECT path, i + 1, cur FROM fold WHERE i = len(ps) + 1 AND coalesce({STRIP.format('cur')}, '') <> ''),
big AS (SELECT path, i, list_filter({SENTENCES.format('chunk')}, lambda s: {STRIP.format('s')} <> '') AS ss FROM chunk WHERE length(chunk) > 4000),
pack AS (
  SELECT path, i, ss, 1 AS j, CAST(NULL AS VARCHAR) AS buf, CAST([] AS VARCHAR[]) AS out FROM big
  UNION ALL
  SELECT path, i, ss, j + 1,
    CASE WHEN length(ss[j]) > 4000 THEN NULL WHEN buf IS NOT NULL AND length(buf) + 1 + length(ss[j]) <= 4000 THEN buf || ' ' || ss[j] ELSE ss[j] END,
    CASE WHEN length(ss[j]) > 4000 THEN CASE WHEN buf IS NULL THEN [] ELSE [buf] END || list_transform(range(0, CAST(ceil(length(ss[j]) / 4000.0) AS BIGINT)), lambda k: substring(ss[j], k * 4000 + 1, 4000))
         WHEN buf IS NULL OR length(buf) + 1 + length(ss[j]) <= 4000 THEN [] ELSE [buf] END
  FROM pack WHERE j <= len(ss)),
piece AS (
  SELECT path, i, 0 AS j, 0 AS k, chunk AS raw_text FROM chunk WHERE length(chunk) <= 4000
  UNION ALL SELECT path, i, j, u.k, out[u.k] FROM pack, unnest(range(1, len(out) + 1)) AS u(k)
  UNION ALL SELECT path, i, j + 1, 0, buf FROM pack WHERE j = len(ss) + 1 AND buf IS NOT NULL),
chunks AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i, j, k) - 1 AS chunk_index, raw_text FROM piece)"""
DEDUP = "lower(regexp_replace(raw_text, '[^\\p{L}\\p{N}_]+', '', 'g'))"
LOSERS = CHUNKS + f""",
keyed AS (SELECT path, chunk_index, {DEDUP} AS k, count(*) OVER (PARTITION BY path) AS per FROM chunks),
ranked AS (
  SELECT path, chunk_index, sha1(k) AS hash, row_number() OVER w AS rn, first(path) OVER w AS keeper_page, first(chunk_index) OVER w AS keeper_chunk_index
  FROM keyed WHERE length(k) >= 400 WINDOW w AS (PARTITION BY k ORDER BY per, path, chunk_index)),
losers AS (SELECT path AS page, chunk_index, hash, keeper_page, keeper_chunk_index FROM ranked WHERE rn > 1)"""


def chunk_table(t):
    return chunking.corpus_chunks(pages_of(t.documents), paragraph=PARAGRAPH, overrides=OVERRIDES)


@query("tokenize", f"SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents)")
def tokenize(t):
    x = t.documents.select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return x.select("doc_id", LONG(F.size("ts")).alias("n_tokens"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"))


@query("corpus_chunks", f"""WITH {CHUNKS} SELECT path AS page_path, 'src-' || substr(sha1(path), 1, 8) AS page_address, chunk_index, CAST(length(raw_text) AS BIGINT) AS char_count, 'sha256:' || sha256(raw_text) AS body_hash FROM chunks""")
def corpus_chunks(t):
    return chunk_table(t).select("page_path", "page_address", "chunk_index", "char_count", "body_hash")


@query("chunk_prefix", f"""
SELECT source || '/doc-' || doc_id || '.md' AS page_path, CASE source WHEN 'src1' THEN '1' WHEN 'src2' THEN '2' WHEN 'src0' THEN '0' ELSE source END AS tier,
  'This passage is from the source document "doc-' || doc_id || '" (filed under ' || source || '). The document opens: ' || substr({SENTENCES.format(STRIP.format('text'))}[1], 1, 300) AS prefix
FROM documents""")
def chunk_prefix(t):
    p = pages_of(t.documents)
    return p.select(F.col("path").alias("page_path"), chunking.tier(F.col("path"), OVERRIDES).alias("tier"), T.source_prefix(F.col("title"), F.col("folder"), F.col("body")).alias("prefix"))


@query("addresses", """SELECT doc_id, 'syn-' || substr(sha1(source || '/' || doc_id), 1, 6) AS synthetic, 'src-' || substr(sha1(source || '/' || doc_id), 1, 8) AS source_address, 'sha256:' || sha256(text) AS body_hash, sha256('model=m' || chr(10) || text) AS tiling_hash FROM documents""")
def addresses(t):
    p = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", T.synthetic_address(p).alias("synthetic"), T.source_address(p).alias("source_address"), T.sha256_tag(F.col("text")).alias("body_hash"), F.sha2(F.concat(F.lit("model=m\n"), "text"), 256).alias("tiling_hash"))


@query("first_sentence", f"SELECT doc_id, substr({SENTENCES.format(STRIP.format('text'))}[1], 1, 300) AS opening FROM documents")
def first_sentence(t):
    return t.documents.select("doc_id", T.first_sentence(F.col("text")).alias("opening"))


@query("snippets", f"""SELECT doc_id, CASE WHEN length(text) > 200 THEN rtrim(substr(text, 1, 200)) || '…' ELSE text END AS snippet,
  substr({STRIP.format("regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')")}, 1, 300) AS flat FROM documents""")
def snippets(t):
    return t.documents.select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.flat_snippet(F.col("text")).alias("flat"))


@query("normalize_filler", """SELECT doc_id, CAST(length(x) AS BIGINT) AS n, md5(x) AS md5 FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, ' ', '----'), '\\.{4,}', '...', 'g'), '-{4,}', '---', 'g'), '_{4,}', '___', 'g'), '={4,}', '===', 'g'), '·{4,}', '···', 'g'), '~{4,}', '~~~', 'g'), '\\*{4,}', '***', 'g') AS x FROM documents)""")
def normalize_filler(t):
    x = T.normalize_filler(F.replace(F.col("text"), F.lit(" "), F.lit("----")))
    return t.documents.select("doc_id", LONG(F.length(x)).alias("n"), F.md5(x).alias("md5"))


@query("dedup_losers", f"WITH {LOSERS} SELECT * FROM losers")
def dedup_losers(t):
    return dedup.dedup_losers(chunk_table(t), page="page_path")


@query("dedup_report", f"WITH {LOSERS} SELECT page, count(*) AS losers FROM losers GROUP BY page ORDER BY losers DESC, page LIMIT 8")
def dedup_report(t):
    return dedup.dedup_report(dedup.dedup_losers(chunk_table(t), page="page_path"))


@query("anti_exclude", f"""WITH {CHUNKS}, keyed AS (SELECT path, chunk_index, {DEDUP} AS k, count(*) OVER (PARTITION BY path) AS per FROM chunks)
SELECT path AS page_path, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN length(k) >= 400 THEN k ELSE path || ' ' || chunk_index END ORDER BY per, path, chunk_index) AS nth FROM keyed) WHERE nth = 1""")
def anti_exclude(t):
    chunks = chunk_table(t)
    gone = dedup.dedup_losers(chunks, page="page_path").select(F.col("page").alias("page_path"), "chunk_index")
    return chunks.join(gone, ["page_path", "chunk_index"], "left_anti").select("page_path", "chunk_index")


@query("chunks_per_doc", f"WITH {CHUNKS} SELECT path AS page_path, count(*) AS chunks FROM chunks GROUP BY path")
def chunks_per_doc(t):
    return chunk_table(t).groupBy("page_path").agg(F.count("*").alias("chunks"))


@query("script_mix", """SELECT doc_id, CAST(length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) AS BIGINT) AS latin, CAST(length(regexp_replace(text, '[^\\p{Hangul}]', '', 'g')) AS BIGINT) AS hangul,
  CAST(length(regexp_replace(text, '[^\\p{Han}\\p{Hiragana}\\p{Katakana}]', '', 'g')) AS BIGINT) AS cjk FROM documents""")
def script_mix(t):
    return t.documents.select("doc_id", T.script_counts(F.col("text")).alias("s")).select("doc_id", "s.latin", "s.hangul", "s.cjk")


@query("spanish_ratio", """SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE CAST(round(len(list_filter(ws, lambda w: w IN ('el','la','los','las','que','de','en','es','una','para','pero','como'))) / len(ws), 3) AS DOUBLE) END AS ratio
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-záéíóúñü]+') AS ws FROM documents)""")
def spanish_ratio(t):
    return t.documents.select("doc_id", T.spanish_ratio(F.col("text")).alias("ratio"))


VOCAB = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{4,}}'))"


def halves(t):
    return t.documents.select(F.col("doc_id").alias("key"), F.col("text").alias("original"), F.expr("substring(text, 1, cast(length(text) * (doc_id % 10) / 9 as int))").alias("converted"))


@query("vocab_recall", f"""SELECT key, CAST(len(a) AS BIGINT) AS vocabulary, CASE WHEN len(a) >= 50 THEN round(len(list_intersect(a, b)) / len(a), 6) END AS recall, CASE WHEN len(a) >= 50 THEN round(len(list_intersect(a, b)) / len(a), 6) < 0.97 ELSE false END AS flagged
FROM (SELECT doc_id AS key, {VOCAB.format('text')} AS a, {VOCAB.format('substr(text, 1, CAST(trunc(length(text) * (doc_id % 10) / 9) AS INT))')} AS b FROM documents)""")
def vocab_recall(t):
    return fidelity.recall_audit(halves(t))


def blocks_sql(text: str) -> str:
    """The paragraphs of a text, each on one line, as a list."""
    white = "[ \\t\\n\\r\\f\\v]"
    lines = f"list_filter(list_transform(regexp_split_to_array(p, '\\r\\n|\\n|\\r'), lambda s: regexp_replace(s, '\\A{white}+|{white}+\\z', '', 'g')), lambda s: s <> '')"
    return f"list_filter(list_transform(regexp_split_to_array(replace({text}, chr(12), chr(10) || chr(10)), '\\n{white}*\\n'), lambda p: array_to_string({lines}, ' ')), lambda p: p <> '')"


GONE = f"len(list_filter({VOCAB.format('b')}, lambda w: NOT list_contains(have, w)))"


@query("recover_text_layer", f"""
WITH h AS (SELECT doc_id AS key, text AS original, substr(text, 1, CAST(trunc(length(text) * (doc_id % 10) / 9) AS INT)) AS converted FROM documents),
v AS (SELECT *, {blocks_sql('original')} AS blocks, {VOCAB.format('converted')} AS have, {VOCAB.format('original')} AS want FROM h),
m AS (SELECT *, list_filter(blocks, lambda b: {GONE} >= 3 AND {GONE} / len({VOCAB.format('b')}) > 0.4) AS missing, CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) END AS share FROM v),
k AS (SELECT *, CASE WHEN len(blocks) > 0 AND share < 0.7 THEN 'replaced' WHEN len(missing) > 0 THEN 'appended' END AS mode FROM m)
SELECT key, mode, CAST(length(CASE mode WHEN 'replaced' THEN array_to_string(blocks, chr(10) || chr(10)) WHEN 'appended' THEN rtrim(converted) || chr(10) || chr(10) || '## Text recovered from the PDF text layer' || chr(10) || chr(10) || array_to_string(missing, chr(10) || chr(10)) || chr(10) ELSE converted END) AS BIGINT) AS n FROM k""")
def recover_text_layer(t):
    return fidelity.recover(halves(t)).select("key", "mode", LONG(F.length("text")).alias("n"))


@query("low_text", "SELECT doc_id AS key, CAST(length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) AS BIGINT) AS visible FROM documents WHERE length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) < 200")
def low_text(t):
    return fidelity.low_text(t.documents.select(F.col("doc_id").alias("key"), "text"))


@query("html_to_markdown")
def html_to_markdown(t):
    return files.html_column(t.pages.select("page_id", "html"), "html").select("page_id", LONG(F.length("markdown")).alias("n"), F.md5("markdown").alias("md5"))


def visible_sql(html: str) -> str:
    """The visible text of an article page."""
    x = f"regexp_replace({html}, '(?is)" + "|".join(f"<{tag}\\b.*?</{tag}\\s*>" for tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe")) + "|<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)<(br|/p|/div|/li|/h[1-6])\\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    white = "[ \\t\\n\\r\\f\\v]"
    return STRIP.format(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '{white}*\\n{white}*', chr(10), 'g')")


@query("defuddle", f"SELECT page_id, CAST(length(x) AS BIGINT) AS n, md5(x) AS md5 FROM (SELECT page_id, {visible_sql('html')} AS x FROM pages)")
def defuddle(t):
    x = files.without_boilerplate(F.col("html"))
    return t.pages.select("page_id", LONG(F.length(x)).alias("n"), F.md5(x).alias("md5"))


@query("url_checks", """SELECT page_id, lower(replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*', ''), '/+$', ''), '([^/]*)$', 1), ' ', '-')) AS slug, regexp_matches(url, '(?i)^https?://') AS safe, false AS local FROM pages""")
def url_checks(t):
    return t.pages.select("page_id", T.url_slug(F.col("url")).alias("slug"), T.safe_url(F.col("url")).alias("safe"), T.local_url(F.col("url")).alias("local"))


@query("content_search", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[cs]ed?')")
def content_search(t):
    from ..operators.lint import content_search as search

    return search(t.documents, "(?i)licen[cs]ed?", True, "text").select("doc_id")

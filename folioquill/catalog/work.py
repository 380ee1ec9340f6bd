"""Planning, queue, transcript, table and register queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fidelity, planning, register, tables, transcript
from ..sources import sinks
from .registry import query

LONG = lambda c: c.cast("long")
EXT = ["pdf", "xlsx", "csv", "pptx", "md", "png", "docx", "zip", "eml", "html"]


def inbox(t):
    """A file for each part: named by its key, with one of ten suffixes, its size from the price."""
    k = F.col("p_partkey")
    ext = F.get(F.array(*[F.lit(e) for e in EXT]), (k % 10).cast("int"))
    name = F.when(k % 50 == 0, F.concat(F.lit("in/"), k.cast("string"), F.lit("/Desktop.ini"))).otherwise(F.concat(F.lit("in/File "), k.cast("string"), F.lit("."), F.upper(ext)))
    return t.part.select(name.alias("path"), F.floor(F.col("p_retailprice") * 2000).cast("long").alias("size"))


INBOX = """f AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'in/' || p_partkey || '/Desktop.ini' ELSE 'in/File ' || p_partkey || '.' || upper((['pdf', 'xlsx', 'csv', 'pptx', 'md', 'png', 'docx', 'zip', 'eml', 'html'])[p_partkey % 10 + 1]) END AS path, CAST(floor(p_retailprice * 2000) AS BIGINT) AS size,
  CASE WHEN p_partkey % 50 = 0 THEN 'ini' ELSE (['pdf', 'xlsx', 'csv', 'pptx', 'md', 'png', 'docx', 'zip', 'eml', 'html'])[p_partkey % 10 + 1] END AS e FROM part),
g AS (SELECT path, CASE WHEN e = 'ini' THEN 'skip' WHEN e IN ('xlsx', 'csv') THEN 'catalogue' WHEN e = 'pptx' THEN 'summary' WHEN e IN ('pdf', 'md', 'docx', 'html') AND size > 2000000 THEN 'summary' ELSE 'full' END AS depth,
  CASE WHEN e = 'ini' THEN 'os-junk' WHEN e IN ('xlsx', 'csv') THEN 'structured-data' WHEN e = 'pptx' THEN 'slide-deck' WHEN e IN ('pdf', 'md', 'docx', 'html') THEN CASE WHEN size > 2000000 THEN 'large-document (> 2000000 bytes)' ELSE 'document' END ELSE 'default' END AS reason, e FROM f)"""


def depths(t):
    return inbox(t).select("path", planning.depth(F.col("path"), F.col("size")).alias("d")).select("path", "d.depth", "d.reason")


@query("depth_rule", f"WITH {INBOX} SELECT path, depth, reason FROM g")
def depth_rule(t):
    return depths(t)


@query("convert_route", f"WITH {INBOX} SELECT path, CASE WHEN e = 'md' THEN 'passthrough' WHEN e IN ('xlsx', 'csv') THEN 'policy-skip' WHEN e IN ('pdf', 'pptx', 'docx', 'eml', 'html') THEN 'convert' ELSE 'no-handler' END AS route FROM g")
def convert_route(t):
    return inbox(t).select("path", planning.convert_route(F.col("path")).alias("route"))


def stored(t):
    """A stored plan of half of the files, every seventh overridden to skip."""
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    return depths(t).where(k % 2 == 0).select("path", F.when(k % 7 == 0, "skip").otherwise("full").alias("depth"), F.lit("stored").alias("reason"), (k % 7 == 0).alias("override"))


STORED = INBOX + """,
st AS (SELECT path, CASE WHEN k % 7 = 0 THEN 'skip' ELSE 'full' END AS depth, k % 7 = 0 AS override FROM (SELECT path, CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) AS k FROM g) WHERE k % 2 = 0)"""


@query("join_plan_override", f"WITH {STORED} SELECT path, CASE WHEN override THEN st.depth ELSE g.depth END AS depth, CASE WHEN override THEN 'stored' ELSE reason END AS reason, coalesce(override, false) AS override FROM g LEFT JOIN st USING (path)")
def join_plan_override(t):
    return planning.merge_plan(stored(t), depths(t))


@query("plan_get", f"WITH {STORED} SELECT path, coalesce(st.depth, 'full') AS depth FROM g LEFT JOIN st USING (path)")
def plan_get(t):
    return planning.plan_lookup(inbox(t), stored(t))


@query("depth_summary", f"WITH {INBOX} SELECT count(*) FILTER (depth = 'full') AS full, count(*) FILTER (depth = 'summary') AS summary, count(*) FILTER (depth = 'catalogue') AS catalogue, count(*) FILTER (depth = 'skip') AS skip, count(*) AS total, CAST(0 AS BIGINT) AS overrides FROM g")
def depth_summary(t):
    return planning.plan_summary(depths(t).withColumn("override", F.lit(False)))


SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_\\-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"


@query("slugify", f"SELECT p_partkey, {SLUG.format('p_name')} AS slug, p_name AS safe, replace(p_name, ' ', '-') AS url FROM part")
def slugify(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", T.slugify(n).alias("slug"), T.safe_name(F.concat(F.lit("../"), n)).alias("safe"), F.replace(T.safe_filename(n), F.lit(" "), F.lit("-")).alias("url"))


@query("route_path", f"""SELECT p_partkey, mode, kind, CASE mode WHEN 'lyt' THEN 'wiki/notes/' || s WHEN 'zettelkasten' THEN 'wiki/7-' || s WHEN 'generic' THEN CASE kind WHEN 'source' THEN 'wiki/sources/' || s WHEN 'session' THEN 'wiki/sessions/' || s WHEN 'entity' THEN 'wiki/entities/' || p_name ELSE 'wiki/concepts/' || p_name END
  ELSE CASE kind WHEN 'source' THEN 'wiki/resources/incoming/' || s WHEN 'session' THEN 'wiki/projects/inbox/' || s WHEN 'entity' THEN 'wiki/resources/people/' || p_name WHEN 'concept' THEN 'wiki/resources/concepts/' || p_name ELSE 'wiki/resources/' || s || '/' || s END END || '.md' AS path
FROM (SELECT *, {SLUG.format('p_name')} AS s FROM part), (VALUES ('generic'), ('lyt'), ('para'), ('zettelkasten')) AS m(mode), (VALUES ('source'), ('entity'), ('concept'), ('session'), ('research')) AS k(kind)""")
def route_path(t):
    modes, kinds = ("generic", "lyt", "para", "zettelkasten"), ("source", "entity", "concept", "session", "research")
    return planning.routes(t.part.select("p_partkey", "p_name"), "p_name", modes, kinds, F.lit("7")).select("p_partkey", "mode", "kind", "path")


@query("save_routing", "SELECT event_id, CASE event_type WHEN 'click' THEN 'wiki/concepts/' WHEN 'view' THEN 'wiki/sources/' ELSE 'wiki/questions/' END AS folder FROM events")
def save_routing(t):
    kind = F.when(F.col("event_type") == "click", "concept").when(F.col("event_type") == "view", "source").otherwise(F.col("event_type"))
    return t.events.select("event_id", planning.save_folder(kind).alias("folder"))


@query("address_alloc", "SELECT c_custkey, printf('c-%06d', 41 + row_number() OVER (ORDER BY c_custkey)) AS address FROM customer")
def address_alloc(t):
    x = planning.numbered(t.customer.select("c_custkey"), F.col("c_custkey"), start=42)
    return x.select("c_custkey", planning.address(F.col("n")).alias("address"))


@query("id_mint", "SELECT c_custkey, '20240101' || lpad(CAST(n // 3600000000 AS VARCHAR), 2, '0') || lpad(CAST(n // 60000000 % 60 AS VARCHAR), 2, '0') || lpad(CAST(n // 1000000 % 60 AS VARCHAR), 2, '0') || lpad(CAST(n % 1000000 AS VARCHAR), 6, '0') AS id FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer)")
def id_mint(t):
    x = planning.numbered(t.customer.select("c_custkey"), F.col("c_custkey"))
    return x.select("c_custkey", F.date_format(F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("n")), "yyyyMMddHHmmssSSSSSS").alias("id"))


@query("delta_manifest", "SELECT CAST(o_orderkey AS VARCHAR) AS path, sha256(o_orderstatus) AS hash FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderstatus <> 'F')")
def delta_manifest(t):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    old = t.orders.where(k % 3 != 0).select(k.cast("string").alias("path"), F.sha2(F.when(k % 3 == 1, "F").otherwise(s), 256).alias("hash"))
    return planning.manifest_delta(t.orders.select(k.cast("string").alias("path"), F.sha2(s, 256).alias("hash")), old)


def queue_events(t):
    """Events as queue events: purchases close the user's items of every kind, other types add one."""
    x = t.events
    return x.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "done").otherwise("add").alias("op"), F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("kind"), F.col("user_id").cast("string").alias("page"), F.col("event_id").cast("string").alias("detail"), F.date_format("ts", "yyyy-MM-dd").alias("date")).where("kind is not null or op = 'done'")


QUEUE = """e AS (SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'done' ELSE 'add' END AS op, CASE WHEN event_id % 10 <> 0 THEN event_type END AS kind, CAST(user_id AS VARCHAR) AS page, strftime(ts, '%Y-%m-%d') AS date FROM events),
a AS (SELECT a.kind, a.page, a.seq, a.date, min(d.seq) AS closed, arg_min(d.date, d.seq) AS done_date FROM e a LEFT JOIN e d ON d.op = 'done' AND d.page = a.page AND d.seq > a.seq AND (d.kind IS NULL OR d.kind = a.kind) WHERE a.op = 'add' AND a.kind IS NOT NULL GROUP BY ALL),
q AS (SELECT kind, page, CAST(max(seq) AS VARCHAR) AS detail, arg_min(date, seq) AS added, closed IS NOT NULL AS done, min(done_date) AS done_date FROM a GROUP BY kind, page, closed)"""


@query("queue_state", f"WITH {QUEUE} SELECT * FROM q")
def queue_state(t):
    return planning.queue_state(queue_events(t))


@query("queue_stats", f"WITH {QUEUE} SELECT kind, count(*) FILTER (NOT done) AS open, count(*) FILTER (done) AS done FROM q GROUP BY kind")
def queue_stats(t):
    return planning.queue_stats(planning.queue_state(queue_events(t)))


@query("queue_filter", f"WITH {QUEUE} SELECT page, detail FROM q WHERE NOT done AND kind = 'click'")
def queue_filter(t):
    return planning.queue_state(queue_events(t)).where("not done and kind = 'click'").select("page", "detail")


@query("fold_batch", "SELECT 'fold-k5-from-' || strftime(min(o_orderdate), '%Y-%m-%d') || '-to-' || strftime(max(o_orderdate), '%Y-%m-%d') || '-n32' AS fold_id, count(*) AS entries FROM (SELECT o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 32)")
def fold_batch(t):
    return planning.fold_batch(t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (-F.col("o_orderkey")).alias("pos")), 5).select("fold_id", "entries")


@query("research_caps", "SELECT round, url, score FROM (SELECT r AS round, url, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, url) AS k FROM (SELECT page_id % 4 + 1 AS r, url, page_id % 97 AS score FROM pages) WHERE r <= 3) WHERE k <= 5 ORDER BY round, k LIMIT 15")
def research_caps(t):
    return planning.research_caps(t.pages.select((F.col("page_id") % 4 + 1).alias("round"), "url", (F.col("page_id") % 97).alias("score")))


@query("lock_state", "SELECT event_id, CASE WHEN value * 100 >= 3600 THEN 'reapable' WHEN value * 100 >= 60 THEN 'stale' ELSE 'held' END AS state FROM events")
def lock_state(t):
    return t.events.select("event_id", planning.lock_state(F.col("value") * 100).alias("state"))


@query("ensure_index", "SELECT max(ts) > TIMESTAMP '2024-01-15' AS stale FROM events")
def ensure_index(t):
    return planning.stale_index(t.events.select(F.col("ts").alias("modified")), F.lit("2024-01-15").cast("timestamp"))


# transcripts


def event_segments(t):
    """A file for each user: their events by time; the text is the type."""
    s = F.unix_timestamp("ts")
    return t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), s.alias("start"), (s + 5).alias("end"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("sp"), (F.col("event_id") % 2).cast("string"))).alias("speaker"), F.when(F.col("event_id") % 40 == 7, "Please subscribe now").when(F.col("event_id") % 50 == 3, "").otherwise(F.col("event_type")).alias("text"))


SEGMENTS = """s AS (SELECT user_id AS file, event_id AS pos, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 5 AS "end", CASE WHEN event_id % 4 <> 0 THEN 'sp' || (event_id % 2) END AS speaker,
  CASE WHEN event_id % 40 = 7 THEN 'Please subscribe now' WHEN event_id % 50 = 3 THEN '' ELSE event_type END AS text FROM events),
n AS (SELECT *, CASE WHEN lag(lower(text)) OVER (PARTITION BY file ORDER BY pos) = lower(text) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY pos) AS island FROM n),
fl AS (SELECT *, list_filter([CASE WHEN text = '' THEN 'empty' WHEN contains(lower(text), 'please subscribe') THEN 'phrase' END, CASE WHEN text <> '' AND fresh = 0 AND count(*) OVER (PARTITION BY file, island) >= 3 THEN 'repeat' END], lambda x: x IS NOT NULL) AS flags FROM i)"""


@query("repeat_runs", f"WITH {SEGMENTS} SELECT file, pos, array_to_string(flags, ',') AS flags FROM fl")
def repeat_runs(t):
    return transcript.flag(event_segments(t)).select("file", "pos", F.array_join("flags", ",").alias("flags"))


@query("flag_counts", f"WITH {SEGMENTS} SELECT file, flag, count(*) AS n FROM (SELECT file, unnest(flags) AS flag FROM fl) GROUP BY ALL")
def flag_counts(t):
    return transcript.flag_counts(transcript.flag(event_segments(t)))


@query("merge_islands", f"""WITH {SEGMENTS}, m AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND start - lag("end") OVER w <= 3600 AND len(flags) = 0 AND len(lag(flags) OVER w) = 0 THEN 0 ELSE 1 END AS b FROM fl WINDOW w AS (PARTITION BY file ORDER BY pos)),
k AS (SELECT *, sum(b) OVER (PARTITION BY file ORDER BY pos) AS k FROM m) SELECT file, CAST(k AS BIGINT) AS island, min(start) AS start, arg_max("end", pos) AS "end", count(*) AS n FROM k GROUP BY file, k""")
def merge_islands(t):
    return transcript.islands(transcript.flag(event_segments(t)), 3600)


def merged_sql(source: str, gap: int, chars: int = transcript.CHARS) -> str:
    """The merge as a recursion over each file's segments (file, pos, start, end, speaker, text, flags): table ``merged``."""
    joins = f"""len(s.flags) = 0 AND len(m.flags) = 0 AND s.speaker IS NOT DISTINCT FROM m.speaker AND s.start - m."end" <= {gap} AND length(m.text) + length(s.text) <= {chars}"""
    return f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos) AS ord FROM {source}),
steps AS (
  SELECT file, ord, pos, start, "end", speaker, text, flags, 1 AS n FROM ordered WHERE ord = 1
  UNION ALL
  SELECT s.file, s.ord, CASE WHEN {joins} THEN m.pos ELSE s.pos END, CASE WHEN {joins} THEN m.start ELSE s.start END, s."end", s.speaker,
    CASE WHEN {joins} THEN m.text || ' ' || s.text ELSE s.text END, s.flags, CASE WHEN {joins} THEN m.n + 1 ELSE 1 END
  FROM steps m JOIN ordered s ON s.file = m.file AND s.ord = m.ord + 1),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, pos ORDER BY ord DESC) AS last FROM steps) WHERE last = 1)"""


@query("merge_segments", f"""WITH RECURSIVE {SEGMENTS}, {merged_sql('fl', 3600)} SELECT file, pos, start, "end", speaker, CAST(n AS BIGINT) AS n, CAST(length(text) AS BIGINT) AS chars FROM merged""")
def merge_segments(t):
    x = transcript.merge(transcript.flag(event_segments(t)), 3600)
    return x.select("file", "pos", "start", "end", "speaker", "n", LONG(F.length("text")).alias("chars"))


@query("transcript_stats", f"""WITH {SEGMENTS} SELECT file, count(*) AS segments, coalesce(string_agg(DISTINCT speaker, ',' ORDER BY speaker), '') AS speakers, count(*) FILTER (speaker IS NULL) AS unlabeled, arg_max("end", pos) AS duration, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars FROM s GROUP BY file""")
def transcript_stats(t):
    return transcript.stats(event_segments(t))


def transcripts(t):
    """Each conversation as a transcript file; a text's further lines follow its first."""
    at = F.col("turn") * 30
    line = F.concat(F.lit("["), T.timecode(at), F.lit(" - "), T.timecode(at + 20), F.lit("] "), F.coalesce("role", F.lit("nobody")), F.lit(": "), F.coalesce("text", F.lit("")))
    body = t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))["l"], "\n").alias("body"))
    head = F.concat(F.lit("# Talk "), F.col("conv_id").cast("string"), F.lit("\n- Recorded: 2024-03-0"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("\n- Room: A\n---\nfree words\n"))
    name = F.concat(F.lit("talks/talk-03-0"), (F.col("conv_id") % 7 + 1).cast("string"), F.lit("_"), F.col("conv_id").cast("string"), F.lit(".md"))
    return body.select(name.alias("file"), F.concat(head, "body").alias("raw"))


STAMP = "(?:\\d{1,2}:)?\\d{1,2}:\\d{2}"
SEGMENT_SQL = f"'\\A\\[({STAMP})\\s*-\\s*({STAMP})\\]\\s*(?:([^:\\n]{{1,40}}?):(?:\\s|\\z))?(.*)\\z'"
CODE = "CASE WHEN {0} >= 3600 THEN ({0} // 3600) || ':' || lpad(CAST({0} // 60 % 60 AS VARCHAR), 2, '0') ELSE lpad(CAST({0} // 60 AS VARCHAR), 2, '0') END || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"
SECONDS = "list_reduce(list_transform(string_split({0}, ':'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 60 + b)"
WHITE = "[ \\t\\n\\r\\f\\v]+"
PARSED = f"""talk AS (
  SELECT 'talks/talk-03-0' || (conv_id % 7 + 1) || '_' || conv_id || '.md' AS file, conv_id, string_agg(l, chr(10) ORDER BY turn, l) AS body
  FROM (SELECT conv_id, turn, '[' || {CODE.format('(turn * 30)')} || ' - ' || {CODE.format('(turn * 30 + 20)')} || '] ' || coalesce(role, 'nobody') || ': ' || coalesce(text, '') AS l FROM conversations) GROUP BY conv_id),
line AS (SELECT file, i AS ord, ls[i] AS line, regexp_matches(ls[i], {SEGMENT_SQL}) AS first FROM (SELECT file, regexp_split_to_array(body, '\\r\\n|\\n|\\r') AS ls FROM talk), unnest(range(1, len(ls) + 1)) AS u(i)),
part AS (
  SELECT file, ord, first, sum(CAST(first AS INT)) OVER (PARTITION BY file ORDER BY ord) AS seg, CASE WHEN first THEN regexp_extract(line, {SEGMENT_SQL}, 4) ELSE regexp_replace(line, '\\A{WHITE}|{WHITE}\\z', '', 'g') END AS said,
    regexp_extract(line, {SEGMENT_SQL}, 1) AS a, regexp_extract(line, {SEGMENT_SQL}, 2) AS b, regexp_extract(line, {SEGMENT_SQL}, 3) AS who FROM line),
parsed AS (
  SELECT file, CAST(seg - 1 AS BIGINT) AS pos, {SECONDS.format("max(CASE WHEN first THEN a END)")} AS start, {SECONDS.format("max(CASE WHEN first THEN b END)")} AS "end", nullif(max(CASE WHEN first THEN who END), '') AS speaker, string_agg(said, ' ' ORDER BY ord) AS text
  FROM part WHERE seg > 0 AND (first OR said <> '') GROUP BY file, seg)"""


@query("parse_transcript", f"""WITH {PARSED} SELECT file, pos, start, "end", speaker, md5(text) AS md5 FROM parsed""")
def parse_transcript(t):
    x = transcript.parse_segments(transcripts(t))
    return x.select("file", "pos", "start", "end", "speaker", F.md5("text").alias("md5"))


@query("transcript_headers", "SELECT DISTINCT 'talks/talk-03-0' || (conv_id % 7 + 1) || '_' || conv_id || '.md' AS file, 'Talk ' || conv_id AS title, '2024-03-0' || (conv_id % 9 + 1) AS recorded, 'free words' AS preamble FROM conversations")
def transcript_headers(t):
    return transcript.headers(transcripts(t)).select("file", "title", F.col("metadata")["recorded"].alias("recorded"), F.array_join("preamble", "\n").alias("preamble"))


@query("date_audit", "SELECT DISTINCT 'talks/talk-03-0' || (conv_id % 7 + 1) || '_' || conv_id || '.md' AS file, '03-0' || (conv_id % 7 + 1) AS filename_date, '2024-03-0' || (conv_id % 9 + 1) AS recorded_date, conv_id % 7 = conv_id % 9 AS match FROM conversations")
def date_audit(t):
    return transcript.date_audit(transcript.headers(transcripts(t)))


FLAGGED = f"""fresh AS (SELECT *, CASE WHEN lag(lower(text)) OVER (PARTITION BY file ORDER BY pos) = lower(text) THEN 0 ELSE 1 END AS fresh FROM parsed),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY pos) AS island FROM fresh),
flagged AS (SELECT file, pos, start, "end", speaker, text, list_filter([CASE WHEN text = '' THEN 'empty' WHEN len(list_filter([{", ".join("'" + p.lower().replace("'", "''") + "'" for p in transcript.PHRASES)}], lambda p: contains(lower(text), p))) > 0 THEN 'phrase' END,
  CASE WHEN text <> '' AND fresh = 0 AND count(*) OVER (PARTITION BY file, island) >= 3 THEN 'repeat' END], lambda x: x IS NOT NULL) AS flags FROM isle)"""


@query("clean_transcript", f"""WITH RECURSIVE {PARSED}, {FLAGGED}, {merged_sql('flagged', transcript.GAP)},
said AS (SELECT file, string_agg('[' || {CODE.format('start')} || ' - ' || {CODE.format('"end"')} || ']' || CASE WHEN speaker IS NOT NULL THEN ' ' || speaker || ':' ELSE '' END || CASE WHEN len(flags) > 0 THEN ' [flagged: ' || array_to_string(flags, ',') || ']' ELSE '' END || ' ' || text, chr(10) ORDER BY pos) AS body FROM merged GROUP BY file),
whole AS (SELECT file, '# Talk ' || conv_id || chr(10) || '- recorded: 2024-03-0' || (conv_id % 9 + 1) || chr(10) || '- room: A' || chr(10) || 'free words' || chr(10) || '---' || chr(10) || s.body || chr(10) AS text FROM talk JOIN said s USING (file))
SELECT file, CAST(length(text) AS BIGINT) AS n, md5(text) AS md5 FROM whole""")
def clean_transcript(t):
    x = transcripts(t)
    segments = transcript.merge(transcript.flag(transcript.parse_segments(x)))
    return transcript.render(segments, transcript.headers(x)).select("file", LONG(F.length("text")).alias("n"), F.md5("text").alias("md5"))


# numbering


def numbered_docs(t):
    """A document for each order: odd lines are sections, even ones bullets with a composite number."""
    n = F.col("l_linenumber")
    line = F.when(n % 2 == 1, F.concat(n.cast("string"), F.lit(". **Part**"))).otherwise(F.concat(F.lit("   - "), (F.col("l_partkey") % 4 + 1).cast("string"), F.lit("."), n.cast("string"), F.lit(". item")))
    x = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("l"))))["l"], "\n").alias("text"))
    return x.select(F.col("l_orderkey").alias("key"), "text")


LINES = """l AS (SELECT l_orderkey AS key, l_linenumber AS n, l_partkey % 4 + 1 AS sub, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber END AS top, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 4) AS pos FROM lineitem),
c AS (SELECT *, last(top IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos) AS section, last(top IGNORE NULLS) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)"""


@query("numbering_check", f"WITH {LINES} SELECT key, count(*) FILTER (top IS NULL AND section IS NOT NULL AND sub = section) AS matches, count(*) FILTER (top IS NULL AND section IS NOT NULL AND sub <> section) AS mismatches, count(*) FILTER (top <= before) AS resets FROM c GROUP BY key")
def numbering_check(t):
    return fidelity.check_numbering(numbered_docs(t))


@query("numbering_flags", f"WITH {LINES} SELECT key, count(*) FILTER (top IS NULL AND sub <> section) AS mismatches, count(*) FILTER (top IS NULL) AS total FROM c GROUP BY key")
def numbering_flags(t):
    return fidelity.numbering_flags(numbered_docs(t))


@query("fix_numbering", f"WITH {LINES} SELECT key, pos - 1 AS pos, CASE WHEN top IS NULL THEN '   - ' || CASE WHEN section IS NULL THEN sub ELSE section END || '.' || n || '. item' ELSE n || '. **Part**' END AS fixed, top IS NULL AND section IS NOT NULL AND sub <> section AS changed FROM c")
def fix_numbering(t):
    return fidelity.fix_numbering(numbered_docs(t), "section").select("key", LONG(F.col("pos")).alias("pos"), "fixed", "changed")


# tables


def sheets(t):
    """A workbook for each brand, a sheet for each type; the first row is a header."""
    k = F.col("p_partkey")
    rows = t.part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("sheet"), (k + 1).cast("long").alias("row"), F.array(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string")).alias("cells"))
    head = t.part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("sheet")).distinct().select("file", "sheet", F.lit(0).cast("long").alias("row"), F.array(F.lit("Name"), F.lit(""), F.lit("Phone no")).alias("cells"))
    return rows.unionByName(head)


@query("sheet_profile", "SELECT p_brand AS file, p_type AS sheet, count(*) + 1 AS rows, CAST(3 AS BIGINT) AS cols, 'Name,Phone no' AS header FROM part GROUP BY ALL")
def sheet_profile(t):
    return tables.sheet_profile(sheets(t)).withColumn("header", F.array_join("header", ","))


@query("microdata_guard", "SELECT DISTINCT p_brand AS file, p_type AS sheet, true AS sensitive FROM part")
def microdata_guard(t):
    return tables.microdata(sheets(t))


def forms(t):
    """Survey workbooks: a file for each brand; parts are questions of a type, sizes make the choice lists."""
    k = F.col("p_partkey")
    kind = F.when(k % 11 == 0, "begin group").when(k % 11 == 1, "end group").when(k % 11 == 2, "begin_repeat x").when(k % 11 == 3, "note").when(k % 11 == 4, "select_one sizes").otherwise("text")
    q = t.part.select(F.col("p_brand").alias("file"), F.lit("Survey").alias("sheet"), k.cast("long").alias("row"), F.array(kind, F.col("p_name")).alias("cells"))
    c = t.part.select(F.col("p_brand").alias("file"), F.lit("choices").alias("sheet"), k.cast("long").alias("row"), F.array((F.col("p_size") % 6).cast("string"), F.col("p_name")).alias("cells"))
    head = t.part.select(F.col("p_brand").alias("file")).distinct().select("file", F.inline(F.array(
        F.struct(F.lit("Survey").alias("sheet"), F.lit(0).cast("long").alias("row"), F.array(F.lit("type"), F.lit("label::English (en)")).alias("cells")),
        F.struct(F.lit("choices").alias("sheet"), F.lit(0).cast("long").alias("row"), F.array(F.lit("list_name"), F.lit("name")).alias("cells")))))
    return q.where(k > 0).unionByName(c.where(k > 0)).unionByName(head)


@query("xlsform_profile", "SELECT p_brand AS file, count(*) FILTER (p_partkey % 11 >= 4) AS questions, count(*) FILTER (p_partkey % 11 = 0) AS groups, count(*) FILTER (p_partkey % 11 = 2) AS repeats, count(DISTINCT p_size % 6) AS choice_lists, count(*) AS choice_options FROM part WHERE p_partkey > 0 GROUP BY p_brand")
def xlsform_profile(t):
    return tables.form_profile(forms(t)).drop("question_types")


@query("xlsform_lists", "SELECT file, list, options FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY options DESC, list) AS k FROM (SELECT p_brand AS file, CAST(p_size % 6 AS VARCHAR) AS list, count(*) AS options FROM part WHERE p_partkey > 0 GROUP BY ALL)) WHERE k <= 5")
def xlsform_lists(t):
    return tables.largest_lists(forms(t))


@query("xlsform_languages", "SELECT DISTINCT p_brand AS file, 'English (en)' AS languages FROM part")
def xlsform_languages(t):
    return tables.form_languages(forms(t)).withColumn("languages", F.array_join("languages", ","))


@query("form_family", "SELECT p_type AS family, count(*) AS files, min(p_partkey) AS first FROM part GROUP BY ALL")
def form_family(t):
    x = tables.form_families(t.part.select(F.lit(None).cast("string").alias("form_id"), F.col("p_type").alias("title"), F.col("p_partkey").alias("file")))
    return x.select("family", LONG(F.size("files")).alias("files"), F.get("files", F.lit(0)).alias("first"))


@query("glossary_seed", "SELECT arg_min(p_type, p_partkey) AS term, arg_min(p_name, p_partkey) AS definition, regexp_replace(arg_min(p_type, p_partkey), '[<>:\"/\\\\|?*]', '-', 'g') AS file_name FROM part GROUP BY lower(p_type)")
def glossary_seed(t):
    return tables.glossary(t.part.select(F.col("p_partkey").alias("row"), F.concat(F.lit(" "), F.col("p_type")).alias("term"), F.col("p_name").alias("definition")))


@query("anti_existing", "SELECT arg_min(p_type, p_partkey) AS term FROM part GROUP BY lower(p_type) HAVING length(arg_min(p_type, p_partkey)) % 2 = 1")
def anti_existing(t):
    g = tables.glossary(t.part.select(F.col("p_partkey").alias("row"), F.col("p_type").alias("term"), F.col("p_name").alias("definition")))
    return tables.new_stubs(g, g.where(F.length("file_name") % 2 == 0)).select("term")


# registers


def titles(t):
    return t.nation.select(F.concat("n_name", F.lit(" Office (N"), F.col("n_nationkey").cast("string"), F.lit(")")).alias("title"))


@query("alias_map", "SELECT alias, n_name || ' Office (N' || n_nationkey || ')' AS title FROM (SELECT *, unnest([n_name || ' Office (N' || n_nationkey || ')', n_name || ' Office', 'N' || n_nationkey]) AS alias FROM nation) WHERE NOT (alias = 'N' || n_nationkey AND n_nationkey % 5 = 0)")
def alias_map(t):
    return register.alias_map(titles(t), exclude=t.nation.where("n_nationkey % 5 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alias")))


def entries(t):
    """An entry for each customer that names their nation twice."""
    x = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.select("c_custkey", F.concat(F.lit("met "), "n_name", F.lit(" Office, `"), "n_name", F.lit(" Office` and N"), F.col("n_nationkey").cast("string")).alias("agenda"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(" again")).alias("decisions"))


@query("link_text", "SELECT c_custkey, 'met [[' || n_name || ' Office (N' || n_nationkey || ')|' || n_name || ' Office]], `' || n_name || ' Office` and N' || n_nationkey AS agenda, 'N' || n_nationkey || ' again' AS decisions FROM customer JOIN nation ON c_nationkey = n_nationkey")
def link_text(t):
    return register.link_entries(entries(t), register.alias_map(titles(t))).select("c_custkey", "agenda", "decisions")


@query("link_report", "SELECT n_name || ' Office (N' || n_nationkey || ')' AS title, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def link_report(t):
    return register.link_report(register.link_entries(entries(t), register.alias_map(titles(t))))


def registers(t):
    """A register for each segment, an entry for each customer: two actions, the first of Ann or Bob."""
    k = F.col("c_custkey")
    entry = F.concat(F.lit("### 2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" — Meeting "), k.cast("string"), F.lit("\n- **Action points:** "), F.when(k % 3 == 0, "[[Ann Lee|Ann]]").when(k % 3 == 1, "Ann").otherwise("Bob"), F.lit(" → write "), k.cast("string"), F.lit("; Team → rest.\n"))
    x = t.customer.groupBy(F.col("c_mktsegment").alias("register")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("c_custkey", entry.alias("e"))))["e"], "\n").alias("text"))
    return register.register_entries(x)


@query("register_entries", "SELECT c_mktsegment AS register, '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS date, 'Meeting ' || c_custkey AS meeting FROM customer")
def register_entries(t):
    return registers(t).select("register", "date", "meeting")


@query("register_actions", "SELECT c_mktsegment AS register, '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS date, 'Meeting ' || c_custkey AS meeting, 'write ' || c_custkey AS action FROM customer WHERE c_custkey % 3 <> 2")
def register_actions(t):
    return register.actions(registers(t), "Ann Lee", ["Ann"])


@query("actions_per_register", "SELECT c_mktsegment AS register, count(*) AS actions FROM customer WHERE c_custkey % 3 <> 2 GROUP BY ALL")
def actions_per_register(t):
    return register.per_register(register.actions(registers(t), "Ann Lee", ["Ann"]))


@query("join_ticks", "SELECT 'write ' || c_custkey AS action, c_custkey % 2 = 0 AS done FROM customer WHERE c_custkey % 3 <> 2")
def join_ticks(t):
    k = F.col("c_custkey")
    lines = t.customer.where(k % 2 == 0).select(F.concat(F.lit("- [x] **2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("** — write "), k.cast("string"), F.lit(" _([[x]])_")).alias("line"))
    return register.ticked(register.actions(registers(t), "Ann Lee", ["Ann"]), lines).select("action", "done")


@query("chunk_store", """SELECT CAST(doc_id AS VARCHAR) AS page_address, i AS chunk_index, CASE WHEN i = 0 AND doc_id % 5 = 0 THEN 'old' ELSE sha256(text || i) END AS body_hash FROM documents, unnest(range(0, doc_id % 3 + 1)) AS u(i)
UNION ALL SELECT 'gone-' || doc_id, 0, 'old' FROM documents""")
def chunk_store(t):
    """Every document is stored in up to four old chunks and under a page that is gone; a run over all documents rewrites them as up to three, some as they were."""
    k, same = F.col("doc_id"), F.lit("p").alias("page_body_hash")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), k % n)).alias("chunk_index")
    new = t.documents.select(k.cast("string").alias("page_address"), upto(3), "text", k).select("page_address", "chunk_index", F.when((F.col("chunk_index") == 0) & (k % 5 == 0), "old").otherwise(F.sha2(F.concat("text", F.col("chunk_index").cast("string")), 256)).alias("body_hash"), same)
    old = t.documents.select(k.cast("string").alias("page_address"), upto(4), F.lit("old").alias("body_hash"), same)
    old = old.unionByName(t.documents.select(F.concat(F.lit("gone-"), k.cast("string")).alias("page_address"), F.lit(0).cast("long").alias("chunk_index"), F.lit("old").alias("body_hash"), same))
    return sinks.chunk_store(new, old).select("page_address", "chunk_index", "body_hash")

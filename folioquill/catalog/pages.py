"""Link graph, lineage, lint and view queries; pages are built from the parts, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from ..functions import text as T
from ..operators import canvas, graph, lint, views
from ..sources import files
from .registry import query

AS_OF = "1998-12-31"
LONG = lambda c: c.cast("long")


def part_pages(t):
    """A page for each part that links its suppliers, and one for each even supplier; updated at the last shipment."""
    li = t.lineitem
    parts = li.groupBy("l_partkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda s: F.concat(F.lit("see [[suppliers/S"), s.cast("string"), F.lit("|a supplier]]"))), "\n").alias("body"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("updated"))
    parts = parts.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("stem"), "body", "updated")
    sup = t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("stem"), F.lit("```\n[[P1]]\n```\nto [[P2#part]]").alias("body"), F.lit(None).cast("string").alias("updated"))
    return parts.unionByName(sup).withColumn("created", F.lit(None).cast("string"))


PAGES = """
pages AS (
  SELECT 'P' || l_partkey AS stem, strftime(max(l_shipdate), '%Y-%m-%d') AS updated FROM lineitem GROUP BY l_partkey
  UNION ALL SELECT 'S' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 2 = 0),
links AS (
  SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem
  UNION ALL SELECT 'S' || s_suppkey, 'P2' FROM supplier WHERE s_suppkey % 2 = 0),
edges AS (SELECT src, dst FROM links WHERE dst IN (SELECT stem FROM pages)),
deg AS (
  SELECT stem, updated, (SELECT count(*) FROM edges e WHERE e.src = p.stem) AS out_degree, (SELECT count(*) FROM edges e WHERE e.dst = p.stem) AS in_degree FROM pages p)"""


@query("link_edges", f"WITH {PAGES} SELECT src, dst FROM edges")
def link_edges(t):
    return graph.link_edges(part_pages(t))


@query("degrees", f"WITH {PAGES} SELECT stem, out_degree, in_degree FROM deg")
def degrees(t):
    p = part_pages(t)
    return graph.degrees(p, graph.link_edges(p))


@query("boundary_score", f"""WITH {PAGES}, a AS (SELECT *, CASE WHEN updated IS NULL THEN 10000 ELSE greatest(date_diff('day', CAST(updated AS DATE), DATE '{AS_OF}'), 0) END AS age_days FROM deg)
SELECT stem, out_degree, in_degree, age_days, round(exp(-age_days / 30.0), 4) AS recency, round((out_degree - in_degree) * exp(-age_days / 30.0), 4) AS score FROM a WHERE round((out_degree - in_degree) * exp(-age_days / 30.0), 4) > 0""")
def boundary_score(t):
    p = part_pages(t)
    return graph.boundary_score(p, graph.link_edges(p), AS_OF)


@query("frontier_topk", f"""WITH {PAGES}, a AS (SELECT *, CASE WHEN updated IS NULL THEN 10000 ELSE greatest(date_diff('day', CAST(updated AS DATE), DATE '{AS_OF}'), 0) END AS age_days FROM deg)
SELECT stem, round((out_degree - in_degree) * exp(-age_days / 30.0), 4) AS score FROM a ORDER BY score DESC, stem LIMIT 10""")
def frontier_topk(t):
    p = part_pages(t)
    return graph.boundary_score(p, graph.link_edges(p), AS_OF, top=10).select("stem", "score")


@query("backlinks", f"WITH {PAGES} SELECT dst AS stem, count(*) AS n_backlinks, md5(string_agg(src, ',' ORDER BY src)) AS md5 FROM edges GROUP BY dst")
def backlinks(t):
    return graph.backlinks(graph.link_edges(part_pages(t))).select("stem", "n_backlinks", F.md5(F.array_join("backlinks", ",")).alias("md5"))


@query("anti_orphans", f"WITH {PAGES} SELECT stem FROM pages WHERE stem NOT IN (SELECT dst FROM edges) AND stem NOT LIKE '%0'")
def anti_orphans(t):
    p = part_pages(t)
    return graph.orphans(p, graph.link_edges(p), F.col("stem").endswith("0")).select("stem")


@query("anti_dead_links", f"WITH {PAGES} SELECT DISTINCT src, dst FROM links WHERE dst NOT IN (SELECT stem FROM pages)")
def anti_dead_links(t):
    return graph.dead_links(part_pages(t))


@query("query_modes", f"""WITH {PAGES}, s AS (SELECT stem FROM pages WHERE stem LIKE 'S%'), w AS (
  SELECT stem AS seed, stem, 0 AS depth FROM s UNION ALL SELECT stem, dst, 1 FROM s JOIN edges ON src = stem
  UNION ALL SELECT s.stem, b.dst, 2 FROM s JOIN edges a ON a.src = s.stem JOIN edges b ON b.src = a.dst) SELECT seed, stem, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY ALL""")
def query_modes(t):
    p = part_pages(t)
    return graph.within_depth(graph.link_edges(p), p.where("stem like 'S%'"))


@query("graph_view", f"""WITH {PAGES}, l AS (SELECT src AS stem FROM edges UNION SELECT dst FROM edges) SELECT stem, CASE WHEN stem LIKE 'P1%' THEN 'red' WHEN stem LIKE 'P%' THEN 'blue' END AS colour FROM l""")
def graph_view(t):
    p = part_pages(t).withColumn("path", F.concat(F.lit("wiki/"), "stem"))
    return graph.graph_view(p, graph.link_edges(p), [("wiki/P1", "red"), ("wiki/P", "blue")])


def lineage(t):
    """Each order supersedes its customer's order before; only filled ones know what superseded them."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = t.orders.select(F.col("o_orderkey").alias("page"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.col("o_orderstatus").alias("status"))
    return x, x.where("before is not null").select("page", F.col("before").alias("target")), x.where("after is not null and status = 'F'").select("page", F.col("after").alias("target"))


LINEAGE = """
o AS (SELECT o_orderkey AS page, o_orderstatus AS status, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n, last(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
sup AS (SELECT page, before AS target FROM o WHERE before IS NOT NULL), sby AS (SELECT page, after AS target FROM o WHERE after IS NOT NULL AND status = 'F')"""


@query("lineage_chains", """WITH o AS (SELECT o_orderkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS depth, count(*) OVER (PARTITION BY o_custkey) AS n,
  first(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS head FROM orders) SELECT head, page, depth FROM o WHERE n > 1""")
def lineage_chains(t):
    _, sup, _ = lineage(t)
    return graph.lineage_chains(sup, sup.select(F.col("target").alias("page"), F.col("page").alias("target")))


@query("chain_head", f"WITH {LINEAGE} SELECT page, head FROM o WHERE page <> head")
def chain_head(t):
    _, sup, _ = lineage(t)
    return graph.chain_head(sup.select(F.col("target").alias("page"), F.col("page").alias("target")))


@query("lineage_dangling", f"WITH {LINEAGE}, p AS (SELECT page FROM o WHERE status <> 'O') SELECT page, 'supersedes' AS field, target FROM sup WHERE target NOT IN (SELECT page FROM p) UNION ALL SELECT page, 'superseded_by', target FROM sby WHERE target NOT IN (SELECT page FROM p)")
def lineage_dangling(t):
    x, sup, by = lineage(t)
    return graph.dangling(x.where("status <> 'O'"), sup, by)


@query("lineage_asymmetry", f"""WITH {LINEAGE} SELECT page, 'supersedes' AS field, target FROM sup s WHERE NOT EXISTS (SELECT 1 FROM sby b WHERE b.page = s.target AND b.target = s.page)
UNION ALL SELECT page, 'superseded_by', target FROM sby b WHERE NOT EXISTS (SELECT 1 FROM sup s WHERE s.page = b.target AND s.target = b.page)""")
def lineage_asymmetry(t):
    x, sup, by = lineage(t)
    return graph.asymmetric(x, sup, by)


@query("lineage_cycles", "SELECT CAST(r_regionkey * 10 AS BIGINT) AS first_page, CAST(3 AS BIGINT) AS length FROM region")
def lineage_cycles(t):
    r = t.region.select((F.col("r_regionkey") * 10).cast("long").alias("a"))
    e = r.select(F.inline(F.array(*[F.struct((F.col("a") + i).alias("page"), (F.col("a") + (i + 1) % 3).alias("target")) for i in range(3)], F.struct((F.col("a") + 5).alias("page"), F.col("a").alias("target")))))
    return graph.lineage_cycles(e).select(F.get("members", F.lit(0)).alias("first_page"), "length")


@query("superseded_checks", f"WITH {LINEAGE} SELECT 'unmarked_superseded' AS \"check\", count(*) AS n FROM sby WHERE page % 2 = 0 UNION ALL SELECT 'links_superseded', count(*) FROM sup WHERE target IN (SELECT page FROM sby)")
def superseded_checks(t):
    x, sup, by = lineage(t)
    p = x.select(F.col("page").alias("stem"), F.when(F.col("page") % 2 == 0, "text").otherwise("[!stale]").alias("body"))
    return lint.superseded_checks(p, by.select(F.col("page").alias("stem")), sup.select(F.col("page").alias("src"), F.col("target").alias("dst"))).groupBy("check").agg(F.count("*").alias("n"))


def raw_pages(t):
    """Customer pages with frontmatter; every third lacks a status, every fifth an address."""
    c = F.col("c_custkey")
    fm = F.concat(
        F.lit("---\ntype: entity\ncreated: 1998-01-01\nupdated: '1998-06-01'\ntags:\n  - x\n"), F.when(c % 3 != 0, "status: seed\n").otherwise(""), F.when(c % 5 != 0, F.concat(F.lit("address: c-"), F.lpad((c % 100).cast("string"), 6, "0"), F.lit("\n"))).otherwise(""),
        F.lit("title: \""), F.col("c_name"), F.lit("\"\n---\n# "), F.col("c_name"), F.lit("\n\n## Empty\n\n## Full\n\n"), F.col("c_mktsegment"), F.lit("\n"))
    return files.page_fields(t.customer.select(F.concat(F.lit("wiki/"), F.col("c_mktsegment"), F.lit("/"), c.cast("string"), F.lit(".md")).alias("path"), fm.alias("raw"), F.lit(1).alias("size")))


@query("parse_frontmatter", "SELECT CAST(c_custkey AS VARCHAR) AS stem, 'wiki/' || c_mktsegment AS folder, 'entity' AS type, CASE WHEN c_custkey % 3 <> 0 THEN 'seed' END AS status, '1998-06-01' AS updated, c_name AS title, CASE WHEN c_custkey % 5 <> 0 THEN 'c-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 6, '0') END AS address FROM customer")
def parse_frontmatter(t):
    return raw_pages(t).select("stem", "folder", "type", "status", "updated", "title", "address")


@query("frontmatter_gaps", "SELECT CAST(c_custkey AS VARCHAR) AS page, 'status' AS detail FROM customer WHERE c_custkey % 3 = 0")
def frontmatter_gaps(t):
    return lint.frontmatter_gaps(raw_pages(t)).select("page", "detail")


@query("stale_seed", "SELECT CAST(c_custkey AS VARCHAR) AS page, CAST(date_diff('day', DATE '1998-06-01', DATE '1998-12-31') AS VARCHAR) AS detail FROM customer WHERE c_custkey % 3 <> 0")
def stale_seed(t):
    return lint.stale_seeds(raw_pages(t), AS_OF).select("page", "detail")


@query("empty_sections", "SELECT CAST(c_custkey AS VARCHAR) AS page, h AS detail FROM customer, (VALUES (c_name), ('Empty')) AS v(h)")
def empty_sections(t):
    return lint.empty_sections(raw_pages(t)).select("page", "detail")


@query("large_pages", "SELECT CAST(doc_id AS VARCHAR) AS page, CAST(len(string_split(text, chr(10))) AS VARCHAR) AS detail FROM documents WHERE len(string_split(text, chr(10))) > 20")
def large_pages(t):
    return lint.large_pages(t.documents.select(F.col("doc_id").alias("stem"), F.col("text").alias("body")), 20).select("page", "detail")


@query("address_format", "SELECT CAST(c_custkey AS VARCHAR) AS stem, CASE WHEN c_custkey % 5 <> 0 THEN 'valid' ELSE 'missing' END AS kind FROM customer")
def address_format(t):
    return lint.address_format(raw_pages(t), "1998-01-01").select("stem", "kind")


@query("address_unique", "SELECT min(CAST(c_custkey AS VARCHAR)) AS page, 'c-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 6, '0') AS detail FROM customer WHERE c_custkey % 5 <> 0 GROUP BY c_custkey % 100 HAVING count(*) > 1")
def address_unique(t):
    return lint.duplicate_addresses(raw_pages(t)).select("page", "detail")


@query("address_drift", "SELECT CAST(c_custkey AS VARCHAR) AS page FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 100 >= 90")
def address_drift(t):
    return lint.address_drift(raw_pages(t), 90).select("page")


@query("max_address", "SELECT CAST(max(c_custkey % 100) AS BIGINT) AS max_address FROM customer WHERE c_custkey % 5 <> 0")
def max_address(t):
    from ..operators.planning import max_address as largest

    return largest(raw_pages(t), "raw")


@query("address_map_check", "SELECT CAST(c_custkey AS VARCHAR) AS page, CASE WHEN c_custkey % 5 = 0 THEN 'no page' ELSE 'mismatch' END AS detail FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 100 > 50")
def address_map_check(t):
    p = raw_pages(t).select(F.col("stem").alias("path"), "address")
    m = t.customer.select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("c-"), F.lpad(F.least(F.col("c_custkey") % 100, F.lit(50)).cast("string"), 6, "0")).alias("address"))
    return lint.address_map_check(m, p).select("page", "detail")


@query("naming_rules", """WITH p AS (SELECT p_partkey AS k, 'Page ' || (p_partkey // 2) AS stem, CASE p_partkey % 4 WHEN 0 THEN 'wiki/' WHEN 1 THEN 'wiki/Big Folder/' WHEN 2 THEN '' ELSE 'wiki/a-b/' END AS folder FROM part),
n AS (SELECT count(DISTINCT stem) AS stems FROM p)
SELECT 'repeated_stem' AS "check", stem AS page, CAST(count(*) AS VARCHAR) AS detail FROM p GROUP BY stem HAVING count(*) > 1
UNION ALL SELECT 'folder_name', stem, folder FROM p WHERE folder = 'wiki/Big Folder/'
UNION ALL SELECT 'tag_case', stem, 'Tag' || k FROM p WHERE k % 3 = 0
UNION ALL SELECT 'link_case', stem, 'page ' || (k // 2) FROM p WHERE k % 5 = 0""")
def naming_rules(t):
    """Pages two by two under one stem, in four folders, with tags and links in two spellings."""
    k = F.col("p_partkey")
    half = F.floor(k / 2).cast("string")
    folder = F.when(k % 4 == 0, "wiki/").when(k % 4 == 1, "wiki/Big Folder/").when(k % 4 == 2, "").otherwise("wiki/a-b/")
    body = F.concat(F.lit("[["), F.when(k % 5 == 0, "page ").otherwise("Page "), half, F.lit("]] and [[Nowhere]]"))
    tags = F.array(F.concat(F.when(k % 3 == 0, "Tag").otherwise("tag"), k.cast("string")), F.lit("plain"))
    x = t.part.select(F.concat(F.lit("Page "), half).alias("stem"), F.concat(folder, F.lit("x.md")).alias("path"), tags.alias("tags"), body.alias("body"))
    return lint.naming(x).select("check", "page", F.col("detail").cast("string").alias("detail"))


@query("missing_pages", "SELECT l_shipmode AS page, CAST(count(DISTINCT l_orderkey) AS VARCHAR) AS detail FROM (SELECT l_orderkey, 'R' || (l_suppkey % 7) AS l_shipmode FROM lineitem) WHERE l_shipmode NOT IN (SELECT 'R' || r_regionkey FROM region) GROUP BY l_shipmode HAVING count(DISTINCT l_orderkey) >= 2")
def missing_pages(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("stem"), F.concat(F.lit("R"), (F.col("l_suppkey") % 7).cast("string")).alias("term"))
    return lint.missing_pages(m, t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("stem"))).select("page", "detail")


@query("missing_xrefs", "SELECT CAST(doc_id AS VARCHAR) AS page, w AS detail FROM documents, (VALUES ('License'), ('Apache'), ('BY-NC')) AS v(w) WHERE contains(text, w)")
def missing_xrefs(t):
    titles = t.spark.range(1).select(F.explode(F.array(F.lit("License"), F.lit("Apache"), F.lit("BY-NC"))).alias("title"))
    return lint.missing_xrefs(t.documents.select(F.col("doc_id").cast("string").alias("stem"), F.col("text").alias("body")), titles).select("page", "detail")


@query("contradiction_audit", """SELECT CAST(coalesce(c, o) AS VARCHAR) AS page, CASE WHEN o IS NULL THEN 'not registered' WHEN status = 'open' AND c IS NULL THEN 'no callout' ELSE 'open too long' END AS detail
FROM (SELECT c_custkey AS c FROM customer WHERE c_custkey % 3 <> 1) FULL JOIN (SELECT c_custkey AS o, CASE WHEN c_custkey % 4 = 0 THEN 'closed' ELSE 'open' END AS status, c_custkey % 5 AS k FROM customer WHERE c_custkey % 2 = 0) ON c = o WHERE o IS NULL OR (status = 'open' AND (c IS NULL OR k < 3))""")
def contradiction_audit(t):
    k = F.col("c_custkey")
    r = t.customer.where(k % 2 == 0).select(k.alias("key"), F.when(k % 4 == 0, "closed").otherwise("open").alias("status"), F.when(k % 5 < 3, "1998-01-01").otherwise("1998-12-30").alias("opened"))
    return lint.contradictions(t.customer.where(k % 3 != 1).select(k.alias("key")), r, AS_OF).select("page", "detail")


@query("defect_mining", "SELECT event_type AS tag, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3")
def defect_mining(t):
    return lint.defect_mining(t.events.select(F.col("event_type").alias("tag")))


@query("lint_summary", "SELECT 'warning' AS severity, count(*) FILTER (c_custkey % 3 = 0) + count(*) FILTER (c_custkey % 3 <> 0) AS issues, count(*) AS pages_scanned FROM customer UNION ALL SELECT 'suggestion', 2 * count(*), count(*) FROM customer")
def lint_summary(t):
    p = raw_pages(t)
    return lint.summary(p, lint.frontmatter_gaps(p), lint.stale_seeds(p, AS_OF), lint.empty_sections(p))


@query("markdown_table", "SELECT n_nationkey AS key, n_name || ',' || n_regionkey AS cells FROM nation")
def markdown_table(t):
    text = F.concat(F.lit("intro\n| name | region |\n|---|---|\n| "), "n_name", F.lit(" | "), F.col("n_regionkey").cast("string"), F.lit(" |\n"))
    x = lint.markdown_table(t.nation.select(F.col("n_nationkey").alias("key"), text.alias("text")))
    return x.where("pos > 1").select("key", F.array_join("cells", ",").alias("cells"))


# views


def part_notes(t):
    p = t.part
    return p.select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("wiki/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("wiki/"), F.col("p_brand")).alias("folder"),
        F.array(F.col("p_type"), F.when(F.col("p_size") > 25, "big").otherwise("small")).alias("tags"), F.col("p_size").alias("psize"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") % 2 == 0, "1998-12-01").alias("due"), F.col("p_partkey").alias("id"))


BASE = {
    "filters": {"and": ['psize > 10', {"or": ['file.hasTag("big")', "psize == 12"]}, {"not": ['file.inFolder("wiki/none")']}]},
    "formulas": {"days_left": 'if(due, (date(due) - today()).days, "")', "double": "(price * 2).round(1)", "size_class": 'if(psize >= 40, "large", if(psize > 25, "mid", "low"))'},
    "views": [{"type": "table", "name": "main", "order": ["name", "psize", "formula.days_left", "formula.double", "formula.size_class"], "filters": 'price < 1500 && name != "part 1"'},
              {"type": "list", "name": "top", "order": ["name", "psize"], "groupBy": {"property": "psize", "direction": "DESC"}, "limit": 7}],
}
NOTES = "n AS (SELECT 'part ' || p_partkey AS name, p_size AS psize, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN DATE '1998-12-01' END AS due, p_brand, p_partkey FROM part)"


@query("base_view", f"""WITH {NOTES} SELECT name, psize, CASE WHEN due IS NOT NULL THEN CAST(date_diff('day', DATE '{AS_OF}', due) AS INT) END AS formula_days_left, round(price * 2, 1) AS formula_double, CASE WHEN psize >= 40 THEN 'large' WHEN psize > 25 THEN 'mid' ELSE 'low' END AS formula_size_class
FROM n WHERE psize > 10 AND (psize > 25 OR psize = 12) AND price < 1500 AND name <> 'part 1'""")
def base_view(t):
    return views.run_view(part_notes(t), BASE, "main", AS_OF)


@query("base_group_limit", f"WITH {NOTES} SELECT name, psize FROM n WHERE psize > 10 AND (psize > 25 OR psize = 12) ORDER BY psize DESC, name LIMIT 7")
def base_group_limit(t):
    return views.run_view(part_notes(t), BASE, "top", AS_OF)


@query("base_summaries", "SELECT CAST(sum(p_size) AS BIGINT) AS psize, round(avg(p_retailprice), 4) AS price FROM part")
def base_summaries(t):
    return views.summarize(part_notes(t), {"psize": "Sum", "price": "Average"}).withColumn("price", F.round("price", 4))


@query("dataview", "SELECT 'part ' || p_partkey AS name, p_size AS psize FROM part WHERE p_size % 2 <> 0 OR p_size = 50 ORDER BY p_size DESC, name LIMIT 15")
def dataview(t):
    return views.dataview(part_notes(t), 'TABLE psize FROM "wiki" WHERE !due OR psize = 50 SORT psize DESC LIMIT 15')


@query("recent_activity", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15")
def recent_activity(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(15)


@query("dashboard_counts", """WITH p AS (SELECT CASE p_size % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'source' ELSE p_brand END AS type, p_type, CASE WHEN p_size % 2 = 0 THEN p_brand END AS b FROM part)
SELECT 'types' AS dashboard, type AS value, count(*) AS pages FROM p GROUP BY ALL UNION ALL SELECT 'entities', p_type, count(*) FROM p WHERE type = 'entity' GROUP BY ALL
UNION ALL SELECT 'sources', coalesce(b, ''), count(*) FROM p WHERE type = 'source' GROUP BY ALL""")
def dashboard_counts(t):
    k = F.col("p_size")
    kind = F.when(k % 3 == 0, "entity").when(k % 3 == 1, "source").otherwise(F.col("p_brand"))
    return lint.dashboards(t.part.select(kind.alias("type"), F.col("p_type").alias("entity_type"), F.when(k % 2 == 0, F.col("p_brand")).alias("source_type")))


def boards(t):
    k = F.col("p_partkey")
    nodes = t.part.select(F.col("p_brand").alias("canvas"), F.concat(F.lit("n"), k.cast("string")).alias("id"), F.lit("text").alias("type"), ((k * 37) % 1000).cast("int").alias("x"), ((k * 91) % 800).cast("int").alias("y"), (100 + k % 50).cast("int").alias("width"), F.lit(60).alias("height"))
    zones = t.part.select(F.col("p_brand").alias("canvas")).distinct().select("canvas", F.inline(F.array(*[F.struct(F.lit(f"z{i}").alias("id"), F.lit(i * 300).alias("x"), F.lit(i * 200).alias("y"), F.lit(300).alias("width"), F.lit(200).alias("height")) for i in range(4)])))
    return nodes, zones


BOARD = """n AS (SELECT p_brand AS canvas, 'n' || p_partkey AS id, (p_partkey * 37) % 1000 AS x, (p_partkey * 91) % 800 AS y, 100 + p_partkey % 50 AS width, 60 AS height FROM part),
z AS (SELECT DISTINCT p_brand AS canvas, 'z' || i AS zone, i * 300 AS x, i * 200 AS y FROM part, range(4) AS r(i)),
m AS (SELECT z.canvas, z.zone, z.x AS zx, z.y AS zy, n.* EXCLUDE (canvas) FROM z JOIN n ON n.canvas = z.canvas AND n.x >= z.x AND n.x < z.x + 300 AND n.y >= z.y AND n.y < z.y + 200)"""


@query("theta_rect_contains", f"WITH {BOARD} SELECT canvas, zone, id FROM m")
def theta_rect_contains(t):
    return canvas.zone_members(*boards(t))


@query("canvas_next_position", f"""WITH {BOARD}, a AS (SELECT canvas, zone, max(x + width) AS r, max(y + height) AS b, min(y) AS top FROM m GROUP BY ALL)
SELECT z.canvas, z.zone, CAST(CASE WHEN r + 140 <= z.x + 300 THEN r + 40 ELSE z.x + 20 END AS BIGINT) AS x, CAST(CASE WHEN r IS NULL THEN z.y + 20 WHEN r + 140 <= z.x + 300 THEN top ELSE b + 20 END AS BIGINT) AS y FROM z LEFT JOIN a ON a.canvas = z.canvas AND a.zone = z.zone""")
def canvas_next_position(t):
    nodes, zones = boards(t)
    return canvas.next_position(nodes, zones, 100)


@query("image_size", "SELECT p_partkey, CASE WHEN r > 2.0 THEN 440 WHEN r >= 1.6 THEN 420 WHEN r >= 1.2 THEN 380 WHEN r > 1.1 THEN 320 WHEN r >= 0.9 THEN 280 WHEN r >= 0.6 THEN 240 ELSE 200 END AS width FROM (SELECT p_partkey, p_size / 20.0 AS r FROM part)")
def image_size(t):
    return t.part.select("p_partkey", canvas.image_size(F.col("p_size"), F.lit(20.0))["width"].alias("width"))

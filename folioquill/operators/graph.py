"""Link graph, frontier score, backlinks and version lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import text as T
from ..storage import materialize, tidy

DAYS, NEVER = 30.0, 10_000
#: Pages that are never scored.
EXCLUDED_TYPES = ("meta", "fold")
EXCLUDED_NAMES = ("_index.md", "index.md", "log.md", "hot.md", "overview.md", "dashboard.md", "Wiki Map.md", "getting-started.md")
EXCLUDED_FOLDERS = ("wiki/folds/", "wiki/meta/")
LINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def scoreable(path: Column, kind: Column) -> Column:
    """A page that counts: no excluded name, folder or type; a page without a type counts."""
    name = F.substring_index(path, "/", -1)
    return ~name.isin(*EXCLUDED_NAMES) & ~path.startswith(EXCLUDED_FOLDERS[0]) & ~path.startswith(EXCLUDED_FOLDERS[1]) & ~F.coalesce(kind, F.lit("")).isin(*EXCLUDED_TYPES)


def last_per_stem(pages: DataFrame, stem: str = "stem", path: str = "path") -> DataFrame:
    """One page for each stem: the last by path."""
    best = pages.groupBy(F.col(stem).alias("_stem")).agg(F.max(path).alias("_path"))
    return pages.join(best, (F.col(stem) == F.col("_stem")) & (F.col(path) == F.col("_path")), "left_semi")


def outside_fences(body: Column) -> Column:
    """The body without fenced code: a fence closes with its own mark, at least as long. Indented text stays."""
    start = F.struct(F.lit("").alias("mark"), F.array().cast("array<string>").alias("kept"))

    def add(a, line):
        mark = F.regexp_extract(line, r"\A\s*(`{3,}|~{3,})", 1)
        opens = (a["mark"] == "") & (mark != "")
        closes = (a["mark"] != "") & (mark != "") & (F.substring(mark, 1, 1) == F.substring(a["mark"], 1, 1)) & (F.length(mark) >= F.length(a["mark"]))
        return F.struct(
            F.when(opens, mark).when(closes, F.lit("")).otherwise(a["mark"]).alias("mark"),
            F.when((a["mark"] == "") & ~opens, F.array_append(a["kept"], line)).otherwise(a["kept"]).alias("kept"),
        )

    lines = F.split(body, r"\r\n|\n|\r")
    folded = F.array_join(F.aggregate(lines, start, add, lambda a: a["kept"]), "\n")
    return F.when(body.rlike(r"(?m)^\s*(`{3,}|~{3,})"), folded).otherwise(body)


def wikilinks(body: Column) -> Column:
    """Distinct link targets: trimmed, without alias, heading and folder."""
    raw = F.regexp_extract_all(outside_fences(body), F.lit(LINK), F.lit(1))
    stems = F.transform(raw, lambda r: F.substring_index(T.strip(r), "/", -1))
    return F.array_distinct(F.filter(stems, lambda s: s != ""))


def link_edges(pages: DataFrame, stem: str = "stem", body: str = "body") -> DataFrame:
    """(src, dst) between pages of the table, without self links or repeats."""
    out = pages.select(F.col(stem).alias("src"), F.explode(wikilinks(F.col(body))).alias("dst"))
    known = pages.select(F.col(stem).alias("dst")).distinct().hint("shuffle_hash")  # names are hashed, so links need no sort
    return out.where("src <> dst").join(known, "dst", "left_semi").select("src", "dst").distinct()


def degrees(pages: DataFrame, edges: DataFrame, stem: str = "stem") -> DataFrame:
    """(stem, out_degree, in_degree) of every page."""
    out = edges.groupBy(F.col("src").alias("stem")).agg(F.count_distinct("dst").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("stem")).agg(F.count_distinct("src").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pages.select(F.col(stem).alias("stem")).join(out, "stem", "left").join(into, "stem", "left").select("stem", zero("out_degree"), zero("in_degree"))


def age_days(updated: Column, created: Column, as_of: str) -> Column:
    """Days since the update, else the creation; never negative; no readable date counts as very long ago."""
    day = F.try_to_date(F.coalesce(F.nullif(updated, F.lit("")), created), "yyyy-MM-dd")
    return F.coalesce(F.greatest(F.datediff(F.lit(as_of).cast("date"), day), F.lit(0)), F.lit(NEVER))


def boundary_score(pages: DataFrame, edges: DataFrame, as_of: str, top: int | None = None, zeros: bool = False) -> DataFrame:
    """(stem, out_degree, in_degree, age_days, recency, score): links out less links in, fading with age.

    pages: (stem, updated, created). Only positive scores are kept unless ``zeros``.
    """
    x = degrees(pages, edges).join(pages.select("stem", age_days(F.col("updated"), F.col("created"), as_of).cast("long").alias("age_days")), "stem")
    fade = F.exp(-F.col("age_days") / DAYS)
    x = x.withColumn("recency", F.round(fade, 4)).withColumn("score", F.round((F.col("out_degree") - F.col("in_degree")) * fade, 4))
    x = x if zeros else x.where("score > 0")
    return x.orderBy(F.desc("score"), "stem").limit(top) if top else x


def backlinks(edges: DataFrame) -> DataFrame:
    """(stem, n_backlinks, backlinks): pages that link to each page, sorted."""
    return edges.groupBy(F.col("dst").alias("stem")).agg(F.count_distinct("src").alias("n_backlinks"), F.sort_array(F.collect_set("src")).alias("backlinks"))


def orphans(pages: DataFrame, edges: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Pages that no page links to; ``exempt`` ones (seeded stubs) do not count."""
    x = pages.join(edges.select(F.col("dst").alias("stem")), "stem", "left_anti")
    return x if exempt is None else x.where(~F.coalesce(exempt, F.lit(False)))


def dead_links(pages: DataFrame, stem: str = "stem", body: str = "body") -> DataFrame:
    """(src, dst) whose target is no page."""
    out = pages.select(F.col(stem).alias("src"), F.explode(wikilinks(F.col(body))).alias("dst"))
    known = pages.select(F.col(stem).alias("dst")).distinct().hint("shuffle_hash")
    return out.join(known, "dst", "left_anti").select("src", "dst").distinct()


# Lineage: supersedes (page, target) and superseded_by (page, target).


def lineage_targets(value: Column) -> Column:
    """Targets of a lineage field: links if there are any, else bare names of a scalar, inline list or block list."""
    links = F.transform(F.regexp_extract_all(value, F.lit(LINK), F.lit(1)), lambda x: F.substring_index(T.strip(x), "/", -1))
    bare = F.split(F.regexp_replace(value, r"(?m)^[ \t]*-[ \t]+|[\[\]'\"]", ""), r"[,\n]")
    bare = F.filter(F.transform(bare, T.strip), lambda x: x != "")
    return F.array_distinct(F.when(F.size(links) > 0, links).otherwise(bare))


def dangling(pages: DataFrame, supersedes: DataFrame, superseded_by: DataFrame) -> DataFrame:
    """(page, field, target) whose target is no page."""
    both = supersedes.withColumn("field", F.lit("supersedes")).unionByName(superseded_by.withColumn("field", F.lit("superseded_by")))
    return both.join(pages.select(F.col("page").alias("target")), "target", "left_anti").select("page", "field", "target")


def asymmetric(pages: DataFrame, supersedes: DataFrame, superseded_by: DataFrame) -> DataFrame:
    """(page, field, target) without the inverse field on an existing target."""
    def one(edges, inverse, field):
        back = inverse.select(F.col("target").alias("page"), F.col("page").alias("target"))
        there = pages.select(F.col("page").alias("target"))
        return edges.join(back, ["page", "target"], "left_anti").join(there, "target", "left_semi").select("page", F.lit(field).alias("field"), "target")

    return one(supersedes, superseded_by, "supersedes").unionByName(one(superseded_by, supersedes, "superseded_by"))


def lineage_cycles(supersedes: DataFrame, limit: int = 100) -> DataFrame:
    """(members, length): one row for each cycle, its pages sorted. Paths stop at their first repeat, and after ``limit`` steps."""
    return supersedes.sparkSession.sql(f"""
        WITH RECURSIVE walk(start, node, path) MAX RECURSION LEVEL {limit} AS (
          SELECT page, target, array(page) FROM {{edges}}
          UNION ALL
          SELECT w.start, e.target, array_append(w.path, w.node) FROM walk w JOIN {{edges}} e ON e.page = w.node
          WHERE w.node <> w.start AND NOT array_contains(w.path, w.node))
        SELECT DISTINCT array_sort(path) AS members, CAST(size(path) AS BIGINT) AS length FROM walk WHERE node = start""", edges=supersedes)


def _twice(steps: DataFrame) -> DataFrame:
    """(page, target) two of the given steps apart."""
    second = steps.select(F.col("page").alias("target"), F.col("target").alias("_far"))
    return materialize(steps.join(second, "target").select("page", F.col("_far").alias("target")).distinct(), "steps")


@tidy
def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(head, page, depth): the pages that each head reaches over edges (page, target), and in how few steps; itself in 0.

    Steps double in every round, so chains of n pages take log n rounds; forks and cycles add pages, not paths.
    Rounds end when one finds no page: every page on a shortest way lies in the round before.
    """
    steps = materialize(edges.select("page", "target").where("page is not null and target is not null").distinct(), "steps")
    found = materialize(starts.select(F.col("page").alias("head"), "page", F.lit(0).cast("long").alias("depth")).distinct(), "found")
    n, size = found.count(), 1
    while True:
        more = found.join(steps, "page").select("head", F.col("target").alias("page"), (F.col("depth") + size).alias("depth"))
        found = materialize(found.unionByName(more).groupBy("head", "page").agg(F.min("depth").alias("depth")), "found", keep=True)
        now = found.count()
        if now == n:
            return found
        n, size, steps = now, 2 * size, _twice(steps)


def lineage_chains(supersedes: DataFrame, superseded_by: DataFrame) -> DataFrame:
    """(head, page, depth): what every current version goes back to. A head supersedes and is superseded by none; a shared ancestor stands in each chain."""
    heads = supersedes.select("page").distinct().join(superseded_by.select("page"), "page", "left_anti").join(supersedes.select(F.col("target").alias("page")), "page", "left_anti")
    return reached(heads, supersedes)


@tidy
def chain_head(superseded_by: DataFrame) -> DataFrame:
    """(page, head): the last version that each superseded page leads to; the smallest name if there are several, none from a closed cycle."""
    steps = materialize(superseded_by.select("page", "target").where("page is not null and target is not null").distinct(), "steps", keep=True)
    pages = steps.select("page").distinct()
    last = steps.select(F.col("target").alias("page")).distinct().join(pages, "page", "left_anti")
    ends = materialize(last.select("page", F.col("page").alias("head")), "ends", keep=True)
    for _ in range(max(1, pages.count()).bit_length() + 1):  # no shortest way is longer than there are pages
        if steps.isEmpty():
            break
        through = steps.join(ends.select(F.col("page").alias("target"), "head"), "target").select("page", "head")
        ends = materialize(ends.unionByName(through).groupBy("page").agg(F.min("head").alias("head")), "ends", keep=True)
        steps = _twice(steps)
    return ends.join(pages, "page", "left_semi")


def within_depth(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, stem, depth): pages that a seed reaches in at most ``depth`` links; the shortest way counts."""
    found = seeds.select(F.col("stem").alias("seed"), "stem", F.lit(0).alias("depth"))
    step = found
    for d in range(1, depth + 1):
        step = step.join(edges, step["stem"] == edges["src"]).select("seed", F.col("dst").alias("stem"), F.lit(d).alias("depth")).distinct()
        found = found.unionByName(step)
    return found.groupBy("seed", "stem").agg(F.min("depth").cast("long").alias("depth"))


def graph_view(pages: DataFrame, edges: DataFrame, colours: list[tuple[str, str]], root: str = "wiki/") -> DataFrame:
    """(stem, colour): pages under the root that have a link, coloured by the first matching folder."""
    inside = pages.where(F.col("path").startswith(root))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("stem")).distinct()  # so the join sorts stems, not edges
    colour = F.when(F.lit(False), F.lit(""))
    for folder, name in colours:
        colour = colour.when(F.col("path").startswith(folder), name)
    return inside.join(linked, "stem", "left_semi").select("stem", colour.otherwise(F.lit(None)).alias("colour"))

"""Checks of a page collection. Each gives (check, severity, page, detail) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .graph import wikilinks

REQUIRED = ("type", "status", "created", "updated", "tags")


def finding(df: DataFrame, check: str, severity: str, page: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), page.cast("string").alias("page"), detail.cast("string").alias("detail"))


def frontmatter_gaps(pages: DataFrame) -> DataFrame:
    """Missing required fields of pages (stem, raw)."""
    block = T.frontmatter(F.col("raw"))
    missing = F.array_compact(F.array(*[F.when(~block.rlike(rf"(?m)^{k}:"), F.lit(k)) for k in REQUIRED]))
    x = pages.withColumn("_m", missing).where(F.size("_m") > 0)
    return finding(x, "frontmatter_gap", "warning", F.col("stem"), F.array_join("_m", ","))


def empty_sections(pages: DataFrame) -> DataFrame:
    """Headings of pages (stem, body) with nothing before the next heading of their level or above, or the end."""
    x = pages.select("stem", F.split(F.concat(F.lit("\n"), "body"), r"\n(?=#{1,6}[ \t])").alias("p")).select("stem", F.explode(F.slice("p", 2, 1 << 20)).alias("part"))
    return finding(x.where(T.strip(F.regexp_replace("part", r"\A[^\n]*", "")) == ""), "empty_section", "suggestion", F.col("stem"), F.regexp_extract("part", r"\A#{1,6}[ \t]+(.*?)[ \t]*(\n|\z)", 1))


def large_pages(pages: DataFrame, limit: int = 300) -> DataFrame:
    n = F.size(F.split("body", "\n"))
    return finding(pages.where(n > limit), "large_page", "suggestion", F.col("stem"), n)


def stale_seeds(pages: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Pages (stem, status, updated) still seeds long after their update."""
    age = F.datediff(F.lit(as_of).cast("date"), F.try_to_date("updated", "yyyy-MM-dd"))
    return finding(pages.where((F.col("status") == "seed") & (age > days)), "stale_seed", "warning", F.col("stem"), age)


def address_format(pages: DataFrame, rollout: str) -> DataFrame:
    """(stem, address, kind): how a page (stem, kind, address, created) stands to creation addresses."""
    valid = F.coalesce(F.col("address").rlike(r"\A[cl]-[0-9]{6}\z"), F.lit(False))
    kind = F.when(F.col("type").isin("meta", "fold"), "meta").when(valid, "valid").when(F.coalesce("address", F.lit("")) != "", "malformed").when(F.col("created") >= rollout, "missing").otherwise("legacy")
    return pages.select("stem", "address", kind.alias("kind"))


def duplicate_addresses(pages: DataFrame) -> DataFrame:
    x = pages.where("address is not null and address <> ''").groupBy("address").agg(F.count("*").alias("n"), F.min("stem").alias("stem")).where("n > 1")
    return finding(x, "duplicate_address", "critical", F.col("stem"), F.col("address"))


def address_drift(pages: DataFrame, counter: int) -> DataFrame:
    """Addresses at or past the counter."""
    n = F.regexp_extract(F.coalesce("address", F.lit("")), r"\Ac-(\d{6})\z", 1)
    return finding(pages.where((n != "") & (n.try_cast("long") >= counter)), "address_drift", "critical", F.col("stem"), F.col("address"))


def address_map_check(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Paths whose mapped address differs from the page's, or stands on one side only."""
    x = manifest.select("path", F.col("address").alias("mapped")).join(pages.where("address is not null").select("path", "address"), "path", "full")
    kind = F.when(F.col("address").isNull(), "no page").when(F.col("mapped").isNull(), "not mapped").when(F.col("address") != F.col("mapped"), "mismatch")
    return finding(x.withColumn("_k", kind).where("_k is not null"), "address_map", "warning", F.col("path"), F.col("_k"))


def naming(pages: DataFrame) -> DataFrame:
    """Pages (stem, path, and where given tags, an array, and body) against the naming rules.

    Findings: repeated stems, folders that are not lower-case with dashes, tags that are not lower-case, and
    links that name a page but for the case of their letters.
    """
    twice = pages.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")
    folder = F.regexp_extract("path", r"\A(.*/)[^/]*\z", 1)
    odd = pages.where((folder != "") & ~folder.rlike(r"\A([a-z0-9\-]+/)+\z"))
    out = finding(twice, "repeated_stem", "warning", F.col("stem"), F.col("n")).unionByName(finding(odd, "folder_name", "suggestion", F.col("stem"), folder))
    if "tags" in pages.columns:
        tags = pages.select("stem", F.explode(F.array_distinct("tags")).alias("tag")).where(F.col("tag") != F.lower("tag"))
        out = out.unionByName(finding(tags, "tag_case", "suggestion", F.col("stem"), F.col("tag")))
    if "body" in pages.columns:
        links = pages.select("stem", F.explode(wikilinks(F.col("body"))).alias("link")).join(pages.select(F.col("stem").alias("link")).distinct(), "link", "left_anti")
        near = pages.select(F.lower("stem").alias("_low")).distinct()
        out = out.unionByName(finding(links.distinct().join(near, F.lower("link") == F.col("_low"), "left_semi"), "link_case", "warning", F.col("stem"), F.col("link")))
    return out


def dashboards(pages: DataFrame) -> DataFrame:
    """(dashboard, value, pages): pages by type, entities by entity_type and sources by source_type, of pages (type, entity_type, source_type)."""
    kinds = {"types": F.col("type"), "entities": F.when(F.col("type") == "entity", F.coalesce("entity_type", F.lit(""))), "sources": F.when(F.col("type") == "source", F.coalesce("source_type", F.lit("")))}
    x = pages.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dashboard"), v.alias("value")) for k, v in kinds.items()])).alias("d")).select("d.*")
    return x.where("value is not null").groupBy("dashboard", "value").agg(F.count("*").alias("pages"))


def missing_xrefs(pages: DataFrame, titles: DataFrame, limit: int = 100_000) -> DataFrame:
    """Titles that a body mentions without a link. The titles are checked to be few and broadcast."""
    if titles.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} titles")
    x = pages.select("stem", "body", wikilinks(F.col("body")).alias("links")).join(F.broadcast(titles.select("title")), F.contains("body", "title"))
    x = x.where((F.col("title") != F.col("stem")) & ~F.array_contains("links", F.col("title")))
    return finding(x, "missing_xref", "suggestion", F.col("stem"), F.col("title"))


def missing_pages(mentions: DataFrame, pages: DataFrame, least: int = 2) -> DataFrame:
    """Terms (stem, term) that ``least`` pages mention and no page has."""
    x = mentions.join(pages.select(F.col("stem").alias("term")), "term", "left_anti").groupBy("term").agg(F.count_distinct("stem").alias("n")).where(F.col("n") >= least)
    return finding(x, "missing_page", "suggestion", F.col("term"), F.col("n"))


def superseded_checks(pages: DataFrame, superseded: DataFrame, edges: DataFrame) -> DataFrame:
    """Superseded pages without a stale mark, and pages that link to superseded ones."""
    unmarked = pages.join(superseded.select("stem"), "stem", "left_semi").where(~F.contains("body", F.lit("[!stale]")))
    into = edges.join(superseded.select(F.col("stem").alias("dst")), "dst", "left_semi")
    return finding(unmarked, "unmarked_superseded", "warning", F.col("stem"), F.lit("")).unionByName(finding(into, "links_superseded", "suggestion", F.col("src"), F.col("dst")))


def contradictions(callouts: DataFrame, register: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Contradiction callouts (key) against register rows (key, status, opened)."""
    x = callouts.select("key", F.lit(1).alias("_c")).distinct().join(register, "key", "full")
    age = F.datediff(F.lit(as_of).cast("date"), F.try_to_date("opened", "yyyy-MM-dd"))
    kind = F.when(F.col("status").isNull(), "not registered").when((F.col("status") == "open") & F.col("_c").isNull(), "no callout").when((F.col("status") == "open") & (age > days), "open too long")
    return finding(x.withColumn("_k", kind).where("_k is not null"), "contradiction", "warning", F.col("key"), F.col("_k"))


def defect_mining(defects: DataFrame, least: int = 3) -> DataFrame:
    """(tag, n): root causes that recur."""
    return defects.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def markdown_table(pages: DataFrame) -> DataFrame:
    """(key, pos, cells): rows of the pipe tables in pages (key, text), without their rules."""
    x = pages.select("key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\A\s*\|.*\|\s*\z") & ~F.col("line").rlike(r"\A[\s|:\-]+\z"))
    return x.select("key", "pos", F.transform(F.split(F.regexp_replace("line", r"\A\s*\||\|\s*\z", ""), r"\|"), T.strip).alias("cells"))


def summary(pages: DataFrame, *findings: DataFrame) -> DataFrame:
    """(severity, issues, pages_scanned)."""
    x = reduce(DataFrame.unionByName, findings).groupBy("severity").agg(F.count("*").alias("issues"))
    return x.crossJoin(F.broadcast(pages.agg(F.count("*").alias("pages_scanned"))))


def content_search(pages: DataFrame, pattern: str, regex: bool = False, column: str = "body") -> DataFrame:
    return pages.where(F.col(column).rlike(pattern) if regex else F.contains(column, F.lit(pattern)))

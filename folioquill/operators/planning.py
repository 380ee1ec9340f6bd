"""Ingestion planning: depths, routes, addresses, queues, manifests, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import text as T
from ..storage import materialize

LARGE = 2_000_000
DEPTHS = ("full", "summary", "catalogue", "skip")
#: File names and suffixes by kind.
JUNK = ("desktop.ini", "thumbs.db", ".ds_store")
STRUCTURED = (".xlsx", ".xls", ".xlsm", ".csv", ".tsv", ".ods")
DECKS = (".pptx", ".ppt", ".odp")
DOCUMENTS = (".pdf", ".docx", ".doc", ".md", ".txt", ".rtf", ".odt", ".html", ".htm")
CONVERTED = (".pdf", ".docx", ".doc", ".pptx", ".html", ".htm", ".eml", ".msg")
PASSED = (".md", ".txt")
LEFT_ALONE = (".xlsx", ".xls", ".xlsm", ".csv")
#: Folders by mode and content type; {slug} and {name} are filled in, {id} is minted.
ROUTES = {
    ("generic", "source"): "wiki/sources/{slug}.md", ("generic", "entity"): "wiki/entities/{name}.md", ("generic", "concept"): "wiki/concepts/{name}.md",
    ("generic", "session"): "wiki/sessions/{slug}.md", ("generic", "research"): "wiki/concepts/{name}.md",
    ("lyt", "source"): "wiki/notes/{slug}.md", ("lyt", "entity"): "wiki/notes/{slug}.md", ("lyt", "concept"): "wiki/notes/{slug}.md",
    ("lyt", "session"): "wiki/notes/{slug}.md", ("lyt", "research"): "wiki/notes/{slug}.md",
    ("para", "source"): "wiki/resources/incoming/{slug}.md", ("para", "entity"): "wiki/resources/people/{name}.md", ("para", "concept"): "wiki/resources/concepts/{name}.md",
    ("para", "session"): "wiki/projects/inbox/{slug}.md", ("para", "research"): "wiki/resources/{slug}/{slug}.md",
    ("zettelkasten", "source"): "wiki/{id}-{slug}.md", ("zettelkasten", "entity"): "wiki/{id}-{slug}.md", ("zettelkasten", "concept"): "wiki/{id}-{slug}.md",
    ("zettelkasten", "session"): "wiki/{id}-{slug}.md", ("zettelkasten", "research"): "wiki/{id}-{slug}.md",
}


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/\\]*)\z", 1))


def suffix(path: Column) -> Column:
    """Last suffix of the file name, lower-cased; a leading dot starts a name, not a suffix."""
    return F.regexp_extract(basename(path), r"\A.+(\.[^.]+)\z", 1)


def depth(path: Column, size: Column, large: int = LARGE) -> Column:
    """(depth, reason) proposed for a file."""
    says = lambda d, r: F.struct(F.lit(d).alias("depth"), F.lit(r).alias("reason"))
    ext = suffix(path)
    return (
        F.when(basename(path).isin(*JUNK), says("skip", "os-junk")).when(ext.isin(*STRUCTURED), says("catalogue", "structured-data")).when(ext.isin(*DECKS), says("summary", "slide-deck"))
        .when(ext.isin(*DOCUMENTS) & (size > large), says("summary", f"large-document (> {large} bytes)")).when(ext.isin(*DOCUMENTS), says("full", "document")).otherwise(says("full", "default")))


def convert_route(path: Column) -> Column:
    ext = suffix(path)
    return F.when(ext.isin(*PASSED), "passthrough").when(ext.isin(*LEFT_ALONE), "policy-skip").when(ext.isin(*CONVERTED), "convert").otherwise("no-handler")


def merge_plan(plan: DataFrame, proposed: DataFrame) -> DataFrame:
    """(path, depth, reason, override): proposals over the stored plan, except where a row was overridden by hand."""
    p = proposed.select("path", F.col("depth").alias("_depth"), F.col("reason").alias("_reason"))
    x = plan.join(p, "path", "full")
    keep = F.coalesce(F.col("override"), F.lit(False)) | F.col("_depth").isNull()
    return x.select("path", F.when(keep, F.col("depth")).otherwise(F.col("_depth")).alias("depth"), F.when(keep, F.col("reason")).otherwise(F.col("_reason")).alias("reason"), F.coalesce("override", F.lit(False)).alias("override"))


def plan_lookup(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, depth), 'full' for paths without a plan."""
    return paths.select("path").join(plan.select("path", "depth"), "path", "left").select("path", F.coalesce("depth", F.lit("full")).alias("depth"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: counts per depth, zeros too, total and overrides."""
    return plan.agg(*[F.count_if(F.col("depth") == d).alias(d) for d in DEPTHS], F.count("*").alias("total"), F.count_if("override").alias("overrides"))


def route(mode: Column, kind: Column, name: Column, minted: Column | None = None, slug: Column | None = None, safe: Column | None = None) -> Column:
    """Path for new content; null for an unknown mode or type. Only the id mode needs ``minted``.

    ``slug`` and ``safe``: the name's slug and safe form, where the caller has them as columns; else every branch makes its own.
    """
    fill = {"slug": T.slugify(name) if slug is None else slug, "name": T.safe_name(name) if safe is None else safe, "id": F.lit("") if minted is None else minted}
    out = F.when(F.lit(False), F.lit(""))
    for (m, k), pattern in ROUTES.items():
        parts = [F.lit(p) if i % 2 == 0 else fill[p] for i, p in enumerate(pattern.replace("{", "\0").replace("}", "\0").split("\0"))]
        out = out.when((mode == m) & (kind == k), F.concat(*parts))
    return out


def routes(names: DataFrame, name: str, modes: tuple[str, ...], kinds: tuple[str, ...], minted: Column | None = None) -> DataFrame:
    """Every row of names once for each mode and kind, with (mode, kind, path).

    Slugs are cut once a row, before rows multiply, and the rows are dealt anew: a small file is one task, its product is not.
    """
    x = names.repartition(*names.columns).select("*", T.slugify(F.col(name)).alias("_slug"), T.safe_name(F.col(name)).alias("_safe"))
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("kind")) for m in modes for k in kinds])
    x = x.select("*", F.explode(each).alias("_to")).select("*", "_to.mode", "_to.kind")
    return x.select(*names.columns, "mode", "kind", route(F.col("mode"), F.col("kind"), F.col(name), minted, F.col("_slug"), F.col("_safe")).alias("path"))


#: The settings of each mode where none are stored.
MODE_DEFAULTS = {
    "lyt": {"moc_folder": "wiki/mocs/", "notes_folder": "wiki/notes/"},
    "para": {"projects_folder": "wiki/projects/", "areas_folder": "wiki/areas/", "resources_folder": "wiki/resources/", "archives_folder": "wiki/archives/"},
    "zettelkasten": {"id_format": "YYYYMMDDHHMMSSffffff", "no_folders": "true", "root_folder": "wiki/"},
    "generic": {"sources_folder": "wiki/sources/", "entities_folder": "wiki/entities/", "concepts_folder": "wiki/concepts/", "sessions_folder": "wiki/sessions/"},
}


def mode_config(stored: Column) -> Column:
    """Struct (mode, configured_at, config) of a stored settings text (JSON): what it says of the known modes goes over the defaults.

    Null or unreadable text gives the defaults, mode 'generic'.
    """
    found = F.from_json(stored, "mode string, configured_at string, config map<string,map<string,string>>")
    no = F.create_map().cast("map<string,string>")
    sections = []
    for mode, values in MODE_DEFAULTS.items():
        own = F.coalesce(F.element_at(found["config"], mode), no)
        defaults = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        sections += [F.lit(mode), F.map_concat(F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)]
    return F.struct(F.coalesce(found["mode"], F.lit("generic")).alias("mode"), found["configured_at"].alias("configured_at"), F.create_map(*sections).alias("config"))


#: Folder of a saved note by its type.
SAVES = {"synthesis": "wiki/questions/", "concept": "wiki/concepts/", "source": "wiki/sources/", "decision": "wiki/meta/", "session": "wiki/meta/"}


def save_folder(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, folder in SAVES.items():
        out = out.when(kind == k, folder)
    return out.otherwise("wiki/questions/")


def numbered(df: DataFrame, *order: Column, start: int = 0, out: str = "n") -> DataFrame:
    """Consecutive numbers in a total order of columns by name, without gathering the rows in one task.

    Rows are range-dealt and written with their partition once, so that counts and numbers are of the same
    partitions: each partition's running count, a row for each, is joined to its rows' own numbers. Rows
    that are equal in ``order`` are numbered in any order; an empty table gives no rows.
    """
    x = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered", keep=True)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = x.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    y = x.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order))).join(F.broadcast(base), "_part")
    return y.select(*df.columns, (F.col("_base") + F.col("_row") + (start - 1)).cast("long").alias(out))


def max_address(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row, max_address: the largest creation address in any frontmatter, 0 without one."""
    n = F.regexp_extract(T.frontmatter(F.col(text)), r"(?m)^address:[ \t]*c-(\d{6})[ \t]*$", 1)
    return texts.agg(F.coalesce(F.max(F.nullif(n, F.lit("")).cast("long")), F.lit(0)).alias("max_address"))


def address(n: Column) -> Column:
    return F.format_string("c-%06d", n)


def manifest_delta(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, hash) that are new or changed."""
    return files.join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def queue_state(events: DataFrame) -> DataFrame:
    """(kind, page, detail, added, done, done_date): the queue after events (seq, op, kind, page, detail, date).

    Adding an open item again renews its detail and keeps its date; done without a kind closes all of a page's items.
    """
    add = events.where("op = 'add'").select("kind", "page", "seq", "detail", "date", F.lit(None).cast(events.schema["seq"].dataType).alias("end_seq"))
    done = events.where("op = 'done'").select("page", "kind", F.col("seq").alias("end_seq"), "date")
    kinds = add.select("page", F.col("kind").alias("_kind")).distinct()
    every = done.where("kind is null").join(kinds, "page").select(F.col("_kind").alias("kind"), "page", "end_seq", "date")
    done = done.where("kind is not null").select("kind", "page", "end_seq", "date").unionByName(every)
    x = add.unionByName(done.select("kind", "page", F.col("end_seq").alias("seq"), F.lit(None).cast("string").alias("detail"), "date", "end_seq"))
    # the next done event of the kind and page, read from the last event back
    after = W.partitionBy("kind", "page").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    end = F.when(F.col("end_seq").isNotNull(), F.struct("end_seq", F.col("date").alias("_date")))
    x = x.withColumn("end", F.last(end, ignorenulls=True).over(after)).where("end_seq is null").withColumn("end_seq", F.col("end.end_seq"))
    # adds that end with the same event, or never, are one item
    return x.groupBy("kind", "page", "end_seq").agg(F.max_by("detail", "seq").alias("detail"), F.min_by("date", "seq").alias("added"), F.min("end._date").alias("done_date")).select(
        "kind", "page", "detail", "added", F.col("end_seq").isNotNull().alias("done"), "done_date")


def queue_listing(state: DataFrame) -> DataFrame:
    """(done, place, kind, page, detail, added, done_date): every open entry by added, kind, page, and every done one by (done_date, added), newest first.

    Places of both parts count from 1; equal dates of done entries go by kind, page, detail.
    """
    c, rest = F.col, (F.col("kind"), F.col("page"), F.col("detail"))
    is_open = numbered(state.where("not done"), c("added"), *rest, start=1, out="place")
    done = numbered(state.where("done"), F.coalesce("done_date", F.lit("")).desc(), c("added").desc(), *rest, start=1, out="place")
    return is_open.unionByName(done).select("done", "place", "kind", "page", "detail", "added", "done_date")


def queue_stats(state: DataFrame) -> DataFrame:
    """(kind, open, done) by kind, most open first."""
    return state.groupBy("kind").agg(F.count_if(~F.col("done")).alias("open"), F.count_if("done").alias("done")).orderBy(F.desc("open"), "kind")


def fold_batch(log: DataFrame, k: int) -> DataFrame:
    """One row: the fold of the newest 2^k entries of log (date, pos; pos 0 is newest); none if there are fewer."""
    n = 2**k
    x = log.orderBy("pos").limit(n).agg(F.count("*").alias("entries"), F.min("date").alias("first"), F.max("date").alias("last"))
    x = x.where(F.col("entries") == n)
    return x.select(F.format_string(f"fold-k{k}-from-%s-to-%s-n{n}", "first", "last").alias("fold_id"), "first", "last", "entries")


def research_caps(sources: DataFrame, per_round: int = 5, rounds: int = 3, pages: int = 15) -> DataFrame:
    """The best sources (round, url, score) within the limits of a round, of rounds and of pages."""
    x = sources.where(F.col("round") <= rounds).withColumn("_r", F.row_number().over(W.partitionBy("round").orderBy(F.desc("score"), "url"))).where(F.col("_r") <= per_round)
    return x.orderBy("round", "_r").limit(pages).drop("_r")


def lock_state(age: Column, stale: int = 60, reap: int = 3600) -> Column:
    """What a lock of this age in seconds is: held, stale or reapable."""
    return F.when(age >= reap, "reapable").when(age >= stale, "stale").otherwise("held")


def stale_index(files: DataFrame, built_at: Column) -> DataFrame:
    """One row, stale: whether any file (modified) is newer than the index."""
    return files.agg(F.coalesce(F.max("modified") > built_at, F.lit(False)).alias("stale"))

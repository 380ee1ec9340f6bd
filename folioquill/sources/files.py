"""Sources: pages, chunks, transcripts, tables, mail, web pages; readers return DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from .office import docx_to_markdown, pptx_to_markdown

PAGE_BYTES, TILING_BYTES = 256 * 1024, 128 * 1024
CELLS = 2_000_000


def relative(path: Column, root: str) -> Column:
    """A file's path below the root."""
    return F.regexp_replace(path, rf"\A.*?\Q{root.rstrip('/')}\E/", "")


def read_pages(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(path, stem, folder, raw, address, title, type, status, created, updated, body, size, modified) of Markdown files.

    Paths with a part that starts with a dot are skipped, and files over ``limit`` bytes.
    """
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    x = x.select(relative(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("raw"))
    x = x.where(~F.col("path").rlike(r"(\A|/)\."))
    x = x.where(F.col("size") <= limit) if limit else x
    return page_fields(x)


def page_fields(x: DataFrame) -> DataFrame:
    """Adds the fields of a page to (path, raw, ...)."""
    block = T.frontmatter(F.col("raw"))
    known = {k: F.nullif(T.field(block, k), F.lit("")).alias(k) for k in ("address", "title", "type", "status", "created", "updated")}
    stem = T.strip_suffix(F.substring_index("path", "/", -1))
    folder = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)
    return x.select(*x.columns, stem.alias("stem"), folder.alias("folder"), *known.values(), F.regexp_replace("raw", T.FRONTMATTER, "").alias("body"))


def skip_reasons(pages: DataFrame, scoreable: Column, limit: int = TILING_BYTES) -> DataFrame:
    """(reason, n): why pages are not compared, and how many are."""
    reason = F.when(~scoreable, "excluded").when(F.col("size") > limit, "too large").when(T.strip(F.col("body")) == "", "empty").otherwise("kept")
    return pages.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def read_chunks(spark: SparkSession, root: str, exclude: DataFrame | None = None) -> DataFrame:
    """(chunk_id, page_address, chunk_index, page_path, text) of chunk files; unreadable ones and excluded ids are left out."""
    schema = "page_address string, chunk_index long, page_path string, raw_text string, contextualized_text string"
    x = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "chunk-*.json").json(root)
    x = x.where("page_address is not null and chunk_index is not null")
    x = x.select(F.concat_ws(":", "page_address", F.col("chunk_index").cast("string")).alias("chunk_id"), "page_address", "chunk_index", "page_path", F.coalesce(F.nullif("contextualized_text", F.lit("")), "raw_text", F.lit("")).alias("text"))
    return x if exclude is None else x.join(exclude.select("chunk_id"), "chunk_id", "left_anti")


def read_text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(file, raw): whole text files, for transcripts, queues and registers."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return x.select(relative(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), root).alias("file"), F.decode("content", "UTF-8").alias("raw"))


def parse_queue(files: DataFrame) -> DataFrame:
    """(kind, page, detail, added, done, done_date) of queue lines ``- [ ] kind :: page — detail (added D[, done D])``; others are ignored."""
    line = r"\A- \[( |x)\] (\S+) :: (.+?)(?: — (.*?))? \(added (\d{4}-\d{2}-\d{2})(?:, done (\d{4}-\d{2}-\d{2}))?\)\s*\z"
    x = files.select(F.explode(F.split("raw", r"\r\n|\n|\r")).alias("line")).where(F.col("line").rlike(line))
    part = lambda k: F.regexp_extract("line", line, k)
    return x.select(part(2).alias("kind"), part(3).alias("page"), part(4).alias("detail"), part(5).alias("added"), (part(1) == "x").alias("done"), F.nullif(part(6), F.lit("")).alias("done_date"))


def parse_benchmark(files: DataFrame) -> DataFrame:
    """(query_id, query, correct, relevant, category, rationale) of ``### D1`` blocks."""
    x = files.select(F.explode(F.slice(F.split("raw", r"\n### "), 2, 1 << 20)).alias("b"))
    x = x.select(T.strip(F.substring_index("b", "\n", 1)).alias("query_id"), F.get(F.split(F.regexp_replace("b", r"\A[^\n]*\n", ""), r"\n## ", 2), F.lit(0)).alias("b")).where(F.col("query_id").rlike(r"\A[DH]\d+\z"))
    get = lambda f: T.strip(F.regexp_extract("b", rf"(?m)^- {f}:\s*(.+)$", 1))
    many = lambda f: F.when(get(f).isin("", "null"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(get(f), ","), T.strip), lambda s: s != ""))
    return x.select("query_id", get("query").alias("query"), many("correct").alias("correct"), many("relevant").alias("relevant"), get("category").alias("category"), get("rationale").alias("rationale"))


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that are none are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, sheet, row, cells) of untyped delimited files. A file is read whole, since quoted cells may hold line ends."""
    x = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        import csv
        import io

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""), delimiter=separator))
                yield pa.RecordBatch.from_pydict({"file": pa.array([path] * len(rows), pa.string()), "sheet": pa.array([""] * len(rows), pa.string()), "row": pa.array(range(len(rows)), pa.int64()), "cells": pa.array(rows, pa.list_(pa.string()))})

    return x.mapInArrow(parse, "file string, sheet string, row long, cells array<string>")


def workbook_rows(content: bytes, cells: int = CELLS) -> dict[str, list[list[str]]]:
    """Rows of every sheet of an xlsx file as text: shared and inline strings, sparse cells padded.

    A sheet ends with the row in which it passes ``cells`` cells; a sheet whose part is missing is left out.
    """
    import io
    import re
    import zipfile
    from xml.etree import ElementTree as E

    local = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [text(si) for si in E.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in E.fromstring(z.read("xl/workbook.xml")).iter():
            if local(s) != "sheet":
                continue
            target = targets.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), None), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in names:
                continue
            rows, seen = [], 0
            for row in E.fromstring(z.read(part)).iter():
                if local(row) != "row":
                    continue
                found = []
                for c in row:
                    letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    found += [""] * max(0, at - 1 - len(found))
                    kind, value = c.get("t"), next((v.text or "" for v in c if local(v) == "v"), "")
                    found.append(shared[int(value)] if kind == "s" and value else text(c) if kind == "inlineStr" else value)
                    seen += 1
                rows.append(found)
                if seen > cells:
                    break
            out[s.get("name")] = rows
    return out


def read_workbooks(spark: SparkSession, path: str, cells: int = CELLS) -> DataFrame:
    """(file, sheet, row, cells, error) of xlsx files; a file that cannot be read gives one row with its error."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", True).load(path).select("path", "content")

    def parse(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = [(path, s, i, r, None) for s, rs in workbook_rows(content, cells).items() for i, r in enumerate(rs)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch
                    rows = [(path, None, None, None, str(e)[:200])]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "sheet", "row", "cells", "error"])

    return x.mapInArrow(parse, "file string, sheet string, row long, cells array<string>, error string")


def html_to_markdown(html: str) -> str:
    """Faithful Markdown of an HTML page: headings, paragraphs, lists, links, emphasis, code, tables; scripts and styles go."""
    from html.parser import HTMLParser

    class Writer(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden, self.links, self.lists, self.cells = [], 0, [], [], None

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag in ("script", "style", "head", "template"):
                self.hidden += 1
            elif tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in ("p", "div", "section", "article", "table", "blockquote", "pre"):
                self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))
            elif tag == "br":
                self.out.append("\n")
            elif tag in ("ul", "ol"):
                self.lists.append([tag, 0])
                self.out.append("\n")
            elif tag == "li":
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
            elif tag == "a":
                self.links.append(a.get("href"))
                self.out.append("[")
            elif tag == "img":
                self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")
            elif tag == "tr":
                self.out.append("\n|")
            elif tag in ("td", "th"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "head", "template"):
                self.hidden = max(0, self.hidden - 1)
            elif tag == "a" and self.links:
                self.out.append(f"]({self.links.pop() or ''})")
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.out.append("\n")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")
            elif tag in ("td", "th"):
                self.out.append(" |")
            elif tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                import re

                self.out.append(re.sub(r"\s+", " ", data))

    import re

    w = Writer()
    w.feed(html)
    w.close()
    text = "\n".join(line.strip() if not line.startswith("  ") else line.rstrip() for line in "".join(w.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n" if text.strip() else ""


def mail_to_markdown(content: bytes) -> tuple[str, list[dict]]:
    """Markdown of a mail and its flags: headers as frontmatter, plain text before HTML, attachments listed."""
    from email import message_from_bytes, policy

    m = message_from_bytes(content, policy=policy.default)
    body = m.get_body(("plain", "html"))
    text = ""
    if body is not None:
        try:
            text = body.get_content()
        except (LookupError, UnicodeDecodeError):
            text = body.get_payload(decode=True).decode("latin-1")
        if body.get_content_type() == "text/html":
            text = html_to_markdown(text)
    names = [p.get_filename() or "unnamed" for p in m.iter_attachments()]
    head = "".join(f"{k.lower()}: {str(m[k])!r}\n" for k in ("From", "To", "Cc", "Date", "Subject") if m[k])
    out = f"---\n{head}---\n\n{text.strip()}\n" + ("\n## Attachments\n\n" + "".join(f"- {n}\n" for n in names) if names else "")
    return out, [{"type": "attachments", "detail": f"{len(names)} not converted"}] if names else []


#: Converters by suffix: bytes -> (markdown, flags). Formats that need an outside engine (pdf, msg, old binary formats) are registered by the user.
HANDLERS: dict[str, Callable[[bytes], tuple[str, list[dict]]]] = {
    ".html": lambda b: (html_to_markdown(b.decode("utf-8", "replace")), []),
    ".htm": lambda b: (html_to_markdown(b.decode("utf-8", "replace")), []),
    ".eml": mail_to_markdown,
    ".docx": docx_to_markdown,
    ".pptx": pptx_to_markdown,
}


def convert_files(spark: SparkSession, root: str, done: DataFrame | None = None, handlers: dict | None = None) -> DataFrame:
    """(path, route, text, flags, error) of every file below the root that is not done (path) yet."""
    from ..operators.planning import convert_route, suffix

    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    x = x.select(relative(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), root).alias("path"), "content")
    x = x if done is None else x.join(done.select("path"), "path", "left_anti")
    x = x.select("path", convert_route(F.col("path")).alias("route"), suffix(F.col("path")).alias("suffix"), "content")
    table = HANDLERS | (handlers or {})

    def run(batches):
        for b in batches:
            out = []
            for path, route, ext, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    if route == "passthrough":
                        out.append((path, route, content.decode("utf-8", "replace"), [], None))
                    elif route == "convert" and ext in table:
                        out.append((path, route, *table[ext](content), None))
                    else:
                        out.append((path, "no-handler" if route == "convert" else route, None, [], None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch
                    out.append((path, "error", None, [], str(e)[:200]))
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("type", pa.string()), ("detail", pa.string())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["path", "route", "text", "flags", "error"])

    return x.mapInArrow(run, "path string, route string, text string, flags array<struct<type:string,detail:string>>, error string")


def html_column(df: DataFrame, column: str, out: str = "markdown") -> DataFrame:
    """Adds the Markdown of an HTML column; null stays null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` string"

    def run(batches):
        for b in batches:
            done = [None if h is None else html_to_markdown(h) for h in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def without_boilerplate(html: Column) -> Column:
    """Visible text of an article page: no navigation, headers, footers, asides, forms, scripts or tags."""
    s = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|form|noscript|iframe)\b.*?</\1\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<(br|/p|/div|/li|/h[1-6])\b[^>]*>", "\n"), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return T.strip(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\s*\n\s*", "\n"))

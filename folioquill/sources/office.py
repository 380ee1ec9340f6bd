"""Word documents and slide decks as Markdown, from their zip parts with the standard library alone."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

#: A slide face with fewer visible characters is flagged; a chart shows so many rows.
LOW_SLIDE, CHART_ROWS = 200, 60


def name(element) -> str:
    """A tag without its namespace."""
    return element.tag.rpartition("}")[2]


def attribute(element, key: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == key), None)


def below(element, *tags: str):
    return (e for e in element.iter() if name(e) in tags)


def first(element, *path: str):
    """The first descendant by a chain of tags; None where the chain breaks."""
    for tag in path:
        element = next(below(element, tag), None) if element is not None else None
    return element


class Package:
    """The parts of a file, by path, with the targets of their relations."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, part: str):
        return ElementTree.fromstring(self.zip.read(part))

    def targets(self, part: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (last word of its type, path or address)."""
        folder, file = posixpath.split(part)
        rels = f"{folder}/_rels/{file}.rels"
        if rels not in self.names:
            return {}
        out = {}
        for r in self.xml(rels):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], target)
        return out


def table(rows: list[list[str]]) -> str:
    """A Markdown table; short rows are filled up."""
    width = max(map(len, rows), default=0)
    cell = lambda c: re.sub(r"\s*\n\s*", " ", c.strip()).replace("|", "\\|")
    lines = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) if width else ""


def docx_to_markdown(content: bytes) -> tuple[str, list[dict]]:
    """Headings by style, list items, tables, links, line breaks and pictures in reading order; deleted text goes, notes and headers are not read."""
    package = Package(content)
    links, styles = package.targets("word/document.xml"), {}
    if "word/styles.xml" in package.names:
        for s in below(package.xml("word/styles.xml"), "style"):
            called = first(s, "name")
            styles[attribute(s, "styleId")] = (attribute(called, "val") if called is not None else "").lower()
    counts = {"image": 0}

    def run(e) -> str:
        kind = name(e)
        if kind == "t":
            return e.text or ""
        if kind in ("tab", "br", "cr"):
            return "\t" if kind == "tab" else "\n"
        if kind in ("pPr", "rPr", "del", "delText", "instrText", "Fallback", "txbxContent"):
            return ""
        if kind in ("drawing", "pict"):
            counts["image"] += 1
            return "<!-- image -->"
        inner = "".join(map(run, e))
        if kind == "hyperlink" and inner.strip() and (target := links.get(attribute(e, "id"), ("", ""))[1]):
            return f"[{inner}]({target})"
        return inner

    def paragraph(p) -> str:
        text = "".join(map(run, p)).strip()
        properties = next((e for e in p if name(e) == "pPr"), None)
        style = first(properties, "pStyle") if properties is not None else None
        called = styles.get(attribute(style, "val"), (attribute(style, "val") or "").lower()) if style is not None else ""
        level = re.fullmatch(r"heading ?([1-9])", called)
        if text and (level or called == "title"):
            return "#" * min(6, int(level[1]) if level else 1) + " " + text.replace("\n", " ")
        listed = first(properties, "numPr") if properties is not None else None
        if text and (listed is not None or called.startswith("list")):
            depth = first(listed, "ilvl") if listed is not None else None
            return "  " * int(attribute(depth, "val") or 0 if depth is not None else 0) + "- " + text.replace("\n", " ")
        return text

    def blocks(parent):
        for e in parent:
            if name(e) == "p":
                yield paragraph(e)
            elif name(e) == "tbl":
                yield table([["\n".join(filter(None, blocks(c))) for c in r if name(c) == "tc"] for r in e if name(r) == "tr"])
            elif name(e) in ("sdt", "sdtContent", "ins", "smartTag", "customXml"):
                yield from blocks(e)

    found = [b for b in blocks(first(package.xml("word/document.xml"), "body")) if b]
    out = "".join(b + ("\n" if b.lstrip().startswith("- ") and nxt.lstrip().startswith("- ") else "\n\n") for b, nxt in zip(found, [*found[1:], ""]))
    flags = [{"type": "images", "detail": f"{counts['image']} not described"}] if counts["image"] else []
    return (out.strip() + "\n" if out.strip() else ""), flags


def said(shape) -> str:
    """The text of a shape, a line for each paragraph."""
    body = first(shape, "txBody")
    if body is None:
        return ""
    return "\n".join("".join("\n" if name(r) == "br" else r.text or "" for r in below(p, "t", "br")) for p in body if name(p) == "p").strip()


def chart_table(chart) -> str:
    """A chart's own numbers as a table under its title."""
    points = lambda e: {int(p.get("idx", 0)): (first(p, "v").text or "") for p in below(e, "pt") if first(p, "v") is not None}
    number = lambda v: v[:-2] if re.fullmatch(r"-?\d+\.0", v) else v
    series, categories = [], {}
    for s in below(chart, "ser"):
        called, values, cats = first(s, "tx"), first(s, "val"), first(s, "cat")
        names = points(called) if called is not None else {}
        series.append((names.get(0, "Series"), points(values) if values is not None else {}))
        categories = categories or (points(cats) if cats is not None else {})
    title = first(chart, "title")
    head = "".join(t.text or "" for t in below(title, "t")).strip() if title is not None else ""
    head = f"**Chart: {head}**" if head else "**Chart**"
    if not series:
        return f"{head}\n\n<!-- chart -->"
    n = 1 + max([*categories, *(k for _, v in series for k in v)], default=-1)
    rows = [["Category", *(s for s, _ in series)]]
    rows += [[categories.get(i, "" if categories else str(i + 1)), *(number(v.get(i, "")) for _, v in series)] for i in range(min(n, CHART_ROWS))]
    rows += [["…"] * (1 + len(series))] if n > CHART_ROWS else []
    return f"{head}\n\n{table(rows)}"


def slide_blocks(package: Package, tree, targets):
    """(is title, Markdown) of a slide's shapes in order, groups opened."""
    for shape in tree:
        kind = name(shape)
        if kind == "grpSp":
            yield from slide_blocks(package, shape, targets)
        elif kind == "pic":
            yield False, "<!-- image -->"
        elif kind == "graphicFrame":
            grid, chart = first(shape, "tbl"), first(shape, "chart")
            if grid is not None:
                yield False, table([["\n".join("".join(t.text or "" for t in below(p, "t")) for p in below(c, "p")) for c in r if name(c) == "tc"] for r in below(grid, "tr")])
            elif chart is not None:
                part = targets.get(attribute(chart, "id"), ("", ""))[1]
                yield False, chart_table(package.xml(part)) if part in package.names else "**Chart**\n\n<!-- chart -->"
        elif kind == "sp" and (text := said(shape)):
            place = first(shape, "ph")
            yield place is not None and place.get("type") in ("title", "ctrTitle"), text


def pptx_to_markdown(content: bytes) -> tuple[str, list[dict]]:
    """A section for each slide with its title, texts, tables, charts and speaker notes; slides that show little text are flagged."""
    package = Package(content)
    order = package.targets("ppt/presentation.xml")
    slides = [order[attribute(s, "id")][1] for s in below(package.xml("ppt/presentation.xml"), "sldId") if attribute(s, "id") in order]
    out, low = [], []
    for i, part in enumerate(slides, 1):
        targets = package.targets(part)
        found = list(slide_blocks(package, first(package.xml(part), "spTree"), targets))
        title = next((text for is_title, text in found if is_title), "")
        rest = [text for is_title, text in found if not (is_title and text == title)]
        out.append(f"## Slide {i}" + (" — " + title.replace("\n", " ") if title else ""))
        out += rest
        shown = title + "".join(line for text in rest for line in text.split("\n") if not line.startswith("<!--"))
        if len(re.sub(r"\s", "", shown)) < LOW_SLIDE:
            low.append(i)
        for kind, notes in targets.values():
            if kind == "notesSlide" and notes in package.names:
                bodies = [s for s in below(package.xml(notes), "sp") if first(s, "ph") is not None and first(s, "ph").get("type") == "body"]
                if note := "\n".join(filter(None, map(said, bodies))):
                    out += ["**Speaker notes:**", "> " + note.replace("\n", "\n> ")]
    flags = [{"type": "pptx-low-text-slides", "detail": f"{len(low)}/{len(slides)} slides under {LOW_SLIDE} chars: {low}"}] if low else []
    return ("\n\n".join(out) + "\n" if out else ""), flags

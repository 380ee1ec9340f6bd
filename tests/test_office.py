"""Word and slide files, workbooks, stored indexes and settings, from files made here."""

import io
import zipfile

from pyspark.sql import functions as F

from folioquill.operators import planning
from folioquill.plans import search
from folioquill.sources import files, office, sinks

W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:p="p" xmlns:c="c"'
RELS = '<Relationships xmlns="x">{}</Relationships>'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rel(i, kind, target, mode=""):
    return f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{target}"{mode}/>'


def word_file():
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = lambda text, level: p(text, f'<w:numPr><w:ilvl w:val="{level}"/></w:numPr>')
    cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
    body = (
        p("Top", '<w:pStyle w:val="H1"/>') + p("plain") + item("one", 0) + item("two", 1) + p("")
        + '<w:p><w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t> end</w:t><w:drawing/></w:r></w:p>'
        + f"<w:tbl><w:tr>{cell('a|b')}{cell('c')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl>" + f"<w:sdt><w:sdtContent>{p('held')}</w:sdtContent></w:sdt>"
    )
    return packed({
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": RELS.format(rel("r1", "hyperlink", "http://e.org", ' TargetMode="External"')),
    })


def test_word_files():
    text, flags = office.docx_to_markdown(word_file())
    assert text == "# Top\n\nplain\n\n- one\n  - two\n\n[site](http://e.org) end<!-- image -->\n\n| a\\|b | c |\n|---|---|\n| 1 |  |\n\nheld\n"
    assert flags == [{"type": "images", "detail": "1 not described"}]


def deck():
    shape = lambda text, kind=None: f'<p:sp>{f"""<p:nvPr><p:ph type="{kind}"/></p:nvPr>""" if kind else ""}<p:txBody>' + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in text.split("\n")) + "</p:txBody></p:sp>"
    tree = lambda inner: f"<p:sld {W}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    point = lambda i, v: f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>'
    chart = f"<c:chartSpace {W}><c:title><a:t>Sales</a:t></c:title><c:ser><c:tx>{point(0, 'S')}</c:tx><c:cat>{point(0, 'x')}{point(1, 'y')}</c:cat><c:val>{point(0, '2.0')}{point(1, '2.5')}</c:val></c:ser></c:chartSpace>"
    grid = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    return packed({
        "ppt/presentation.xml": f'<p:presentation {W}><p:sldIdLst><p:sldId id="1" r:id="b"/><p:sldId id="2" r:id="a"/></p:sldIdLst></p:presentation>'.replace('id="1" ', "").replace('id="2" ', ""),
        "ppt/_rels/presentation.xml.rels": RELS.format(rel("a", "slide", "slides/slide1.xml") + rel("b", "slide", "/ppt/slides/slide2.xml")),
        "ppt/slides/slide1.xml": tree(shape("word " * 60) + "<p:grpSp>" + shape("in a group") + "<p:pic/></p:grpSp>" + '<p:graphicFrame><c:chart r:id="c1"/></p:graphicFrame>'),
        "ppt/slides/slide2.xml": tree(shape("Start", "title") + shape("a\nb") + grid),
        "ppt/slides/_rels/slide1.xml.rels": RELS.format(rel("c1", "chart", "../charts/chart1.xml")),
        "ppt/slides/_rels/slide2.xml.rels": RELS.format(rel("n", "notesSlide", "../notesSlides/n1.xml")),
        "ppt/charts/chart1.xml": chart,
        "ppt/notesSlides/n1.xml": tree(shape("say\nthis", "body") + shape("7", "sldNum")),
    })


def test_decks():
    text, flags = office.pptx_to_markdown(deck())
    first, second = text.split("\n\n## Slide 2\n\n")
    assert first == "## Slide 1 — Start\n\na\nb\n\n| h |\n|---|\n| v |\n\n**Speaker notes:**\n\n> say\n> this"
    assert second.endswith("in a group\n\n<!-- image -->\n\n**Chart: Sales**\n\n| Category | S |\n|---|---|\n| x | 2 |\n| y | 2.5 |\n")
    assert flags == [{"type": "pptx-low-text-slides", "detail": "1/2 slides under 200 chars: [1]"}]


def test_conversion_of_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file())
    (tmp_path / "b.pptx").write_bytes(deck())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    done = spark.createDataFrame([("b.pptx",)], "path string")
    got = {r["path"]: r for r in files.convert_files(spark, str(tmp_path), done).collect()}
    assert set(got) == {"a.docx", "bad.docx"} and got["a.docx"]["text"].startswith("# Top") and got["bad.docx"]["route"] == "error"


def test_mirrored_tree(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    (src / "a b" / "c").mkdir(parents=True)
    (src / "a b" / "c" / "w.docx").write_bytes(word_file())
    (src / "n.md").write_text("né")
    (src / "t.csv").write_text("a,b")
    (src / "bad.pptx").write_bytes(b"no zip")
    done = sinks.write_conversion(files.convert_files(spark, str(src)), out)
    assert {(r["path"], r["target"], r["bytes"]) for r in done.where("path = 'n.md'").collect()} == {("n.md", "n.md", 3)}
    assert (tmp_path / "out" / "a b" / "c" / "w.docx.md").read_text().startswith("# Top") and (tmp_path / "out" / "n.md").read_text() == "né"
    read = lambda name: {r["path"] for r in spark.read.json(f"{out}/{name}").collect()}
    assert (read("_done"), read("_flags"), read("_errors"), read("_skipped")) == ({"a b/c/w.docx", "n.md"}, {"a b/c/w.docx"}, {"bad.pptx"}, {"t.csv"})
    assert files.convert_files(spark, str(src), spark.read.json(f"{out}/_done")).count() == 2


def test_workbooks_are_cut_and_missing_sheets_skipped():
    row = lambda n: "<row>" + "".join(f'<c r="{chr(65 + k)}{n}"><v>{n}{k}</v></c>' for k in range(3)) + "</row>"
    book = packed({
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="S" r:id="a"/><sheet name="T" r:id="b"/></sheets></workbook>'.replace("r:id", "q:id").replace('xmlns:r="r"', 'xmlns:q="q"'),
        "xl/_rels/workbook.xml.rels": RELS.format(rel("a", "sheet", "worksheets/s.xml") + rel("b", "sheet", "worksheets/none.xml")),
        "xl/worksheets/s.xml": "<worksheet>" + "".join(map(row, range(1, 9))) + "</worksheet>",
    })
    assert {k: len(v) for k, v in files.workbook_rows(book).items()} == {"S": 8}
    assert files.workbook_rows(book, 4) == {"S": [["10", "11", "12"], ["20", "21", "22"]]}


def test_stored_index_heals(spark, tmp_path):
    import time

    chunks = spark.createDataFrame([("c1", "p1", "apple pear"), ("c2", "p2", "apple plum")], "chunk_id string, page string, text string")
    queries = spark.createDataFrame([(1, "pear")], "query_id long, text string")
    path = f"file://{tmp_path}/index"
    assert sinks.ensure_index(spark, path, None, 0) == ("unavailable", None)
    status, index = sinks.ensure_index(spark, path, chunks, 0)
    assert status == "rebuilt+ok" and sinks.ensure_index(spark, path, chunks, 0)[0] == "ok"
    told, found = search.search_both(spark, queries, (status, index), ("unavailable", None))
    assert told == {"wiki": "rebuilt+ok", "corpus": "unavailable"} and [r["chunk_id"] for r in found.collect()] == ["c1"]
    more = chunks.unionByName(spark.createDataFrame([("c3", "p3", "pear pear")], chunks.schema))
    status, index = sinks.ensure_index(spark, path, more, time.time() + 1)
    assert status == "rebuilt+ok" and index.chunks.count() == 3
    assert search.search_both(spark, queries, ("unavailable", None), ("unavailable", None))[1] is None


def test_mode_config(spark):
    rows = [(0, None), (1, "{bad"), (2, '{"mode": "para", "configured_at": "d", "config": {"para": {"areas_folder": "x/", "new": "y"}, "other": {"a": "b"}}}')]
    got = {r["k"]: r["c"] for r in spark.createDataFrame(rows, "k int, t string").select("k", planning.mode_config(F.col("t")).alias("c")).collect()}
    assert got[0]["mode"] == got[1]["mode"] == "generic" and got[0]["config"] == planning.MODE_DEFAULTS == got[1]["config"]
    assert (got[2]["mode"], got[2]["configured_at"]) == ("para", "d") and "other" not in got[2]["config"]
    assert got[2]["config"]["para"] == planning.MODE_DEFAULTS["para"] | {"areas_folder": "x/", "new": "y"}


def test_service_loop(spark):
    import json

    from folioquill.plans.search import corpus_index
    from folioquill.sources.service import Service

    docs = spark.createDataFrame([("tier 1/a.md", "a", "tier 1", "Apples are red. " * 30), ("b.md", "b", "", "Pears are green.")], "path string, title string, folder string, body string")
    service = Service(spark, *corpus_index(docs), docs)
    asked = [
        {"id": 1, "method": "initialize", "params": {"protocolVersion": "x"}}, {"method": "notifications/initialized"}, {"id": 2, "method": "ping"}, {"id": 3, "method": "tools/list"},
        {"id": 4, "method": "tools/call", "params": {"name": "search_corpus", "arguments": {"query": "pears", "top_k": 99}}},
        {"id": 5, "method": "tools/call", "params": {"name": "read_document", "arguments": {"path": "tier 1/a.md", "offset": 7, "length": 3}}},
        {"id": 6, "method": "tools/call", "params": {"name": "read_document", "arguments": {"path": "../b.md"}}},
        {"id": 7, "method": "tools/call", "params": {"name": "search_corpus", "arguments": {"query": "x", "top_k": "many"}}},
        {"id": 8, "method": "tools/call", "params": {"name": "other"}}, {"id": 9, "method": "none"}, {"method": "none"},
    ]
    out = []
    service.serve(["", "no json", "[1]", *map(json.dumps, asked)], out.append)
    got = {r["id"]: r for r in map(json.loads, out)}
    assert list(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9] and all(r["jsonrpc"] == "2.0" for r in got.values())
    text = lambda i: got[i]["result"]["content"][0]["text"]
    assert got[1]["result"]["protocolVersion"] == "x" and len(got[3]["result"]["tools"]) == 2
    assert text(4).startswith("- b.md\n") and "a.md" not in text(4)
    assert text(5) == "tier 1/a.md — chars 7..10 of 480 (more follows from offset=10)\n\nare"
    assert "outside" in text(6) and got[7]["result"]["isError"]
    assert got[8]["error"]["code"] == got[9]["error"]["code"] == -32601


def test_article_text_and_html_golden():
    html = "<html><head><title>t</title></head><body><nav>menu</nav><h2>Head</h2><ul><li>a<li>b</ul><ol><li>x</li></ol><blockquote>q</blockquote><p>1 <em>i</em> <code>c</code><br>n</p><table><tr><th>h</th><td>v</td></tr></table><script>s()</script><img src='i.png' alt='I'></body></html>"
    assert files.html_to_markdown(html) == "menu\n\n## Head\n\n- a\n- b\n\n1. x\n\n> q\n\n1 *i* `c`\nn\n\n| h | v |![I](i.png)\n"


def test_defuddle_golden(spark):
    html = "<header>top</header><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two</p><aside>ad</aside><p>&lt;three&gt;</p></article><!-- c --><footer>end</footer>"
    got = spark.createDataFrame([(html,)], "h string").select(files.without_boilerplate(F.col("h")).alias("t")).collect()[0]["t"]
    assert got == "A & B\none\ntwo\n<three>"

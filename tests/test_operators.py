"""Small literal cases of the operators, and folds against plain Python models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioquill.functions import text as T
from folioquill.operators import canvas, chunking, dedup, fidelity, graph, planning, register, retrieval, tables, transcript, views
from folioquill.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("Hello, World!", ["hello", "world"]), ("The quick brown fox is at the door", ["quick", "brown", "fox", "door"]), ("a b cc dddd", ["cc", "dddd"]),
    ("Привет мир, 你好 world", ["привет", "мир", "你好", "world"]), ("🎉🎉", []), ("user's well-formed", ["user's", "well-formed"]), (None, []), ("", []),
])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


def chunk_model(body, target, overlap):
    parts = [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]
    out, cur, size = [], [], 0
    for p in parts:
        cur.append(p)
        size += len(p) + 2
        if size >= target:
            out.append("\n\n".join(cur))
            cur = [out[-1][-overlap:]]
            size = len(cur[0])
    return out + (["\n\n".join(cur)] if cur and "".join(cur).strip() else [])


def split_model(chunk, limit):
    if len(chunk) <= limit:
        return [chunk]
    out, buf = [], ""
    for s in (s for s in re.split(r"(?<=[.!?])\s+", chunk) if s.strip()):
        if len(s) > limit:
            out += ([buf] if buf else []) + [s[i : i + limit] for i in range(0, len(s), limit)]
            buf = ""
        elif not buf or len(buf) + 1 + len(s) <= limit:
            buf = f"{buf} {s}" if buf else s
        else:
            out.append(buf)
            buf = s
    return out + ([buf] if buf else [])


def test_chunking_matches_a_plain_model(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde.") for _ in range(rng.randint(1, 8)))
    bodies = ["", "   ", "x"] + ["\n\n".join(" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    chunks = chunking.chunk_body(F.col("b"), 120, 20)
    got = {r["i"]: (r["c"], r["s"]) for r in df.select("i", chunks.alias("c"), chunking.split_oversized(chunks, 50).alias("s")).collect()}
    for i, b in enumerate(bodies):
        want = chunk_model(b, 120, 20)
        assert got[i] == (want, [p for c in want for p in split_model(c, 50)])


def test_tier_labels(spark):
    for path, want in [("Tier 1/a.md", "1"), ("Tier 3\\b.md", "3"), ("Who I AM (Tier 0)/x.md", "0"), ("My Tier 2 Docs/deep/c.md", "2"), ("Meeting Transcripts/d.md", "meeting-transcripts"), ("Reference  Material!/e.md", "reference-material"), ("root.md", "")]:
        assert one(spark, chunking.tier(F.col("p")), p=path) == want
    assert one(spark, chunking.tier(F.col("p"), {"tier 1": "9"}), p="Tier 1/a.md") == "9"


def test_bm25_small_index(spark):
    docs = spark.createDataFrame([("1", "p", "DragonScale memory mechanism for log folding"), ("2", "q", "transport detection with the obsidian cli binary"), ("3", "p", "memory layer architecture and the wiki vault")], "chunk_id string, page string, text string")
    index = retrieval.build_index(docs)
    assert index.stats.first()["n"] == 3
    assert {r["term"]: r["df"] for r in index.terms.collect()}["memory"] == 2
    ask = lambda q: [r["chunk_id"] for r in retrieval.bm25_top_k(index, retrieval.query_terms(spark.createDataFrame([(1, q)], "query_id int, text string"))).orderBy("rank").collect()]
    assert sorted(ask("memory")) == ["1", "3"]
    assert ask("transport") == ["2"]
    assert ask("the and of") == []


def test_diversify(spark):
    def run(pages, k):
        df = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(pages)], "query_id int, rank int, page string")
        return sorted(r["page"] for r in retrieval.diversify(df, k).collect())

    assert run("AAAAABCD", 5) == list("AABCD")
    assert run("AAAAABC", 5) == list("AAABC")
    assert run("XXXXXX", 4) == list("XXXX")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([0.0], [1.0], 0.0), ([1.0, 2.0], [1.0], 0.0)], "a array<double>, b array<double>, want double")
    for r in df.select(T.cosine(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert r["got"] == pytest.approx(r["want"])


def test_similar_pairs_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame([(i, [float(x) for x in random.Random(i // 3).sample(range(20), 5)]) for i in range(60)] + [(99, None), (98, [0.0] * 5)], "key int, vector array<double>")
    got = [sorted(map(tuple, dedup.similar_pairs(df, block=b).collect())) for b in (7, 1000)]
    assert got[0] == got[1]
    assert len(got[0]) >= 60


def test_links_and_fences(spark):
    assert one(spark, graph.wikilinks(F.col("b")), b="[[Foo]] [[Bar|alias]] [[Baz#Heading]] [[Foo]] [[a/Deep]]") == ["Foo", "Bar", "Baz", "Deep"]
    assert one(spark, graph.wikilinks(F.col("b")), b="```\n[[No]]\n```\n[[Yes]]\n~~~~\n[[No]]\n~~~\n[[No]]\n~~~~\n    [[Indented]]") == ["Yes", "Indented"]


def test_lineage(spark):
    pages = spark.createDataFrame([(p,) for p in ("r2", "r1", "r0", "x", "y", "fa", "fb", "c", "alone")], "page string")
    sup = spark.createDataFrame([("r2", "r1"), ("r1", "r0"), ("x", "y"), ("y", "x"), ("fa", "c"), ("fb", "c"), ("r2", "gone")], "page string, target string")
    by = spark.createDataFrame([("r1", "r2"), ("r0", "r1"), ("y", "x"), ("x", "y"), ("c", "fa")], "page string, target string")
    assert [tuple(r) for r in graph.dangling(pages, sup, by).collect()] == [("r2", "supersedes", "gone")]
    assert [tuple(r) for r in graph.asymmetric(pages, sup, by).collect()] == [("fb", "supersedes", "c")]
    assert [tuple(r) for r in graph.lineage_cycles(sup).collect()] == [(["x", "y"], 2)]
    got = {(r["head"], r["page"], r["depth"]) for r in graph.lineage_chains(sup, by).collect()}
    assert got == {("r2", "r2", 0), ("r2", "r1", 1), ("r2", "gone", 1), ("r2", "r0", 2), ("fa", "fa", 0), ("fa", "c", 1), ("fb", "fb", 0), ("fb", "c", 1)}
    assert {(r["page"], r["head"]) for r in graph.chain_head(by).collect()} == {("r1", "r2"), ("r0", "r2"), ("c", "fa")}


TALK = """# Weekly
- Recorded: 2024-03-05
- Room: A
---
free text
[00:00 - 00:10] Ann: hello there
and more
[00:12 - 00:20] Ann: again
[02:00 - 02:05] Ann: far away
[02:06 - 02:08] Please subscribe
[02:10 - 02:12] Bob: yes
[02:13 - 02:14] Bob: yes
[02:15 - 02:16] Bob: yes
[1:02:03 - 1:02:04] Bob:
"""


def test_transcript(spark):
    x = spark.createDataFrame([("t/weekly-2024-03-05_x.md", TALK)], "file string, raw string")
    seg = transcript.parse_segments(x)
    rows = seg.orderBy("pos").collect()
    assert [r["text"] for r in rows] == ["hello there and more", "again", "far away", "Please subscribe", "yes", "yes", "yes", ""]
    assert (rows[-1]["start"], rows[3]["speaker"], rows[-1]["speaker"]) == (3723, None, "Bob")
    flagged = transcript.flag(seg)
    assert [r["flags"] for r in flagged.orderBy("pos").collect()] == [[], [], [], ["phrase"], [], ["repeat"], ["repeat"], ["empty"]]
    merged = transcript.merge(flagged).orderBy("pos").collect()
    assert len(merged) == 7 and merged[0]["end"] == 20 and merged[0]["text"] == "hello there and more again"
    head = transcript.headers(x)
    assert tuple(head.select("title", F.col("metadata")["recorded"], "preamble").first()) == ("Weekly", "2024-03-05", ["free text"])
    assert transcript.date_audit(head).first()["match"]
    assert transcript.render(flagged, head).first()["text"].startswith("# Weekly\n- recorded: 2024-03-05\n- room: A\nfree text\n---\n[00:00 - 00:10] Ann: hello")


def test_numbering_and_recovery(spark):
    docs = spark.createDataFrame([("ok", "1. Intro\n1.1 a\n1.2 b\n2. Body\n2.1 c"), ("bad", "1. Intro\n3.1 a\n4.2 b\n1.1 c"), ("bullet", "1. Intro\n - 2.1 c")], "key string, text string")
    assert {r["key"]: (r["mismatches"], r["total"]) for r in fidelity.numbering_flags(docs).collect()} == {"ok": (0, 3), "bad": (2, 3), "bullet": (1, 1)}
    fixed = fidelity.fix_numbering(spark.createDataFrame([("k", "2. **Part**\n  - 1.2.1. item\n  - 2.3. same")], "key string, text string"), "section")
    assert [r["fixed"] for r in fixed.orderBy("pos").collect()] == ["2. **Part**", "  - 2.2.1. item", "  - 2.3. same"]
    words = " ".join("abcd" + c + d for c in "abcdefgh" for d in "abcdefgh")
    lost = "some block with many entirely missing words"
    pairs = spark.createDataFrame([("replaced", words, "nothing"), ("appended", words + "\n\n" + lost, words), ("same", words, words)], "key string, original string, converted string")
    got = {r["key"]: (r["mode"], lost in r["text"]) for r in fidelity.recover(pairs).collect()}
    assert got == {"replaced": ("replaced", False), "appended": ("appended", True), "same": (None, False)}


@pytest.mark.parametrize(("name", "size", "depth"), [
    ("desktop.ini", 1, "skip"), ("Thumbs.db", 1, "skip"), ("survey.xlsx", 1, "catalogue"), ("codes.csv", 10_000_000, "catalogue"), ("deck.pptx", 1, "summary"), ("handbook.pdf", 5_000_000, "summary"),
    ("memo.pdf", 100_000, "full"), ("notes.md", 1, "full"), ("big-notes.md", 3_000_000, "summary"), ("photo.png", 1, "full"), ("archive.zip", 1, "full"),
])
def test_depth(spark, name, size, depth):
    assert one(spark, planning.depth(F.col("p"), F.lit(size))["depth"], p=f"in/{name}") == depth


def test_queue(spark):
    rows = [(1, "add", "stale", "Policy", "a", "d1"), (2, "add", "stale", "Policy", "b", "d2"), (3, "add", "lineage", "Policy", "c", "d3"), (4, "add", "stale", "Other", "d", "d4"), (5, "done", "lineage", "Policy", None, "d5"), (6, "done", None, "Policy", None, "d6"), (7, "done", None, "Nobody", None, "d7")]
    state = planning.queue_state(spark.createDataFrame(rows, "seq int, op string, kind string, page string, detail string, date string"))
    assert {(r["kind"], r["page"], r["detail"], r["added"], r["done"]) for r in state.collect()} == {("stale", "Policy", "b", "d1", True), ("lineage", "Policy", "c", "d3", True), ("stale", "Other", "d", "d4", False)}


def test_names_and_routes(spark):
    assert one(spark, T.slugify(F.col("n")), n="v1.7 launch! prep?") == "v1-7-launch-prep"
    assert one(spark, T.slugify(F.col("n")), n="café résumé") == "café-résumé"
    assert one(spark, T.slugify(F.col("n")), n="") == "untitled"
    assert one(spark, T.safe_name(F.col("n")), n="../../../etc/passwd") == "etcpasswd"
    assert one(spark, planning.route(F.lit("generic"), F.lit("entity"), F.col("n")), n="Andrej Karpathy") == "wiki/entities/Andrej Karpathy.md"
    assert one(spark, T.safe_url(F.col("u")), u="http://10.0.0.1/x") is False
    assert one(spark, T.safe_url(F.col("u")), u="https://example.org/x") is True
    assert one(spark, T.safe_url(F.col("u")), u="javascript:alert(1)") is False


def test_register(spark):
    titles = spark.createDataFrame([("Alice Smith (CEO)",), ("Bob Jones",), ("Data Platform (DP)",), ("Data Platform Toolkit",)], "title string")
    aliases = register.alias_map(titles, spark.createDataFrame([("Bob", "Bob Jones")], "alias string, title string"))
    entries = spark.createDataFrame([("Alice Smith and Bob on the Data Platform Toolkit, `Bob`", "DP and Bob again", "Bob Jones")], "agenda string, notable string, self_title string")
    x = register.link_entries(entries, aliases)
    r = x.first()
    assert r["agenda"] == "[[Alice Smith (CEO)|Alice Smith]] and Bob on the [[Data Platform Toolkit]], `Bob`"
    assert r["notable"] == "[[Data Platform (DP)|DP]] and Bob again"
    assert register.link_entries(x.drop("links"), aliases).first()["agenda"] == r["agenda"]


def test_glossary_and_forms(spark):
    t = spark.createDataFrame([(1, "DTM", "a"), (2, "AAP", "b"), (3, "dtm", "c"), (4, "A/B:Test", "d"), (5, "NoDef", None), (6, " ", "x")], "row int, term string, definition string")
    assert {(r["term"], r["file_name"]) for r in tables.glossary(t).collect()} == {("DTM", "DTM"), ("AAP", "AAP"), ("A/B:Test", "A-B-Test"), ("NoDef", "NoDef")}
    survey = [["type", "label::English (en)", "label::French (fr)"]] + [[k, "q", "q"] for k in ("text", "integer", "select_one a", "date", "text", "note", "begin group", "text", "end group", "begin_repeat r", "end_repeat")]
    choices = [["list_name", "name"], ["a", "1"], ["a", "2"], ["a", "3"], ["b", "1"], ["b", "2"]]
    df = spark.createDataFrame([("f", s, i, r) for s, rows in (("survey", survey), ("choices", choices)) for i, r in enumerate(rows)], "file string, sheet string, row long, cells array<string>")
    r = tables.form_profile(df).first()
    assert (r["questions"], r["groups"], r["repeats"], r["choice_lists"], r["choice_options"]) == (6, 1, 1, 2, 5)
    assert tables.form_languages(df).first()["languages"] == ["English (en)", "French (fr)"]


def test_views_reject_bad_input(spark):
    pages = spark.createDataFrame([("a", 1, "2024-01-31", "w/x")], "name string, n int, due string, folder string")
    scope = views.Scope(pages.columns, as_of="2024-01-01")
    assert pages.select(views.compile_expression('if(due, (date(due) - today()).days, "")', scope)).first()[0] == 30
    assert pages.select(views.compile_expression('!(n > 1) && (n + 2 * 3 == 7 || false)', scope)).first()[0] is True
    with pytest.raises(ValueError):
        views.compile_expression("(date(due) - today()).round(0)", scope)
    with pytest.raises(ValueError):
        views.compile_expression("n >", scope)
    with pytest.raises(ValueError):
        views.compile_filter({"xor": []}, scope)


def test_canvas(spark):
    nodes = spark.createDataFrame([("c", "a", "text", 20, 20, 100, 60), ("c", "b", "text", 160, 30, 100, 60), ("c", "z", "group", 0, 0, 400, 300), ("c", "e", "group", 500, 0, 400, 300)], "canvas string, id string, type string, x int, y int, width int, height int")
    got = {r["zone"]: (r["x"], r["y"]) for r in canvas.next_position(nodes, nodes.where("type = 'group'"), 100).collect()}
    assert got == {"z": (300, 20), "e": (520, 20)}
    got = {r["zone"]: (r["x"], r["y"]) for r in canvas.next_position(nodes, nodes.where("type = 'group'"), 150).collect()}
    assert got["z"] == (20, 110)


def test_numbered_is_gapless(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = planning.numbered(df, F.col("k"), start=5).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(5, 1005))


def test_numbered_with_wide_rows_and_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(60_000).select("id", F.xxhash64("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
        got = planning.numbered(df, F.col("k").desc(), start=1).select("id", "k", "n").orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r["n"] for r in got] == list(range(1, 60_001))
    assert all(a["k"] > b["k"] for a, b in zip(got, got[1:]))
    assert planning.numbered(df.where("false"), F.col("k")).count() == 0


def test_passages_and_terms_by_brute_force(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    texts = [(i, rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(90, None), (91, "")]
    passages = [(100 + k, (t := rng.choice(texts[:60])[1])[(a := rng.randint(0, max(0, len(t) - 1))) : a + rng.randint(1, 40)]) for k in range(60)] + [(300, None), (301, ""), (302, "zz zz zz"), (303, "ab  cd")]
    got = {tuple(r) for r in retrieval.passages_in(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame(passages, "passage_key long, passage string")).collect()}
    assert got == {(i, k) for i, t in texts for k, p in passages if t and p and p in t}
    queries = [(k, " ".join(word() for _ in range(4)) + " a'b İx") for k in range(5)]
    pages = [(str(i), t) for i, t in texts] + [("tr", "İX a'b-c")]
    rows = retrieval.keyword_baseline(spark.createDataFrame(pages, "page string, body string"), spark.createDataFrame(queries, "query_id long, text string"), k=1000).collect()
    terms = {(r["query_id"], r["term"]) for r in retrieval.query_terms(spark.createDataFrame(queries, "query_id long, text string")).collect()}
    low = {r["page"]: r["low"] for r in spark.createDataFrame(pages, "page string, body string").select("page", F.lower("body").alias("low")).collect()}
    want = {}
    for q, term in terms:
        for page, body in low.items():
            if body and term in body:
                n, total = want.get((q, page), (0, 0))
                want[q, page] = (n + 1, total + body.count(term))
    assert {(r["query_id"], r["page"]): (r["distinct_terms"], r["total_occurrences"]) for r in rows} == want


def test_linking(spark):
    aliases = spark.createDataFrame([("Data Team", "Data Team"), ("DT", "Data Team"), ("Data", "Data"), ("(X)", "Ex"), ("R&D", "Research"), ("Åsa", "Åsa")], "alias string, title string")
    rows = [
        ("a", "Data Team and DT, Data. R&D (X) [[Data Team|x]] `Data`", "R&D Åsa Åsas"),
        ("b", "DataTeam Data_x [Data] xData ```Data\n``` Data", None),
        ("Data", "Data Team, Data", "DT"),
        ("c", None, "no alias here"),
    ]
    got = {r["self_title"]: r for r in register.link_entries(spark.createDataFrame(rows, "self_title string, agenda string, decisions string"), aliases).collect()}
    assert got["a"]["agenda"] == "[[Data]] Team and DT, Data. [[Research|R&D]] [[Ex|(X)]] [[Data Team|x]] `Data`" and got["a"]["decisions"] == "R&D [[Åsa]] Åsas"
    assert got["a"]["links"] == ["Data", "Ex", "Research", "Åsa"]
    assert got["b"]["agenda"] == "DataTeam Data_x [Data] xData ```Data\n``` [[Data]]" and got["b"]["decisions"] is None
    assert got["Data"]["agenda"] == "[[Data Team]], Data" and got["Data"]["decisions"] == "DT"
    assert got["c"]["links"] == []


def test_sources(spark, tmp_path):
    (tmp_path / "wiki" / ".hidden").mkdir(parents=True)
    (tmp_path / "wiki" / "A page.md").write_text('---\ntitle: "A"\nstatus: seed\n---\nbody [[B]]\n')
    (tmp_path / "wiki" / ".hidden" / "no.md").write_text("x")
    (tmp_path / "wiki" / "t.csv").write_text('a,b\n"x\ny",2\n')
    (tmp_path / "wiki" / "m.eml").write_bytes(b"From: a@b.c\nSubject: Hi\nContent-Type: text/plain\n\nhello\n")
    (tmp_path / "wiki" / "p.html").write_text("<html><head><title>t</title></head><body><h1>T</h1><p>a <b>b</b> <a href='u'>l</a></p><script>x</script></body></html>")
    root = str(tmp_path / "wiki")
    assert [(r["path"], r["stem"], r["title"], r["status"], r["body"]) for r in files.read_pages(spark, root).collect()] == [("A page.md", "A page", "A", "seed", "body [[B]]\n")]
    assert [r["cells"] for r in files.read_delimited(spark, root + "/t.csv").orderBy("row").collect()] == [["a", "b"], ["x\ny", "2"]]
    got = {r["path"]: (r["route"], r["text"]) for r in files.convert_files(spark, root).collect()}
    assert got["t.csv"] == ("policy-skip", None)
    assert got["p.html"][1] == "# T\n\na **b** [l](u)\n"
    assert "hello" in got["m.eml"][1] and "subject: 'Hi'" in got["m.eml"][1]


def test_streams(spark, tmp_path):
    from folioquill.streaming import jobs

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "add", "stale", "P", "a", "d1"), (2, "add", "link", "P", "b", "d2"), (3, "done", None, "P", None, "d3")], "seq int, op string, kind string, page string, detail string, date string").write.parquet(src)
    q = jobs.queue(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)).writeStream.outputMode("update").format("memory").queryName("queue").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["kind"], r["done"]) for r in spark.table("queue").collect()} == {("stale", True), ("link", True)}


def test_queue_listing_is_whole(spark):
    rows = [("k", f"p{i:03}", "d", f"2024-01-{i % 28 + 1:02}", i % 3 == 0, f"2024-02-{i % 5 + 1:02}" if i % 3 == 0 and i % 2 else None) for i in range(180)]
    df = spark.createDataFrame(rows, "kind string, page string, detail string, added string, done boolean, done_date string")
    got = {(r["done"], r["place"]): r["page"] for r in planning.queue_listing(df).collect()}
    still = sorted((r for r in rows if not r[4]), key=lambda r: (r[3], r[0], r[1]))
    done = sorted((r for r in rows if r[4]), key=lambda r: (r[5] or "", r[3]), reverse=True)
    assert got == {(r[4], i + 1): r[1] for part in (still, done) for i, r in enumerate(part)}


def test_long_and_forked_lineage(spark):
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(700)]
    fork = [(f"f{i}{a}", f"f{i + 1}{b}") for i in range(12) for a in "xy" for b in "xy"]  # 2^12 paths
    cycle = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("s", "r0")]
    sup = spark.createDataFrame(chain + fork + cycle, "page string, target string")
    by = sup.select(F.col("target").alias("page"), F.col("page").alias("target"))
    got = {(r["head"], r["page"]): r["depth"] for r in graph.lineage_chains(sup, by).collect()}
    assert all(got["c0000", f"c{i:04}"] == i for i in range(701))
    assert {(h, p, d) for (h, p), d in got.items() if h == "f0x"} == {("f0x", "f0x", 0), *((("f0x", f"f{i}{a}", i)) for i in range(1, 13) for a in "xy")}
    assert {(p, d) for (h, p), d in got.items() if h == "s"} == {("s", 0), ("r0", 1), ("r1", 2), ("r2", 3)}
    heads = {r["page"]: r["head"] for r in graph.chain_head(by).collect()}
    assert heads["c0700"] == "c0000" and heads["f12y"] == "f0x" and heads["r1"] == "s" and "c0000" not in heads

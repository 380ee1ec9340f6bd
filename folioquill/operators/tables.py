"""Table profiles, survey forms, glossary seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions import text as T

#: Row types of a survey that are structure, not questions.
STRUCTURE = ("begin group", "begin_group", "begin repeat", "begin_repeat", "end group", "end_group", "end repeat", "end_repeat")
#: Headers that name the term and the definition column of a glossary table.
TERM_HEADERS = ("term", "acronym", "abbreviation", "code", "name", "short")
DEFINITION_HEADERS = ("definition", "expansion", "meaning", "description", "full form", "full_form", "long", "stands for")
MICRODATA = r"(?i)\b(first|last|full)?[ _]?name\b|phone|mobile|latitude|longitude|\bgps\b|birth|passport|national[ _]id|address"


def _filled(cells: Column) -> Column:
    return F.exists(cells, lambda c: T.strip(c) != "")


def headers(sheets: DataFrame) -> DataFrame:
    """(file, sheet, header): the first row that has a filled cell, of sheets (file, sheet, row, cells)."""
    return sheets.where(_filled(F.col("cells"))).groupBy("file", "sheet").agg(F.min_by("cells", "row").alias("header"))


def sheet_profile(sheets: DataFrame, width: int = 12) -> DataFrame:
    """(file, sheet, rows, cols, header): header holds the filled ones among its first ``width`` cells."""
    size = sheets.groupBy("file", "sheet").agg(F.count("*").alias("rows"), F.max(F.size("cells")).cast("long").alias("cols"))
    head = headers(sheets).select("file", "sheet", F.filter(F.slice("header", 1, width), lambda c: T.strip(c) != "").alias("header"))
    return size.join(head, ["file", "sheet"], "left")


def columns_by_header(sheets: DataFrame, sheet: str) -> DataFrame:
    """(file, row, header, value) of the rows after the first of a sheet, one row per filled header."""
    x = sheets.where(F.lower(T.strip(F.col("sheet"))) == sheet)
    head = headers(x).select("file", F.posexplode("header").alias("i", "h")).select("file", "i", F.lower(T.strip(F.col("h"))).alias("header")).where("header <> ''")
    cells = x.where("row > 0").select("file", "row", F.posexplode("cells").alias("i", "value"))
    return cells.join(head, ["file", "i"]).select("file", "row", "header", T.strip(F.col("value")).alias("value"))


def form_profile(sheets: DataFrame) -> DataFrame:
    """(file, questions, groups, repeats, question_types, choice_lists, choice_options) of survey workbooks."""
    rows = columns_by_header(sheets, "survey").where("header = 'type' and value <> ''")
    full, base = F.lower("value"), F.lower(F.substring_index("value", " ", 1))
    structure = full.isin(*STRUCTURE) | base.isin(*[s for s in STRUCTURE if "_" in s])
    ends = full.startswith("end")
    x = rows.select("file", full.alias("full"), base.alias("base"), structure.alias("structure"), ends.alias("ends"))
    main = x.groupBy("file").agg(
        F.count_if(~F.col("structure") & (F.col("full") != "note")).alias("questions"), F.count_if(F.col("structure") & ~F.col("ends") & ~F.contains("full", F.lit("repeat"))).alias("groups"),
        F.count_if(F.col("structure") & ~F.col("ends") & F.contains("full", F.lit("repeat"))).alias("repeats"))
    kinds = x.where(~F.col("structure")).groupBy("file", "base").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("base", "n")))).alias("question_types"))
    lists = columns_by_header(sheets, "choices").where("header in ('list_name', 'list name') and value <> ''").groupBy("file", "value").agg(F.count("*").alias("n"))
    lists = lists.groupBy("file").agg(F.count("*").alias("choice_lists"), F.sum("n").alias("choice_options"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return main.join(kinds, "file", "left").join(lists, "file", "left").select("file", "questions", "groups", "repeats", "question_types", zero("choice_lists"), zero("choice_options"))


def largest_lists(sheets: DataFrame, top: int = 5) -> DataFrame:
    """(file, list, options): the ``top`` longest choice lists of each file."""
    x = columns_by_header(sheets, "choices").where("header in ('list_name', 'list name') and value <> ''").groupBy("file", F.col("value").alias("list")).agg(F.count("*").alias("options"))
    return x.withColumn("_r", F.row_number().over(W.partitionBy("file").orderBy(F.desc("options"), "list"))).where(F.col("_r") <= top).drop("_r")


def form_languages(sheets: DataFrame) -> DataFrame:
    """(file, languages): languages named in survey headers such as ``label::English (en)``."""
    x = headers(sheets.where(F.lower(T.strip(F.col("sheet"))) == "survey")).select("file", F.explode("header").alias("h"))
    lang = F.regexp_extract(T.strip(F.col("h")), r"(?i)\A(?:label|hint)::?\s*(.+)\z", 1)
    return x.select("file", lang.alias("lang")).where("lang <> ''").groupBy("file").agg(F.sort_array(F.collect_set("lang")).alias("languages"))


def microdata(sheets: DataFrame) -> DataFrame:
    """(file, sheet, sensitive): whether the headers look like records of people."""
    return headers(sheets).select("file", "sheet", F.exists("header", lambda h: h.rlike(MICRODATA)).alias("sensitive"))


def form_families(forms: DataFrame) -> DataFrame:
    """(family, files): files of one form id, else of one title."""
    return forms.groupBy(F.coalesce("form_id", "title").alias("family")).agg(F.sort_array(F.collect_list("file")).alias("files"))


def glossary(terms: DataFrame) -> DataFrame:
    """(term, definition, file_name) of terms (row, term, definition): the first row of each term, blanks dropped."""
    x = terms.select("row", T.strip(F.coalesce("term", F.lit(""))).alias("term"), T.strip(F.coalesce("definition", F.lit(""))).alias("definition")).where("term <> ''")
    x = x.groupBy(F.lower("term").alias("k")).agg(F.min(F.struct("row", "term", "definition")).alias("t"))
    return x.select("t.term", "t.definition", T.safe_filename(F.col("t.term")).alias("file_name"))


def new_stubs(terms: DataFrame, existing: DataFrame) -> DataFrame:
    """Terms whose page (file_name) does not exist yet."""
    return terms.join(existing.select("file_name"), "file_name", "left_anti")


def stub_page(term: Column, definition: Column, source: str, date: str | None = None) -> Column:
    """Text of a seeded page."""
    top = "---\ntype: entity\nentity_type: term\n" + (f"created: {date}\n" if date else "") + "glossary_seed: true\ntags: [glossary]\n---\n\n# "
    body = F.when(F.coalesce(definition, F.lit("")) == "", "_No definition provided in the seed table._").otherwise(definition)
    return F.concat(F.lit(top), term, F.lit("\n\n"), body, F.lit(f"\n\n> [!note] Seeded from `{source}`\n> Stub page — expand when this term is first discussed in a source.\n"))


def pick_columns(header: list[str]) -> tuple[int, int]:
    """Indices of the term and the definition column of a header row."""
    low = [h.strip().lower() for h in header]
    pick = lambda names: next((i for i, h in enumerate(low) if h in names), None)
    term, definition = pick(TERM_HEADERS), pick(DEFINITION_HEADERS)
    if term is None or definition is None:
        raise ValueError(f"no term or definition column among {header}")
    return term, definition

"""View definitions (filters, formulas, views, summaries) compiled to Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_][\w-]*(?:\.[A-Za-z_][\w-]*)*)|(?P<op>==|!=|>=|<=|&&|\|\||[-+*/%()<>!,.]))""")
POWER = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


@dataclass
class Duration:
    """A difference of two dates; only its fields are numbers."""

    days: Column


@dataclass
class Scope:
    """Where names lead: note properties are columns; ``file`` maps file fields to columns; formulas are compiled on use."""

    columns: list[str]
    file: dict[str, str] = field(default_factory=lambda: {"name": "name", "path": "path", "folder": "folder", "ext": "ext", "size": "size", "mtime": "mtime", "ctime": "ctime", "tags": "tags", "links": "links"})
    formulas: dict[str, str] = field(default_factory=dict)
    as_of: str = "1970-01-01"


class Parser:
    """Precedence climbing over one expression."""

    def __init__(self, text: str, scope: Scope, open_formulas: tuple[str, ...] = ()):
        self.scope, self.open, self.items, self.blank, at = scope, open_formulas, [], [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def take(self, want=None):
        kind, value = self.peek()
        if kind is None or (want and value != want):
            raise ValueError(f"expected {want or 'more'}, found {value!r}")
        self.at += 1
        return kind, value

    def parse(self):
        out = self.expression(0)
        if self.at != len(self.items):
            raise ValueError(f"unexpected {self.peek()[1]!r}")
        return out

    def expression(self, least):
        left = self.unary()
        while (op := self.peek()[1]) in POWER and self.peek()[0] == "op" and POWER[op] > least:
            self.take()
            left = binary(op, left, self.expression(POWER[op]))
        return left

    def unary(self):
        kind, value = self.peek()
        if kind == "op" and value in "!-":
            self.take()
            x = self.unary()
            return ~truth(x) if value == "!" else -x
        return self.postfix(self.primary())

    def arguments(self):
        self.take("(")
        out = []
        while self.peek()[1] != ")":
            out.append(self.expression(0))
            if self.peek()[1] == ",":
                self.take()
        self.take(")")
        return out

    def primary(self):
        kind, value = self.take()
        if kind == "num":
            return F.lit(float(value) if "." in value else int(value))
        if kind == "str":
            x = F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
            if len(value) == 2:
                self.blank.append(x)
            return x
        if value == "(":
            x = self.expression(0)
            self.take(")")
            return x
        if kind == "name":
            return self.name(value)
        raise ValueError(f"unexpected {value!r}")

    def name(self, value):
        called = self.peek()[1] == "("
        head, _, rest = value.partition(".")
        if called and not rest:
            return self.call(value, self.arguments())
        if value in ("true", "false", "null"):
            return F.lit({"true": True, "false": False, "null": None}[value])
        if head == "file":
            what, _, more = rest.partition(".")
            if called and not more:
                return self.file_call(what, self.arguments())
            return self.fields(F.col(self.scope.file[what]), more)
        if head == "formula":
            what, _, more = rest.partition(".")
            if what in self.open:
                raise ValueError(f"formula {what} refers to itself")
            return self.fields(Parser(self.scope.formulas[what], self.scope, (*self.open, what)).parse(), more)
        if head == "note":
            head, _, rest = rest.partition(".")
        return self.fields(F.col(head) if head in self.scope.columns else F.lit(None), rest)

    def fields(self, x, names):
        for n in filter(None, names.split(".")):
            x = self.method(x, n)
        return x

    def postfix(self, x):
        while self.peek()[1] == ".":
            self.take()
            for n in self.take()[1].split("."):
                x = self.method(x, n)
        return x

    def method(self, x, name):
        if isinstance(x, Duration):
            if name != "days":
                raise ValueError("a duration has .days only")
            return x.days
        args = self.arguments() if self.peek()[1] == "(" else []
        if name == "round":
            return F.round(x, args[0]) if args else F.round(x)
        if name == "length":
            return F.length(x)
        if name == "contains":
            return F.contains(x, args[0])
        if name in ("lower", "upper"):
            return getattr(F, name)(x)
        raise ValueError(f"unknown field {name!r}")

    def call(self, name, args):
        today = F.lit(self.scope.as_of).cast("date")
        if name == "if":
            yes, no = (F.lit(None) if any(a is b for b in self.blank) else a for a in (*args[1:], F.lit(None), F.lit(None))[:2])  # an empty text stands for no value
            return F.when(truth(args[0]), yes).otherwise(no)
        if name in ("now", "today"):
            return today
        if name == "date":
            return F.try_to_date(args[0].cast("string"), "yyyy-MM-dd")
        if name == "length":
            return F.length(args[0])
        if name in ("min", "max"):
            return (F.least if name == "min" else F.greatest)(*args)
        raise ValueError(f"unknown function {name!r}")

    def file_call(self, name, args):
        if name == "hasTag":
            return F.coalesce(reduce(lambda a, b: a | b, [F.array_contains(self.scope.file["tags"], a) for a in args]), F.lit(False))
        if name == "inFolder":
            folder = F.col(self.scope.file["folder"])
            return (folder == args[0]) | F.startswith(folder, F.concat(args[0], F.lit("/")))
        if name == "hasLink":
            return F.coalesce(F.array_contains(self.scope.file["links"], args[0]), F.lit(False))
        raise ValueError(f"unknown file function {name!r}")


def truth(x: Column) -> Column:
    """A value that is there: not null, empty, zero or false."""
    return F.coalesce(~F.lower(x.cast("string")).isin("", "0", "0.0", "false"), F.lit(False))


def binary(op, a, b):
    if op == "&&":
        return truth(a) & truth(b)
    if op == "||":
        return truth(a) | truth(b)
    if op == "==":
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b)
    if op in ("<", ">", "<=", ">="):
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if op == "-" and isinstance(a, Column) and isinstance(b, Column) and is_date(a) and is_date(b):
        return Duration(F.datediff(a, b))
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b}[op]()


def is_date(x: Column) -> bool:
    """Whether an expression was made by date(), now() or today()."""
    return bool(re.search(r"try_to_date|AS DATE|to_date|mtime|ctime", str(x), re.I))


def compile_expression(text: str, scope: Scope) -> Column:
    out = Parser(text, scope).parse()
    if isinstance(out, Duration):
        raise ValueError("a duration is no value; take its .days")
    return out


def compile_filter(spec, scope: Scope) -> Column:
    """A predicate string, or nested {and: [...]}, {or: [...]}, {not: [...]}; none keeps all."""
    if not spec:
        return F.lit(True)
    if isinstance(spec, str):
        return truth(compile_expression(spec, scope))
    (kind, parts), *more = spec.items()
    if more or kind not in ("and", "or", "not"):
        raise ValueError(f"a filter has one of and, or, not: {spec}")
    built = [compile_filter(p, scope) for p in (parts if isinstance(parts, list) else [parts])]
    if kind == "not":
        return ~reduce(lambda a, b: a | b, built)
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), built)


def run_view(pages: DataFrame, base: dict, view: str | None = None, as_of: str = "1970-01-01") -> DataFrame:
    """One view of a definition: global and own filters, columns in order, group sort, limit."""
    views = base.get("views") or [{"type": "table"}]
    chosen = next(v for v in views if view is None or v.get("name") == view)
    if chosen.get("type", "table") not in ("table", "cards", "list"):
        raise ValueError(f"unknown view type {chosen['type']!r}")
    scope = Scope(pages.columns, formulas=base.get("formulas") or {}, as_of=as_of)
    x = pages.where(compile_filter(base.get("filters"), scope) & compile_filter(chosen.get("filters"), scope))
    wanted = chosen.get("order") or pages.columns
    cols = [compile_expression(c, scope).alias(c.replace(".", "_")) for c in wanted]
    group = chosen.get("groupBy")
    key = compile_expression(group["property"], scope) if group else None
    x = x.select(*cols, *([key.alias("_group")] if group else []))
    if group:
        x = x.orderBy(F.col("_group").desc() if group.get("direction", "ASC").upper() == "DESC" else F.col("_group").asc(), *[F.col(c.replace(".", "_")) for c in wanted])
        x = x.limit(chosen["limit"]) if chosen.get("limit") else x
        return x.drop("_group")
    return x.orderBy(*[F.col(c.replace(".", "_")) for c in wanted]).limit(chosen["limit"]) if chosen.get("limit") else x


#: What a summary of a column can be.
SUMMARIES = {
    "Sum": F.sum, "Average": F.avg, "Min": F.min, "Max": F.max, "Median": F.median, "Stddev": F.stddev, "Range": lambda c: F.max(c) - F.min(c), "Unique": F.count_distinct,
    "Filled": F.count, "Empty": lambda c: F.count_if(F.col(c).isNull()), "Checked": lambda c: F.count_if(F.col(c)), "Unchecked": lambda c: F.count_if(~F.col(c)), "Earliest": F.min, "Latest": F.max,
}


def summarize(df: DataFrame, summaries: dict[str, str]) -> DataFrame:
    """One row of column summaries."""
    return df.agg(*[SUMMARIES[s](c).alias(c) for c, s in summaries.items()])


def dataview(pages: DataFrame, query: str, as_of: str = "1970-01-01") -> DataFrame:
    """``TABLE a, b FROM "folder" WHERE e SORT f DESC LIMIT n`` or ``LIST ...`` over pages (path, name, ...)."""
    m = re.fullmatch(r"""(?is)\s*(TABLE|LIST)\s*(.*?)(?:\s*FROM\s+"([^"]*)")?(?:\s+WHERE\s+(.+?))?(?:\s+SORT\s+(\S+)(?:\s+(ASC|DESC))?)?(?:\s+LIMIT\s+(\d+))?\s*""", query)
    if not m:
        raise ValueError(f"cannot read {query!r}")
    kind, cols, folder, where, sort, way, limit = m.groups()
    scope = Scope(pages.columns, as_of=as_of)
    x = pages
    if folder:
        x = x.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    if where:
        expr = re.sub(r"(?<![=!<>])=(?!=)", "==", re.sub(r"\bOR\b", "||", re.sub(r"\bAND\b", "&&", where)))
        missing = re.sub(r"!(\w[\w-]*)", r"(\1 == null)", expr)
        x = x.where(truth(compile_expression(missing, scope)))
    wanted = ["name"] + ([c.strip() for c in cols.split(",") if c.strip()] if kind.upper() == "TABLE" else [])
    if sort:
        key = compile_expression(sort, scope)
        x = x.orderBy(key.desc() if (way or "").upper() == "DESC" else key.asc(), "name")
    x = x.limit(int(limit)) if limit else x
    return x.select(*[compile_expression(c, scope).alias(c.replace(".", "_")) for c in wanted])

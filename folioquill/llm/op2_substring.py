"""Substring dedup on sliding sentence spans.

A text is cut into sentences at stops and line ends, and long sentences further at places that
their own words decide, so that passages which begin inside a sentence, texts without stops and
other scripts meet too. From every sentence a span runs on until it holds ``PASSAGE`` words. Spans
are hashed over their words and joined over all documents; the sentences under any span that is not
its text's first (by doc_id and place) are removed.

Sentences and words are found in numpy over the code points of many texts at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, tidy

PASSAGE = 32  # words that make a span
CUT = 4  # a sentence ends early after one in so many of its words
FLUSH = 500_000  # spans that a task compares before it sends them on
ROWS, CHUNK = 1000, 1 << 19  # rows and characters that are parsed at a time, but for longer texts
#: Fixed values, as characters of a regular expression's class: what ends a sentence, white space, and letters of scripts without blanks, each of them a word.
STOP = r".!?\n\r\x{85}\x{2028}\x{2029}\x{3002}\x{FF0E}\x{FF61}\x{FF01}\x{FF1F}\x{2026}\x{203C}\x{2047}-\x{2049}\x{61F}\x{6D4}\x{964}\x{965}"
SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
U = np.uint64


def members(chars: str) -> np.ndarray:
    """Which code points a class of characters holds."""
    one = r"\\x\{([0-9A-F]+)\}|\\([tnr])|(.)"
    point = lambda m: int(m[1], 16) if m[1] else ord({"t": "\t", "n": "\n", "r": "\r"}[m[2]]) if m[2] else ord(m[3])
    found, at = np.zeros(0x110000, bool), [(m.group(), point(m)) for m in re.finditer(one, chars)]
    for k, (sign, p) in enumerate(at):
        if sign == "-":
            found[at[k - 1][1] : at[k + 1][1] + 1] = True
        else:
            found[p] = True
    return found


IS_STOP, IS_SPACE, IS_UNSPACED = map(members, (STOP, SPACE, UNSPACED))


RESERVED = {"_n_sentences", "_n_removed", "_n_cut_chars", "__cut", "__at", "__size", "__doc_id"}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def run_hashes(value: np.ndarray, first: np.ndarray, past: np.ndarray, base: int) -> np.ndarray:
    """Hash of value[a:b], modulo 2^64 in powers of an odd base, for every pair of ``first`` and ``past``."""
    n = len(value)
    up = np.cumprod(np.r_[U(1), np.full(n, base, U)])
    down = np.cumprod(np.r_[U(1), np.full(n, pow(base, -1, 2**64), U)])
    sums = np.r_[U(0), np.cumsum(value * up[:n])]
    return mix((sums[past] - sums[first]) * down[first] + (past - first).astype(U))


class Parsed:
    """The sentences with words of several texts, in order.

    doc: index of the text; n: words; lo, hi: characters [lo, hi) of all texts in a row; word: the
    first word of each sentence and, last, the number of words; words: hashes of the words.
    """

    def __init__(self, texts: list[str]):
        x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(size) - size  # of each text, in characters
        n = len(x)
        begins = np.zeros(n + 1, bool)
        begins[self.start] = True
        begins = begins[:n]
        stop, space, single = IS_STOP[x], IS_SPACE[x], IS_UNSPACED[x]
        before = lambda a: np.r_[False, a[:-1]] if n else a
        sentence = begins | (before(stop) & ~stop)
        starts = ~space & (sentence | before(space) | single | before(single))
        ends = ~space & np.r_[space[1:] | starts[1:], True] if n else space
        a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        low = np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint32)
        self.words = np.empty(len(a), U)
        for k in range(0, len(a), 1 << 18):  # so that a long text needs few bytes a character
            i, j = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
            self.words[k : k + (1 << 18)] = run_hashes(mix(low[i[0] : j[-1]].astype(U) + U(1)), i - i[0], j - i[0], 0x9E3779B97F4A7C15)
        at = np.flatnonzero(sentence)
        of = np.searchsorted(at, a, side="right") - 1  # sentence of each word
        key = low[a].astype(np.int64) * 31 + (b - a) * 17
        last = np.r_[of[1:] != of[:-1], True] if len(a) else np.empty(0, bool)
        prior = np.where(before_word(last), 0, np.r_[0, key[:-1]][: len(a)])
        cut = last | ((key + prior * 13) // 7 % CUT == 0)
        e = np.flatnonzero(cut)
        self.word = np.r_[0, e + 1]
        self.n = np.diff(self.word)
        past = np.r_[at[1:], n]  # of each sentence
        self.hi = np.where(last[e], past[of[e]], b[e])
        first = self.word[:-1]
        self.lo = np.where(before_word(last)[first], at[of[first]], np.r_[0, self.hi[:-1]][: len(e)])
        self.doc = np.searchsorted(self.start + size, a[first], side="right")

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last sentence of every span."""
        i = np.arange(len(self.n))
        j = np.searchsorted(self.word, self.word[:-1] + PASSAGE)
        ok = j < len(self.word)
        i, j = i[ok], j[ok]
        ok = self.doc[i] == self.doc[j - 1]
        return i[ok], j[ok]


def before_word(last: np.ndarray) -> np.ndarray:
    """Of words: is the one before the last of its sentence? True for the first."""
    return np.r_[True, last[:-1]] if len(last) else last


def chunks(texts: list[str], most: int):
    """Slices of the texts of about ``most`` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def first_of(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each row, the first row of its run of equal (h, g)."""
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    return np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


def hash_spans(chunk: int, most: int):
    """(h, g, doc_id, place) of every span: its 128-bit hash and, in ``place``, first sentence, sentences and whether it is ``later``.

    A span that stands earlier among those that the task holds is later for certain: such rows need
    not meet the others, so of a hot span one row of a task does.
    """
    def flush(held):
        h, g, doc, place = map(np.concatenate, zip(*held))
        order = np.lexsort((place, doc, g, h))
        h, g, doc, place = (c[order] for c in (h, g, doc, place))
        of = first_of(h, g)
        later = (doc != doc[of]) | (place != place[of])
        return pa.RecordBatch.from_arrays(list(map(pa.array, (h, g, doc, place | later))), names=["h", "g", "doc_id", "place"])

    def run(batches):
        held, size = [], 0
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids, texts = np.asarray(batch.column(0)), [t or "" for t in batch.column(1).to_pylist()]
            for a, e in chunks(texts, chunk):
                x = Parsed(texts[a:e])
                i, j = x.spans()
                if len(i):
                    h, g = (run_hashes(x.words, x.word[i], x.word[j], base).view(np.int64) for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
                    at = i - np.searchsorted(x.doc, x.doc[i])
                    held.append((h, g, ids[a:e][x.doc[i]], (at << 8) | ((j - i) << 1)))
                    size += len(i)
                if size > most:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def later_spans(batches):
    """(doc_id, at, size) of the spans that are not the first of their hash, from rows sorted by hash, document and place."""
    last = None  # the first row of the hash that the batch before ended with
    for batch in batches:
        h, g, doc, place = map(np.asarray, batch.columns)
        out = place & 1 == 1
        k = np.flatnonzero(~out)
        if len(k):
            x = [np.r_[np.array([v] if last else [], np.int64), c[k]] for c, v in zip((h, g, doc, place), last or [None] * 4)]
            of = first_of(*x[:2])
            out[k] = ((x[2] != x[2][of]) | (x[3] != x[3][of]))[len(of) - len(k) :]
            last = [c[of[-1]] for c in x]
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(place[out] >> 8), pa.array(place[out] >> 1 & 127)], names=["doc_id", "at", "size"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, at, size) of every span that is not the first of its text."""
    x = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    x = x.mapInArrow(hash_spans(CHUNK, FLUSH), "h long, g long, doc_id long, place long")
    x = x.repartition(F.when(F.col("place") % 2 == 0, F.col("h")).otherwise(F.xxhash64("doc_id", "place")))
    return x.sortWithinPartitions("h", "g", "doc_id", "place").mapInArrow(later_spans, "doc_id long, at long, size long")


@tidy
def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``text`` cut, and _n_sentences, _n_removed, _n_cut_chars.

    A null text stays null; texts without words have no sentences and stay. Of texts under equal
    (doc_id, place) in rows of one doc_id all are the first, so give unique ids; a null doc_id is
    neither compared nor cut. Extra columns pass through; those with a name of the three new columns
    (or of RESERVED, used inside) give way. An empty table gives no rows.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in RESERVED])
    gone = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("at", "size")).alias("__cut"))  # at most a document's own spans
    names = docs.columns
    gone = materialize(gone, "cuts", keep=True).withColumnRenamed("doc_id", "__doc_id")
    keep = [c for c in names if c != "text"]
    y = docs.join(gone, F.col("doc_id").cast("long") == F.col("__doc_id"), "left")
    y = y.select(*keep, F.col("text").cast("string").alias("text"), F.col("__cut.at").alias("__at"), F.col("__cut.size").alias("__size"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in y.select(*keep, "text").schema.fields) + ", _n_sentences long, _n_removed long, _n_cut_chars long"

    def cut(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts, at, size = batch.column("text").to_pylist(), batch.column("__at"), batch.column("__size")
            counts = np.zeros((3, len(texts)), np.int64)
            for a, e in chunks([t or "" for t in texts], CHUNK):
                x = Parsed([t or "" for t in texts[a:e]])
                first = np.searchsorted(x.doc, np.arange(e - a + 1))
                counts[0, a:e] = np.diff(first)
                for d in np.flatnonzero(np.asarray(at.is_valid())[a:e]).tolist():
                    mark, i = np.zeros(first[d + 1] - first[d] + 1, np.int64), np.asarray(at[a + d].values)
                    np.add.at(mark, i, 1)
                    np.add.at(mark, i + np.asarray(size[a + d].values), -1)
                    off = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                    lo, hi = (v[first[d] + off] - x.start[d] for v in (x.lo, x.hi))
                    new = np.r_[True, lo[1:] != hi[:-1]]
                    text, kept, past = texts[a + d], [], 0
                    for p, q in zip(lo[new].tolist(), hi[np.r_[new[1:], True]].tolist()):
                        kept.append(text[past:p])
                        past = q
                    texts[a + d] = "".join([*kept, text[past:]])
                    counts[1:, a + d] = len(off), len(text) - len(texts[a + d])
            cols = [batch.column(c) for c in keep] + [pa.array(texts, pa.string())] + [pa.array(c) for c in counts]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "_n_sentences", "_n_removed", "_n_cut_chars"])

    return y.mapInArrow(cut, schema).select(*names, "_n_sentences", "_n_removed", "_n_cut_chars")


def removal_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_sentences, n_removed, n_cut_chars, kept_sha256 (null text: of the empty string), repeated (n_removed > 0)."""
    x = remove_repeats(docs.select("doc_id", "text"))
    return x.select("doc_id", F.col("_n_sentences").alias("n_sentences"), F.col("_n_removed").alias("n_removed"), F.col("_n_cut_chars").alias("n_cut_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), (F.col("_n_removed") > 0).alias("repeated"))


SQL = rf"""
WITH sentence AS (
  SELECT doc_id, s, p[s] AS t, regexp_extract_all(p[s], '[{SPACE}]*(?:[{UNSPACED}]|[^{SPACE}{UNSPACED}]+)') AS ws
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{STOP}]+[{STOP}]*|[{STOP}]+') AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(s)),
word AS (
  SELECT *, unicode(w) * 31 + length(w) * 17 AS key FROM (
    SELECT doc_id, s, j, j = len(ws) AS last, ws[j] || CASE WHEN j = len(ws) THEN substr(t, 1 + length(array_to_string(ws, ''))) ELSE '' END AS written,
      translate(regexp_replace(ws[j], '^[{SPACE}]+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
    FROM sentence, unnest(range(1, len(ws) + 1)) AS u(j))),
cut AS (SELECT *, last OR (key + 13 * coalesce(lag(key) OVER (PARTITION BY doc_id, s ORDER BY j), 0)) // 7 % {CUT} = 0 AS cut FROM word),
placed AS (
  SELECT *, row_number() OVER d - 1 AS k, coalesce(sum(CAST(cut AS INT)) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM cut WINDOW d AS (PARTITION BY doc_id ORDER BY s, j)),
part AS (SELECT doc_id, part, min(k) AS first, max(k) + 1 AS past FROM placed GROUP BY doc_id, part),
span AS (SELECT a.doc_id, a.part, a.first, b.part AS final, b.past - a.first AS n FROM part a ASOF JOIN part b ON a.doc_id = b.doc_id AND a.first + {PASSAGE} <= b.past),
run AS (
  SELECT doc_id, part, final, words FROM (
    SELECT p.doc_id, s.part, s.final, string_agg(w, ' ') OVER (PARTITION BY p.doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND coalesce(s.n - 1, 0) FOLLOWING) AS words
    FROM placed p LEFT JOIN span s ON p.doc_id = s.doc_id AND p.k = s.first) WHERE final IS NOT NULL),
later AS (SELECT doc_id, part, final FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, part) AS nth FROM run) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, x AS part FROM later, unnest(range(CAST(part AS BIGINT), CAST(final AS BIGINT) + 1)) AS u(x)),
told AS (SELECT p.doc_id, p.s, p.j, p.written, p.part, p.cut, g.part IS NOT NULL AS off FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.part = g.part
  UNION ALL SELECT doc_id, s, 0, t, NULL, false, false FROM sentence WHERE len(ws) = 0),
kept AS (
  SELECT doc_id, string_agg(written, '' ORDER BY s, j) FILTER (WHERE NOT off) AS text, count(*) FILTER (WHERE cut) AS n, count(*) FILTER (WHERE cut AND off) AS n_removed, sum(CASE WHEN off THEN length(written) ELSE 0 END) AS cut_chars
  FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(cut_chars, 0) AS BIGINT) AS n_cut_chars, sha256(coalesce(k.text, '')) AS kept_sha256, coalesce(n_removed, 0) > 0 AS repeated
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

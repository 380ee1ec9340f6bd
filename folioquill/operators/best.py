"""The best rows of each query in one pass over the rows: numpy kernels on Arrow batches, with no row for each (query, row) pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

#: Cells (rows of a slice times queries or terms) that a kernel holds at a time.
CELLS = 1_000_000
#: Runs whose matches a task remembers.
REMEMBERED = 500_000


class Questions:
    """Queries by term: for term t, ``query[start[t]:start[t] + count[t]]`` and the weights beside them."""

    def __init__(self, rows: list[tuple]):
        """rows: (query_id, term, weight), one for each query and term."""
        self.ids = list(dict.fromkeys(r[0] for r in rows))
        self.terms = sorted({r[1] for r in rows})
        q, t = {v: i for i, v in enumerate(self.ids)}, {v: i for i, v in enumerate(self.terms)}
        term = np.array([t[r[1]] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        self.query = np.array([q[r[0]] for r in rows], np.int64)[order]
        self.weight = np.array([r[2] for r in rows], np.float64)[order]
        self.count = np.bincount(term, minlength=len(self.terms))
        self.start = np.cumsum(self.count) - self.count

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posting, place): every query of every posting's term, as the posting's number and a place in ``query``."""
        n = self.count[term]
        posting = np.repeat(np.arange(len(term)), n)
        first = np.repeat(self.start[term] - (np.cumsum(n) - n), n)
        return posting, first + np.arange(len(posting))

    def step(self) -> int:
        """Rows of a slice."""
        return max(1, min(1000, CELLS // max(len(self.ids), len(self.terms), len(self.query), 1)))


class Best:
    """The k rows of each query with the largest key; equal keys go by the first label. Slices come one after the other."""

    def __init__(self, queries: int, k: int, labels: int, values: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.key = np.zeros(0, np.int64), np.zeros(0)
        self.labels = [np.zeros(0, object) for _ in range(labels)]
        self.values = [np.zeros(0) for _ in range(values)]

    def add(self, hit: np.ndarray, key: np.ndarray, labels: list[np.ndarray], values: list[np.ndarray]) -> None:
        """hit, key and values: (rows, queries); labels: (rows,) objects."""
        row, query = np.nonzero(hit & (key >= self.floor))
        if not len(row):
            return
        q, key = np.concatenate([self.query, query]), np.concatenate([self.key, key[row, query]])
        labels = [np.concatenate([a, b[row]]) for a, b in zip(self.labels, labels)]
        values = [np.concatenate([a, b[row, query]]) for a, b in zip(self.values, values)]
        order = np.lexsort((np.unique(labels[0], return_inverse=True)[1], -key, q))
        sorted_q = q[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        keep, last = order[nth < self.k], order[nth == self.k - 1]
        self.floor[q[last]] = key[last]
        self.query, self.key = q[keep], key[keep]
        self.labels, self.values = [a[keep] for a in labels], [a[keep] for a in values]


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of every element of a list column, and the elements; null lists are empty."""
    return np.asarray(pc.list_parent_indices(column), np.int64), pc.list_flatten(column)


def _best(rows: DataFrame, questions: Questions, id_type, k: int, labels: list[str], values: list[str], score: Callable[[pa.RecordBatch], tuple]) -> DataFrame:
    schema = StructType().add("query_id", id_type)
    for name in labels:
        schema = schema.add(rows.schema[name])
    for name in values:
        schema = schema.add(name, "double")
    kind, arrow = to_arrow_type(id_type), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(len(questions.ids), k, len(labels), len(values)), questions.step()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                hit, key, found = score(part)
                best.add(hit, key, [np.array(part.column(n).to_pylist(), object) for n in labels], found)
        if len(best.query):
            ids = pa.array([questions.ids[q] for q in best.query], kind)
            columns = [ids, *(pa.array(v.tolist(), arrow.field(n).type) for n, v in zip(labels, best.labels)), *(pa.array(v, pa.float64()) for v in best.values)]
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return rows.mapInArrow(run, schema)


def best_bm25(rows: DataFrame, weighted: list[tuple], id_type, mean: float, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, chunk_id, page, score) that holds the k best chunks of each query; more may stand in it.

    rows: (chunk_id, page, dl, kept), kept being the chunk's tokens that are query terms; weighted: (query_id, term, weight).
    """
    questions = Questions(weighted)
    known = {t: i for i, t in enumerate(questions.terms)}

    def score(part):
        n, q = part.num_rows, len(questions.ids)
        row, words = _lists(part.column("kept"))
        coded = words.dictionary_encode()
        code = np.array([known.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
        term = code[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
        cell, tf = np.unique((row * len(known) + term)[term >= 0], return_counts=True)
        row, term = np.divmod(cell, len(known))
        posting, place = questions.expand(term)
        length = np.asarray(part.column("dl"), np.float64)
        below = tf + k1 * (1 - b + b * length[row] / mean)
        add = questions.weight[place] * tf[posting] * (k1 + 1) / below[posting]
        cells = row[posting] * q + questions.query[place]
        total = np.bincount(cells, add, n * q).reshape(n, q)
        hit = np.zeros(n * q, bool)
        hit[cells] = True
        return hit.reshape(n, q), np.floor(total * 1e6 + 0.5), [total]

    return _best(rows.select("chunk_id", "page", "dl", "kept"), questions, id_type, k, ["chunk_id", "page"], ["score"], score)


def best_substrings(rows: DataFrame, terms: list[tuple], id_type, k: int) -> DataFrame:
    """(query_id, page, boost, distinct_terms, total) that holds the k best pages of each query by distinct_terms + total / 100 + boost.

    rows: (page, boost, runs), runs being what a term may stand in; terms: (query_id, term). What stands in a run is looked
    up by every substring as long as some term, once for each run that a task remembers.
    """
    questions = Questions([(q, t, 1.0) for q, t in terms])
    known = {t: i for i, t in enumerate(questions.terms)}
    sizes = sorted({len(t) for t in known})
    seen: dict[str, tuple] = {}

    def matches(run):
        found = seen.get(run)
        if found is None:
            inside = {run[i : i + size] for size in sizes if size <= len(run) for i in range(len(run) - size + 1)} & known.keys()
            found = tuple(known[t] for t in inside), tuple(run.count(t) for t in inside)
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen[run] = found
        return found

    def score(part):
        n, q, t = part.num_rows, len(questions.ids), len(known)
        row, runs = _lists(part.column("runs"))
        coded = runs.dictionary_encode()
        found = [matches(run) for run in coded.dictionary.to_pylist()]
        size = np.array([len(f[0]) for f in found], np.int64)
        ids = np.array([i for f in found for i in f[0]], np.int64)
        times = np.array([i for f in found for i in f[1]], np.float64)
        code = np.asarray(coded.indices) if len(runs) else np.zeros(0, np.int64)
        each = size[code]
        at = np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        total = np.bincount(np.repeat(row, each) * t + ids[at], times[at], n * t)
        cell = np.nonzero(total)[0]
        posting, place = questions.expand(cell % t)
        cells = (cell // t)[posting] * q + questions.query[place]
        distinct = np.bincount(cells, minlength=n * q).reshape(n, q).astype(np.float64)
        sums = np.bincount(cells, total[cell][posting], n * q).reshape(n, q)
        boost = np.asarray(part.column("boost"), np.float64)[:, None]
        return distinct > 0, 100 * distinct + sums + 100 * boost, [distinct, sums]

    return _best(rows.select("page", "boost", "runs"), questions, id_type, k, ["page", "boost"], ["distinct_terms", "total"], score)

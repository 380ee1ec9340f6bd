"""Word counts of each chunk in one pass over the chunks: a numpy kernel on Arrow batches, no shuffle of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words that the kernel counts at a time; a chunk with more is counted alone.
WORDS = 200_000


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches whose sizes sum to at most ``most``, or that are one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        yield at, max(end - at, 1)
        at = max(end, at + 1)


def count_words(rows: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, page, dl) of rows (chunk_id, page, tokens): a row with tf for each row's distinct words, and one without a term that has its page and number of words."""
    schema = StructType().add("term", "string").add("chunk_id", rows.schema["chunk_id"].dataType).add("tf", "long").add("page", rows.schema["page"].dataType).add("dl", "long")
    kinds, most = to_arrow_schema(schema), WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0), np.int64)
            for at, n in slices(sizes, most):
                part = batch.slice(at, n)
                ids, page, tokens = (part.column(c) for c in ("chunk_id", "page", "tokens"))
                nulls = [pa.nulls(n, k) for k in kinds.types]
                yield pa.RecordBatch.from_arrays([nulls[0], ids, nulls[2], page, pa.array(sizes[at : at + n])], names=kinds.names)
                words = pc.list_flatten(tokens).dictionary_encode()
                if not len(words):
                    continue
                row, several = np.asarray(pc.list_parent_indices(tokens), np.int64), len(words.dictionary)
                cell, tf = np.unique(row * several + np.asarray(words.indices), return_counts=True)
                row, term = np.divmod(cell, several)
                nulls = [pa.nulls(len(cell), k) for k in kinds.types]
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term)), ids.take(pa.array(row)), pa.array(tf.astype(np.int64)), nulls[3], nulls[4]], names=kinds.names)

    return rows.select("chunk_id", "page", "tokens").mapInArrow(run, schema)

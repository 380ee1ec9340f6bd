"""Structured Streaming forms of the incremental behaviours. Extensions: the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def new_files(files: DataFrame, time: str = "modified", delay: str = "1 day") -> DataFrame:
    """Files (path, hash, time) not seen within the watermark."""
    return files.withWatermark(time, delay).dropDuplicatesWithinWatermark(["path", "hash"])


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """(key, start, end, n): events of a key that follow one another within the gap."""
    x = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return x.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, key: str, time: str = "ts", size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(key, start, n): events per tumbling window."""
    x = events.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"))
    return x.select(key, F.col("w.start").alias("start"), "n")


def queue(events: DataFrame) -> DataFrame:
    """(kind, page, detail, added, done): the queue's items as they change; events (seq, op, kind, page, detail, date).

    One state for each page, since closing a page without a kind closes all of its items.
    """
    import pandas as pd

    def step(key, batches, state):
        items = {k: v for k, v in zip(*state.get)} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq")
        out = {}
        for r in rows.itertuples(index=False):
            if r.op == "add":
                old = items.get(r.kind)
                items[r.kind] = (r.detail, old[1] if old else r.date)
                out[r.kind] = (*items[r.kind], False)
            else:
                for kind in [r.kind] if isinstance(r.kind, str) else list(items):
                    if kind in items:
                        out[kind] = (*items.pop(kind), True)
        state.update((list(items), [list(v) for v in items.values()]))
        yield pd.DataFrame([(k, key[0], *v) for k, v in out.items()], columns=["kind", "page", "detail", "added", "done"])

    return events.groupBy("page").applyInPandasWithState(step, "kind string, page string, detail string, added string, done boolean", "kinds array<string>, items array<array<string>>", "update", "NoTimeout")

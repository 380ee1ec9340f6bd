"""Best-fit packing by large-item matching.

Documents become token ids plus an end id; longer ones are cut from the end into whole
sequences. What is left is a multiset of sizes from 1 to the capacity, so the packing itself is
solved on the histogram of sizes (as many entries as the capacity, whatever the corpus) and
dealt back to the rows by their rank within a size.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import gapless_rank, materialize, tidy

CAPACITY, END_ID = 1024, 2
#: Fixed value: the pre-tokenising pattern of the public byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder(dict):
    """Token ids of a text, as little-endian 32-bit bytes.

    A single space between two non-space characters always starts a new pre-token, so words
    that follow one are encoded once and kept in a bounded cache. Texts with runs of white space
    are encoded whole; texts that name a special token go to the vocabulary file's own library.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(visible)]
        byte = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}
        spec = json.loads(vocabulary)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.plain = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_str(vocabulary)
        self.runs = re.compile(r"\s\s")

    @staticmethod
    def packed(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        out = self.packed(self.plain.encode_ordinary(" " + word))
        if len(word) < 40:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        if self.runs.search(text):
            return self.packed(self.plain.encode_ordinary(text))
        first, *rest = text.split(" ")
        return self.packed(self.plain.encode_ordinary(first)) + b"".join(map(self.__getitem__, rest))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null text counts as empty."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches):
        encoder = Encoder(vocabulary.value)
        end = struct.pack("<I", end_id)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    for column, x in zip(out, (doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]))):
                        column.append(x)
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``counts[size]`` items of each size; returns runs (size, from_rank, to_rank, first_sequence, per_sequence, offset).

    Sizes over a third of the capacity share a sequence with at most one other of their kind: the
    largest left is matched with the largest that still fits. Smaller sizes, in falling order,
    fill the tightest gap that holds them; a new sequence is opened when none does.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used, runs, sequences = dict.fromkeys(left, 0), [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap -> (first sequence, how many)

    def place(size, n, base, per, offset):
        runs.append((size, used[size], used[size] + n, base, per, offset))
        used[size] += n
        left[size] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            mate = next((t for t in large if t <= min(s, capacity - s) and left[t] >= (2 if t == s else 1)), None)
            n = left[s] if mate is None else left[s] // 2 if mate == s else min(left[s], left[mate])
            place(s, n, sequences, 1, 0)
            if mate is not None:
                place(mate, n, sequences, 1, s)
            gaps[capacity - s - (mate or 0)].append((sequences, n))
            sequences += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = next((g for g in range(s, capacity + 1) if gaps[g]), None)
            if gap is None:
                n = -(-left[s] // (capacity // s))
                gaps[capacity].append((sequences, n))
                sequences, gap = sequences + n, capacity
            base, bins = gaps[gap].pop()
            per = gap // s
            full = min(bins, left[s] // per)
            if full:
                place(s, full * per, base, per, capacity - gap)
                gaps[gap - per * s].append((base, full))
                base, bins = base + full, bins - full
            if bins and left[s]:  # fewer than one sequence takes
                n = left[s]
                place(s, n, base, n, capacity - gap)
                gaps[gap - n * s].append((base, 1))
                base, bins = base + 1, bins - 1
            if bins:
                gaps[gap].append((base, bins))
    return runs


@tidy
def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text is an empty
    document (the end id alone). Repeated doc_ids are told apart by nothing but their order of
    rank, so give unique ids. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces", keep=True)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = pack_histogram(counts, capacity)
    if not runs:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    names = ["length", "r0", "r1", "base", "per", "off"]
    table = spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*runs))}))
    ranked = gapless_rank(pieces.withColumn("_id", F.struct("doc_id", "piece")), ["length"], "_id", sum(counts.values())).drop("_id")
    # the runs are bounded by the capacity, not by the corpus; beyond the checked size they are joined without a broadcast
    table = F.broadcast(table) if len(runs) < 200_000 else table
    hit = ranked.join(table, "length").where("rank >= r0 and rank < r1")
    return hit.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor((F.col("rank") - F.col("r0")) / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("off") + F.pmod(F.col("rank") - F.col("r0"), F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )

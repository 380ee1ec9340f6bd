"""Suffix-array dedup of repeated 400-byte strings.

Comparing every shard's suffix array with every other's would grow with the square of the corpus,
so content decides the shards. Every 400-byte window owns to the smallest 64-byte hash inside it
(its anchor); equal windows have equal anchors at equal offsets. A piece is a document's run of
windows with one anchor. Anchors that occur once end there; pieces that are equal as a whole are
settled by their digests; one copy of each piece that is left goes to the shard of its anchor.
A shard's suffixes are sorted by Larsson-Sadakane refinement, their common prefixes found by
Kasai's rule, and windows that share 400 bytes are repeated. An anchor with very many bytes of different
pieces is split over several shards, whose sorted windows are merged by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, split_join, tidy

LENGTH, GRAM = 400, 64
CHUNK_BITS = 19
SHARD_BYTES = 1_500_000  # suffixes are numbered with 21 bits, so 2^21 bytes are the most
GROUP_BYTES = SHARD_BYTES // 2  # of pieces of one anchor; more are dealt over several shards
U = np.uint64

_rng = np.random.default_rng(400)
BYTE = _rng.integers(1, 2**63, 256, np.int64).astype(U) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x):
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(32))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(29))


class Powers:
    """Powers of the base and of its inverse modulo 2^64."""

    def __init__(self, n: int):
        self.up = np.cumprod(np.r_[U(1), np.full(n, BASE, U)])
        self.down = np.cumprod(np.r_[U(1), np.full(n, pow(BASE, -1, 2**64), U)])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by prefix and suffix minima of blocks."""
    n = len(x)
    y = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    y[:n] = x
    blocks = y.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def pieces_of(x: np.ndarray, ok: np.ndarray, p: Powers, length: int, gram: int):
    """Pieces of a byte array as (anchor hash, digest, first window, windows, anchor's offset in the piece); ok: windows that may start."""
    sums = np.r_[U(0), np.cumsum(BYTE[x] * p.up[: len(x)])]
    n = len(x) - gram + 1
    h = mix((sums[gram:] - sums[:n]) * p.down[:n])
    low = U((1 << CHUNK_BITS) - 1)
    best = sliding_min((h & ~low) | np.arange(n, dtype=U), length - gram + 1)
    at = np.flatnonzero(ok[: len(best)])
    if not len(at):
        return None
    anchor = (best[at] & low).astype(np.int64)
    start = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    first, count, a = at[start], np.diff(np.r_[start, len(at)]), anchor[start]
    end = first + count - 1 + length
    whole = (sums[end] - sums[first]) * p.down[first]
    digest = mix(whole ^ mix((count.astype(U) << U(32)) + (a - first).astype(U)))
    return h[a].view(np.int64), digest.view(np.int64), first, count, a - first


def _bytes(scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), np.uint8) if scalar.is_valid else np.empty(0, np.uint8)


def anchors(length: int, gram: int):
    size = (1 << CHUNK_BITS) - 1

    def run(batches):
        p = Powers(1 << CHUNK_BITS)

        def close(parts):
            x = np.concatenate([b for _, b, _ in parts])
            ends = np.cumsum([len(b) for _, b, _ in parts])
            starts = ends - [len(b) for _, b, _ in parts]
            ok = np.ones(len(x), bool)
            for e in ends:
                ok[max(0, e - length + 1) : e] = False
            found = pieces_of(x, ok, p, length, gram)
            if found:
                h, digest, first, count, off = found
                which = np.searchsorted(ends, first, side="right")
                doc = np.array([d for d, _, _ in parts], np.int64)[which]
                lo = first - starts[which] + np.array([o for _, _, o in parts], np.int64)[which]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (h, digest, doc, lo, count.astype(np.int32), off.astype(np.int32)))), names=["h", "digest", "doc_id", "lo", "n", "off"])

        parts, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = _bytes(text)
                if len(b) < length:
                    continue
                at = 0
                while len(b) - at >= length:  # very long texts in stretches that share length - 1 bytes
                    part = b[at : at + size]
                    if held + len(part) > size:
                        yield from close(parts)
                        parts, held = [], 0
                    parts.append((doc_id, part.copy(), at))
                    held += len(part)
                    at += len(part) - length + 1
        if parts:
            yield from close(parts)

    return run


def suffix_array(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes at least, and each one's place (Larsson-Sadakane).

    Groups of equal prefixes are refined by the places of the suffixes that follow; only groups of
    several suffixes are sorted again, with place, next place and index packed in one word.
    """
    n = len(x)
    assert n < 1 << 21
    padded = np.r_[x, np.zeros(8, np.uint8)].astype(U)
    key = np.zeros(n, U)
    for k in range(5):
        key = (key << U(8)) | padded[k : n + k]
    key = np.sort((key << U(21)) | np.arange(n, dtype=U))
    sa = (key & U((1 << 21) - 1)).astype(np.int64)
    new = np.r_[True, (key[1:] >> U(21)) != (key[:-1] >> U(21))]
    slots = np.arange(n)
    rank = np.zeros(n + depth + 8, np.int64)  # 1 + the first place of the group; 0 past the end
    rank[sa] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
    h = 5
    single = new & np.r_[new[1:], True]
    slots = slots[~single]
    while h < depth and len(slots):
        i = sa[slots]
        first = rank[i]
        key = np.sort((first.astype(U) << U(42)) | (rank[np.minimum(i + h, n + depth)].astype(U) << U(21)) | i.astype(U))
        i = (key & U((1 << 21) - 1)).astype(np.int64)
        sa[slots] = i
        group = key >> U(21)
        new = np.r_[True, group[1:] != group[:-1]]
        rank[i] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        slots = slots[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa, rank[:n]


def common_prefixes(x: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, up to ``cap`` (0 for the first).

    Kasai's rule, that a suffix shares at least one byte less than the suffix one place to its
    left did, run in many stretches of the text side by side and eight bytes at a time.
    """
    n = len(x)
    padded = np.r_[x, np.zeros(cap + 16, np.uint8)]
    word = np.lib.stride_tricks.as_strided(padded, (n + cap + 8, 8), (1, 1)).copy().view("<u8").ravel()
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    out = np.zeros(n, np.int64)
    each = -(-n // lanes)
    i = np.arange(0, n, each)
    stop = np.minimum(i + each, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        most = np.minimum(cap, n - np.maximum(i, j))
        left = (j >= 0) & (h < most)
        diff = word[i + np.where(left, h, 0)] ^ word[np.maximum(j, 0) + np.where(left, h, 0)]
        lowest = diff & (~diff + U(1))
        same = np.where(diff == 0, 8, np.searchsorted(_BYTE_ENDS, lowest, side="right"))
        h = np.where(left, np.minimum(h + same, most), h)
        done = ~left | (diff != 0) | (h >= most)
        out[i[done]] = np.where(before[i[done]] < 0, 0, h[done])
        i = i + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        more = i < stop
        if not more.all():
            i, h, stop = i[more], h[more], stop[more]
    return out[sa]


_BYTE_ENDS = np.array([1 << (8 * k) for k in range(1, 8)], U)


def repeated(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, the number of its class: starts whose next ``length`` bytes are equal share one.

    Kasai's rule needs the full order, so no ties are left.
    """
    sa, _ = suffix_array(x, len(x))
    shared = common_prefixes(x, sa, length)
    of = np.empty(len(x), np.int64)
    of[sa] = np.cumsum(shared < length)
    return of[starts]


MARKS = "doc_id long, lo long, n long, h long, part long, digests array<long>, docs array<long>, los array<long>, known array<boolean>"


def shard_marks(length: int):
    """Rows of marks: runs of windows repeated within the shard (doc_id, lo, n), and for split anchors (h, part) the
    shard's sorted windows, one of each class, cut at fixed digests: blocks for ``merged``."""
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3 + [pa.list_(pa.bool_())]
    names = ["doc_id", "lo", "n", "h", "part", "digests", "docs", "los", "known"]

    def run(batches):
        def close(held):
            x = np.concatenate([b for *_, b in held])
            at = np.cumsum([0] + [len(b) for *_, b in held])[:-1]
            n = np.array([r[3] for r in held])
            piece = np.repeat(np.arange(len(held)), n)
            inside = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            of = repeated(x, at[piece] + inside, length)
            many = np.bincount(of)[of] > 1
            anchor, doc, lo, single, shards = (np.array([r[k] for r in held]) for k in (0, 1, 2, 4, 5))
            hit = np.flatnonzero(many & single[piece])
            if len(hit):  # windows in a row are one mark
                first = np.flatnonzero(np.r_[True, (piece[hit][1:] != piece[hit][:-1]) | (hit[1:] != hit[:-1] + 1)])
                cols = [doc[piece[hit]][first], (lo[piece[hit]] + inside[hit])[first], np.diff(np.r_[first, len(hit)])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols] + [pa.nulls(len(first), t) for t in kinds[3:]], names=names)
            if (shards > 1).any():
                _, one = np.unique(of, return_index=True)
                one = one[shards[piece[one]] > 1]
                digest = np.array([int.from_bytes(hashlib.blake2b(x[s : s + length].tobytes(), digest_size=8).digest(), "little") for s in (at[piece] + inside)[one]], U)
                part = (digest >> U(32)) * shards[piece[one]].astype(U) >> U(32)
                order = np.lexsort((digest, part, anchor[piece[one]]))
                one, digest, part = one[order], digest[order].view(np.int64), part[order].astype(np.int64)
                h = anchor[piece[one]]
                cuts = [*np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]).tolist(), len(one)]
                for a, e in zip(cuts, cuts[1:]):
                    k = one[a:e]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.array([v], t) for v, t in zip((int(h[a]), int(part[a]), digest[a:e], doc[piece[k]], lo[piece[k]] + inside[k], (many | ~single[piece])[k]), kinds[3:])], names=names)

        held, size, last = [], 0, None
        for batch in batches:
            cols = [batch.column(k) for k in ("h", "salt", "doc_id", "lo", "n", "single", "shards", "bytes")]
            for h, salt, doc, lo, n, single, shards, b in zip(*(c.to_pylist() for c in cols[:-1]), cols[-1]):
                b = _bytes(b)
                # a group of one shard fits into the second half; those of several are merged, so they may be cut anywhere
                if held and ((h, salt) != last and size > SHARD_BYTES - GROUP_BYTES or shards > 1 and size + len(b) > SHARD_BYTES):
                    yield from close(held)
                    held, size = [], 0
                last = (h, salt)
                held.append((h, doc, lo, n, single, shards, b.copy()))
                size += len(b)
        if held:
            yield from close(held)

    return run


def merged(key, table):
    """Windows of one part of a split anchor that a binary search in all its shards' sorted blocks finds more than once."""
    digest, doc, lo, known = (np.concatenate([np.asarray(v.values) for v in table[c]]) for c in ("digests", "docs", "los", "known"))
    order = np.sort(digest)
    found = np.searchsorted(order, digest, side="right") - np.searchsorted(order, digest, side="left")
    k = np.flatnonzero((found > 1) & ~known.astype(bool))
    return pa.table({"doc_id": pa.array(doc[k]), "lo": pa.array(lo[k]), "n": pa.array(np.ones(len(k), np.int32))})


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, lo, n): runs of n windows, from byte lo on, that start anywhere else too."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    mark = "doc_id long, lo long, n int"
    all_pieces = materialize(text.mapInArrow(anchors(length, gram), "h long, digest long, doc_id long, lo long, n int, off int"), "pieces")
    often = all_pieces.groupBy("h").agg(F.count("*").alias("k"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("k > 1")
    often = materialize(often.select("h", "k", (F.col("d0") == F.col("d1")).alias("same")), "anchors")
    found = materialize(split_join(all_pieces, often, ["h"], all_pieces.count()).drop("k"), "found")
    whole = found.where("same").select("doc_id", "lo", "n")
    mixed = found.where("not same")
    kinds = mixed.groupBy("h", "digest").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "lo", "n")).alias("one"))
    kinds = materialize(kinds, "kinds")
    copies = split_join(mixed, kinds.where("k > 1").select("h", "digest", "k"), ["h", "digest"], found.count()).select("doc_id", "lo", "n")
    crowd = kinds.groupBy("h").agg(F.sum(F.col("one.n") + (length - 1)).alias("bytes")).where(F.col("bytes") > GROUP_BYTES)
    crowd = materialize(crowd.select("h", F.ceil(F.col("bytes") / GROUP_BYTES).cast("long").alias("shards")), "crowds")
    kinds = kinds.join(crowd, "h", "left").withColumn("shards", F.coalesce("shards", F.lit(1).cast("long")))
    kinds = kinds.select("h", F.pmod("digest", "shards").alias("salt"), "one.doc_id", "one.lo", "one.n", (F.col("k") == 1).alias("single"), "shards")
    wanted = kinds.groupBy("doc_id").agg(F.collect_list(F.struct("h", "salt", "lo", "n", "single", "shards")).alias("p"))  # at most a document's own pieces
    wanted = materialize(wanted, "wanted")

    def slices(batches):
        for batch in batches:
            for doc, text, ps in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                b = bytes(text.as_buffer())
                ps = ps.as_py()
                yield pa.RecordBatch.from_pydict({
                    "h": [p["h"] for p in ps], "salt": [p["salt"] for p in ps], "doc_id": [doc] * len(ps), "lo": [p["lo"] for p in ps], "n": pa.array([p["n"] for p in ps], pa.int32()),
                    "single": [p["single"] for p in ps], "shards": [p["shards"] for p in ps], "bytes": pa.array([b[p["lo"] : p["lo"] + p["n"] - 1 + length] for p in ps], pa.binary())})

    dealt = text.join(wanted, "doc_id").mapInArrow(slices, "h long, salt long, doc_id long, lo long, n int, single boolean, shards long, bytes binary")
    dealt = dealt.repartition("h", "salt").sortWithinPartitions("h", "salt")
    sharded = materialize(dealt.mapInArrow(shard_marks(length), MARKS), "shards")
    near = sharded.where("h is null").select("doc_id", "lo", F.col("n").cast("int"))
    marks = whole.unionByName(copies).unionByName(near)
    if not crowd.isEmpty():
        blocks = sharded.where("h is not null").select("h", "part", "digests", "docs", "los", "known")
        marks = marks.unionByName(blocks.groupBy("h", "part").applyInArrow(merged, mark))
    return marks


@tidy
def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes), repeated (n_removed > 0).

    Null text counts as empty; texts shorter than ``length`` bytes keep all. Every copy loses its
    repeated bytes, so an exact copy of enough bytes keeps none. Rows of one doc_id are one document
    that holds each text; a null doc_id is neither compared nor cut. Other columns are ignored; an
    empty table gives no rows.
    """
    marks = repeated_windows(docs, length, gram).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))  # at most a document's own pieces
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(materialize(marks, "marks", keep=True), "doc_id", "left")

    def cut(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for text, marks in zip(batch.column(1), batch.column(2)):
                b, spans = _bytes(text), np.empty((0, 2), np.int64)
                if marks.is_valid and len(marks):
                    m = marks.values
                    lo = np.asarray(m.field("lo")).astype(np.int64)
                    end = lo + np.asarray(m.field("n")) - 1 + length
                    order = np.argsort(lo, kind="stable")
                    lo, end = lo[order], np.maximum.accumulate(end[order])
                    new = np.r_[True, lo[1:] > end[:-1]]
                    spans = np.stack([lo[new], end[np.r_[new[1:], True]]], 1)
                digest, at = hashlib.sha256(), 0
                for s, e in spans.tolist():
                    digest.update(b[at:s])
                    at = e
                digest.update(b[at:])
                for c, v in zip(out, (len(b), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest(), [{"start": s, "end": e} for s, e in spans.tolist()])):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return text.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>").withColumn("repeated", F.col("n_removed") > 0)

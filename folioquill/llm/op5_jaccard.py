"""N-gram Jaccard join on parity sketches.

A document is its set of five-word shingles. Every shingle flips one bit of a wide sketch, so two
sketches differ in at most as many bits as the sets differ in shingles. The sketch is cut into
segments; sets of sizes n and m with a similarity of at least 0.8 differ in at most (n + m) / 9
shingles, so all but so many segments agree. Each segment is held as the XOR of its shingles'
hashes. Segments are taken by falling number of shingles, which is a property of their content:
the first D + 1 of two linked documents must then share one (pigeonhole). Those are joined per
size band, and pairs that meet from different components are verified on the whole sets.

Pairs are not multiplied out. Equal sets are one class; in a group that shares a segment each
member is first checked against one pivot. Members that are then still in different components
are compared inside a task by the Hamming distance of their sketches; a first pass over two groups of
each class sends on one spanning forest of the pairs that may be linked, a second pass over all
groups sends on all that are left, so no link is lost.

Only components are made: a pair already in one component is never tested, so there are neither link
counts nor representative pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import components, materialize, tidy

WORDS = 5
BAND = 4  # sizes of a band span this factor
FLUSH = 1_000_000  # keys that a task combines at a time
BROADCAST_IDS = 200_000
CLASS_BITS = 64  # of a class's own fingerprint; tests take fewer
BLOCK = 4096  # members of a group that are compared at once
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


PLACE = mix(np.arange(1, 2 * WORDS + 2, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(xxh64_intdigest, words), U, n)
    if n < WORDS:
        return mix((h * PLACE[:n]).sum(keepdims=True) + PLACE[WORDS + n])
    total = h[: n - WORDS + 1] * PLACE[0]
    for k in range(1, WORDS):
        total = total + h[k : n - WORDS + 1 + k] * PLACE[k]
    return np.unique(mix(total))


def most_apart(n: int, m: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (n + m) // 9


def segment_keys(sh: np.ndarray) -> np.ndarray:
    """The join keys of a set: its fullest sketch segments, in each band where a partner can be."""
    n, out = len(sh), []
    band = 0
    while BAND ** (band + 1) <= n:
        band += 1
    for b in {band, band - 1}:
        low, high = BAND**b if b >= 0 else 0, BAND ** (b + 1) - 1
        if b < 0 or n > high and n > high * 5 // 4:
            continue
        apart = most_apart(n, n * 5 // 4) if n <= high else most_apart(n, high)
        parts = max(low + 1, low * 5 // 4)
        at = (sh >> U(20)) % U(parts)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        folded = np.bitwise_xor.reduceat(sh[order], first)
        count = np.diff(np.r_[first, n])
        tag = mix(np.array([b + 1], U))
        keys = mix(mix(folded + at[first] * U(0xD6E8FEB86659FD93)) + tag)
        if len(keys) <= apart:  # rare: the empty segments count too, those of the lowest places last
            empty = np.setdiff1d(np.arange(parts, dtype=U), at[first])
            keys = np.r_[keys, mix(mix(empty * U(0xD6E8FEB86659FD93)) + tag)]
            count = np.r_[count, np.zeros(len(empty), count.dtype)]
        out.append(keys[np.lexsort((keys, -count))[: apart + 1]])
    return np.concatenate(out)


def parity_sketch(sh: np.ndarray) -> np.ndarray:
    """Bits, in 64-bit words, each the parity of the shingles that fall on it: a power of two of them, at least four to a shingle."""
    bits = 64
    while bits < 4 * len(sh):
        bits *= 2
    odd = np.bincount((sh >> U(3)) & U(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch with as few words: the parity of its parts."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), 0)


def _texts(batches):
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield doc_id, text.as_py()


def class_of(sh: np.ndarray, clash: frozenset = frozenset(), bits: int = 64) -> tuple[int, int]:
    """The class of a set, of ``bits``, and a second fingerprint of 64 bits; a class that different sets fell into is told apart by the second."""
    if not len(sh):
        return 0, 0
    parts = np.array([np.bitwise_xor.reduce(sh), mix(sh ^ U(0x5851F42D4C957F2D)).sum(), len(sh)], U)
    c, d = (int(mix((parts * PLACE[k : k + 3]).sum(keepdims=True)).view(np.int64)[0]) for k in (0, 3))
    c >>= 64 - bits
    return (int(mix(np.array([c ^ d], np.int64).view(U)).view(np.int64)[0]) if c in clash else c), d


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64, copy=False))


def classify(clash: frozenset, bits: int):
    """(doc_id, class, second fingerprint, size) of each text."""
    def run(batches):
        for batch in batches:
            out = [(*class_of(s, clash, bits), len(s)) for s in map(shingles, (t.as_py() for t in batch.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3))], names=["doc_id", "c", "d", "n"])

    return run


def emit_keys(clash: frozenset, bits: int):
    """(key, class, pivot): pivot is null where a key leaves the task; keys that several classes of a task share are
    combined here: all but the smallest class become edges to it, so a hot key leaves a task with one open row."""
    def flush(keys):
        key = np.concatenate([k for k, _ in keys]).view(np.int64)
        cls = np.repeat(np.array([c for _, c in keys], np.int64), [len(k) for k, _ in keys])
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        first = np.r_[True, key[1:] != key[:-1]]
        pivot = cls[first][np.cumsum(first) - 1]
        keep = first | (cls != pivot)
        return pa.RecordBatch.from_arrays([_signed(key[keep]), _signed(cls[keep]), pa.array(pivot[keep], mask=first[keep])], names=["key", "c", "pivot"])

    def run(batches):
        keys, seen, held = [], set(), 0
        for _, text in _texts(batches):
            sh = shingles(text)
            c, _ = class_of(sh, clash, bits)
            if len(sh) and c not in seen:
                seen.add(c)
                keys.append((segment_keys(sh), c))
                held += len(keys[-1][0])
            if held > FLUSH or len(seen) > 50_000:
                yield flush(keys)
                keys, seen, held = [], set(), 0
        if keys:
            yield flush(keys)

    return run


def may_link(everything: bool):
    """Pairs (a, b) of classes in different components whose sketches are near enough, from rows sorted by group.

    Rows: key, i, j, mine, c, comp, n, sketch. Without ``everything`` only a forest that joins the components.
    """
    def run(batches):
        sent = set()

        def compare(rows, i, j):
            side = np.array([r[0] for r in rows])
            c, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            sketch = [np.frombuffer(r[4], U) for r in rows]
            words = np.array([len(x) for x in sketch])
            tables = {w: np.stack([folded(x, w) if len(x) >= w else np.zeros(w, U) for x in sketch]) for w in np.unique(words)}
            label = np.unique(comp, return_inverse=True)[1]
            left = np.flatnonzero(side == i)
            for x in left:
                y = np.flatnonzero((side == j) & (label != label[x]) & (5 * n >= 4 * n[x]) & (4 * n <= 5 * n[x]))
                y = y[y > x] if i == j else y
                for w in np.unique(np.minimum(words[y], words[x])):
                    z = y[np.minimum(words[y], words[x]) == w]
                    apart = np.bitwise_count(tables[w][z] ^ tables[w][x]).sum(1)
                    z = z[9 * apart.astype(np.int64) <= n[z] + n[x]]
                    while len(z):
                        pair = (min(c[x], c[z[0]]), max(c[x], c[z[0]]))
                        if pair not in sent:
                            sent.add(pair)
                            out.append(pair)
                        if everything:
                            z = z[1:]
                        else:
                            label[label == label[z[0]]] = label[x]
                            z = z[label[z] != label[x]]

        out, held, key = [], [], None
        take = lambda: pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("key", "i", "j", "mine", "c", "comp", "n", "sketch"))):
                if row[:3] != key:
                    if len(held) > 1:
                        compare(held, *key[1:])
                    held, key = [], row[:3]
                    if len(out) > 50_000:
                        yield take()
                        out.clear()
                        sent.clear()
                held.append(row[3:])
        if len(held) > 1:
            compare(held, *key[1:])
        yield take()

    return run


def sets(clash: frozenset, bits: int):
    """(class, size, sketch, set) of each text."""
    def make(out):
        cols = [pa.array([c for c, _ in out], pa.int64()), pa.array([len(s) for _, s in out], pa.int64()), pa.array([parity_sketch(s).tobytes() for _, s in out], pa.binary()), pa.array([s.view(np.int64) for _, s in out], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["c", "n", "sketch", "s"])

    def run(batches):
        out, size = [], 0
        for _, text in _texts(batches):
            sh = shingles(text)
            out.append((class_of(sh, clash, bits)[0], sh))
            size += len(sh)
            if size > 500_000:
                yield make(out)
                out, size = [], 0
        if out:
            yield make(out)

    return run


@tidy
def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Words are runs without ASCII white space, A-Z lower-cased. Null, empty or blank texts have an
    empty set and link with nothing; equal sets are linked. doc_id must be unique; other columns
    are ignored; an empty table gives no rows.
    """
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, clash = materialize(text.mapInArrow(classify(frozenset(), CLASS_BITS), "doc_id long, c long, d long, n long"), "classes", keep=True), frozenset()
    prints = materialize(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.min("d").alias("d0"), F.max("d").alias("d1")), "prints")
    mixed = prints.where("d0 <> d1").select("c")
    if not mixed.isEmpty():  # different sets under one 64-bit class: a chance of one in 2^64 for a pair
        clash = frozenset(r["c"] for r in mixed.collect())
        rows = materialize(text.mapInArrow(classify(clash, CLASS_BITS), "doc_id long, c long, d long, n long"), "classes", keep=True)
        prints = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"))
    met = text.mapInArrow(emit_keys(clash, CLASS_BITS), "key long, c long, pivot long")
    # a key's open rows, one of a task, meet; those with a pivot are edges already and stand alone
    apart = W.partitionBy("key", F.when(F.col("pivot").isNotNull(), F.col("c")))
    met = met.withColumn("least", F.min("c").over(apart))
    star = met.where("pivot is not null or c > least").select("key", F.coalesce("pivot", "least").alias("pivot"), "c")
    star = materialize(star, "stars")

    classes = materialize(prints.select("c", "rep"), "representatives")
    members = materialize(star.select("key", "c").unionByName(star.select("key", F.col("pivot").alias("c"))).distinct(), "members")
    live = materialize(members.select("c").distinct().join(classes, "c"), "live")
    ids, n_live = live.select(F.col("rep").alias("doc_id")), live.count()
    chosen = text.join(F.broadcast(ids) if n_live <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    whole = materialize(chosen.mapInArrow(sets(clash, CLASS_BITS), "c long, n long, sketch binary, s array<long>"), "sets")

    def linked(pairs):
        a, b = whole.select(F.col("c").alias("a"), F.col("s").alias("sa")), whole.select(F.col("c").alias("b"), F.col("s").alias("sb"))
        y = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
        return materialize(y.where(100 * F.col("both") >= 80 * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b"), "links")

    pairs = star.select(F.least("pivot", "c").alias("a"), F.greatest("pivot", "c").alias("b")).distinct()
    size = whole.select("c", "n")
    pairs = pairs.join(size.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    tried = materialize(pairs.where("5 * na >= 4 * nb and 5 * nb >= 4 * na").select("a", "b"), "tried")
    links = linked(tried)
    label = components(links)
    for everything in (False, True):
        # members whose group still holds several components
        at = materialize(members.join(label.withColumnRenamed("node", "c"), "c", "left").select("key", "c", F.coalesce("component", "c").alias("comp")), "labelled")
        mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        x = at.join(materialize(mixed, "mixed"), "key")
        if not everything:  # two groups of each class find most of what is linked: near copies share their least and greatest keys
            x = x.withColumn("lo", F.min("key").over(W.partitionBy("c"))).withColumn("hi", F.max("key").over(W.partitionBy("c"))).where("key = lo or key = hi")
        x = x.join(whole.select("c", "n", "sketch"), "c")
        x = x.withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        x = x.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "c", "comp", "n", "sketch")
        x = x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "mine", "c")
        new = materialize(x.mapInArrow(may_link(everything), "a long, b long"), "near").distinct()
        new = materialize(new.join(tried, ["a", "b"], "left_anti"), "new")
        if new.isEmpty():
            continue
        links = links.unionByName(linked(new))
        tried = tried.unionByName(new)
        label = components(links)
    named = classes.join(label.withColumnRenamed("node", "c"), "c", "left").select("c", "rep", F.coalesce("component", "c").alias("comp"))
    named = materialize(named, "named")
    smallest = materialize(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "smallest")
    named = materialize(named.join(smallest, "comp").select("c", "component_id"), "named", keep=True)
    y = rows.join(named, "c", "left")
    y = y.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return y.withColumn("kept", F.col("doc_id") == F.col("component_id"))

"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors fall into buckets of quantised Gaussian projections, in several tables; the
vectors of a bucket are compared exactly, in blocks, in double precision. A pair counts in the
first table where it meets, so links are counted without writing pairs down; a bucket with the
members of an earlier one is not compared again. Equal vectors of a label are one row with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, materialize, tidy

COSINE, TABLES, PROJECTIONS, WIDTH, BLOCK = 0.98, 40, 8, 1.0, 512
#: Vectors that the tables and projections above are for. Each RANDOM_MATES-fold more take one projection more, so that a
#: bucket holds as many unlike vectors as before, and as many tables more as keep the recall.
VECTORS, RANDOM_MATES = 100_000, 3.7


def bucket_chance(cosine: float, width: float) -> float:
    """The chance that one projection puts two vectors of this cosine into one slot."""
    c = width / math.sqrt(2 - 2 * cosine)
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def shape(n: int, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> tuple[int, int]:
    """Tables and projections for n vectors: the chance to miss a pair at the threshold stays that of the given ones."""
    more = max(0, math.ceil(math.log(max(n, 1) / VECTORS) / math.log(RANDOM_MATES)))
    p = bucket_chance(cosine, width)
    miss = tables * math.log1p(-(p**projections))
    return (math.ceil(miss / math.log1p(-(p ** (projections + more)))) if more else tables), projections + more


def unit_rows(batch) -> np.ndarray:
    """Float64 rows of an embedding column, normalised."""
    col = batch.column(1)
    return normalised(np.asarray(col.flatten(), np.float64).reshape(len(col), -1))


def normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hasher(dim: int, tables: int, projections: int, width: float, seed: int = 7):
    """Bucket codes (rows x tables, int64) of normalised rows."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)
    fold = rng.integers(1, 2**62, (tables, projections), np.int64) | 1

    def codes(x: np.ndarray) -> np.ndarray:
        q = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, projections)
        with np.errstate(over="ignore"):
            return (q * fold).sum(2)

    return codes


@tidy
def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and equal length are compared. Null or zero vectors and those with null or
    non-finite components link with nothing. Recall is that of the hashing: with the defaults a
    pair at the threshold is missed with a chance of about e-5, nearer ones less; ``tables`` and
    ``projections`` are those for up to VECTORS vectors and grow beyond (``shape``). Rows of one
    vec_id are vectors of their own that share a name; a null vec_id names nothing. Other columns are
    ignored; an empty table gives no rows.
    """
    base = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").alias("v"))
    wide = F.transform("v", lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & ~bad & F.exists(wide, lambda x: x != 0), F.lit(False))
    base = materialize(base.withColumn("c", F.when(good, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform(wide, lambda x: (x + F.lit(0.0)).cast("string")), ",")), 256))), "vectors", keep=True)
    ids = base.select("vec_id", "c")
    groups = materialize(base.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = base.join(groups.select("c", F.col("rep").alias("vec_id"), "n"), ["c", "vec_id"]).dropDuplicates(["c"]).select(F.col("vec_id").alias("id"), "v", F.xxhash64(F.col("label").cast("string"), F.size("v")).alias("label"), "n")
    reps = materialize(reps, "representatives")
    tables, projections = shape(reps.count(), cosine, tables, projections, width)

    def hashed(batches):
        known = {}
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                code = known.setdefault(dim, hasher(int(dim), tables, projections, width))(unit_rows(part))
                code = code ^ (np.asarray(part.column(2)) * 0x5851F42D)[:, None]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), tables).cast(pa.list_(pa.int64()))], names=["id", "codes"])

    codes = materialize(reps.select("id", "v", "label").mapInArrow(hashed, "id long, codes array<long>"), "codes")
    spots = materialize(codes.select("id", F.posexplode("codes").alias("t", "code")), "spots")
    full = spots.groupBy("t", "code").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y")).where("m > 1")
    full = full.groupBy("m", "x", "y").agg(F.min(F.struct("t", "code")).alias("b")).select("b.t", "b.code", "m")  # one bucket for each set of members, the earliest
    full = materialize(full, "buckets")
    # a bucket is cut into blocks of about BLOCK vectors; every two blocks of it meet in one task
    met = spots.join(full, ["t", "code"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("id", "t", "code", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    # the codes that a vector carries tell in which tables a pair met before: 32 bits of each, a false match of which costs less recall than the hashing
    points = reps.join(codes.select("id", F.transform("codes", lambda c: F.shiftright(c, 32).cast("int")).alias("codes")), "id")
    met = met.join(points, "id")
    met = met.repartition("t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j", "mine", "id")

    def compare(batches):
        held, key = [], None

        def close():
            if len(held) > 1:
                yield from block_links(held, key, cosine)

        for batch in batches:
            cols = batch.to_pydict()
            for row in zip(*(cols[k] for k in ("t", "code", "i", "j", "mine", "id", "label", "n", "v", "codes"))):
                if row[:4] != key:
                    yield from close()
                    held, key = [], row[:4]
                held.append(row[4:])
        yield from close()

    found = materialize(met.mapInArrow(compare, "id long, links long, to long"), "found")
    counts = found.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = groups.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named", keep=True)
    y = ids.join(named, "c", "left")
    y = y.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return y.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def block_links(held: list, key: tuple, cosine: float):
    """Rows (id, links, null) and (id, null, other id) of one pair of blocks; the latter span its components."""
    t, _, i, j = key
    block = np.array([h[0] for h in held])
    ids, labels, n = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
    try:
        v = normalised(np.array([h[4] for h in held], np.float64))
        codes = np.array([h[5] for h in held], np.int64)
    except ValueError:  # vectors of several lengths met by chance: their labels differ, so split them
        for size in {len(h[4]) for h in held}:
            yield from block_links([h for h in held if len(h[4]) == size], key, cosine)
        return
    a = np.flatnonzero(block == i)
    b = a if i == j else np.flatnonzero(block == j)
    links, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for x in a:
        other = b[b > x] if i == j else b
        other = other[labels[other] == labels[x]]
        other = other[v[other] @ v[x] >= cosine]
        if len(other):
            other = other[~(codes[other, :t] == codes[x, :t]).any(1)]
        if len(other):
            links[x] += n[other].sum()
            links[other] += n[x]
            for o in other.tolist():
                p, q = top(int(x)), top(o)
                if p != q:
                    root[q] = p
                    edges.append((int(ids[x]), int(ids[o])))
    some = np.flatnonzero(links)
    if len(some):
        left, right = zip(*edges)
        yield pa.RecordBatch.from_arrays([
            pa.array([*ids[some].tolist(), *left], pa.int64()), pa.array([*links[some].tolist(), *[None] * len(left)], pa.int64()), pa.array([*[None] * len(some), *right], pa.int64())],
            names=["id", "links", "to"])

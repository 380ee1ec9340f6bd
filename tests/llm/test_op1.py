import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from folioquill.llm import common, op1_suffix
from folioquill.llm.op1_suffix import common_prefixes, remove_repeated, repeated, suffix_array

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, length):
    texts = {i: (t or "").encode() for i, t, _ in rows}
    seen = Counter(b[k : k + length] for b in texts.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in texts.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[False, gone]) & gone).sum()), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.integers(20, 200)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng.integers(0, 80))]
        for s in rng.choice(len(shared), rng.integers(0, 3)):
            t = shared[s]
            a = int(rng.integers(0, 30))
            t = t[a:]
            if rng.random() < 0.4:
                k = int(rng.integers(0, len(t)))
                t = t[:k] + "#" + t[k + 1 :]
            parts += [t, prose(rng.integers(0, 60))]
        rows.append((i, " ".join(parts), "x"))
    rows += [(100, None, None), (101, "", "x"), (102, "a" * 1000, "x"), (103, "ab" * 500, "x"), (104, rows[3][1], "x"), (105, rows[3][1], "x"), (106, "short", "x")]
    return rows


@pytest.mark.parametrize(("seed", "shard", "hot"), [(1, 1_500_000, 2000), (2, 3000, 5), (3, 10_000, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, shard, hot):
    monkeypatch.setattr(op1_suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(op1_suffix, "GROUP_BYTES", shard // 2)
    monkeypatch.setattr(common, "HOT", hot)
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 400)


def test_empty(spark):
    assert remove_repeated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(5)
    for text in (bytes(rng.integers(97, 99, 500).tolist()), b"a" * 300, b"abc" * 100 + b"abd", bytes(rng.integers(1, 256, 1000).tolist())):
        x = np.frombuffer(text, np.uint8)
        sa, _ = suffix_array(x, len(x) + 1)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == want
        lcp = [0]
        for a, b in zip(want, want[1:]):
            k = 0
            while k < 400 and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            lcp.append(k)
        assert common_prefixes(x, sa, 400, 7).tolist() == lcp


@pytest.mark.parametrize("seed", range(40))
def test_pieces_that_share_more_than_the_length(seed):
    rng = np.random.default_rng(seed)
    base = bytes(rng.integers(97, 123, 736).tolist())
    pieces = []
    for k in rng.integers(640, 736, 8).tolist():
        tail = bytearray(base)
        tail[k:] = rng.integers(97, 123, 736 - k).tolist()
        pieces.append(bytes(tail))
    text = b"".join(pieces) + bytes(rng.integers(97, 123, 3000).tolist())
    starts = np.arange(len(text) - 400 + 1)
    got = repeated(np.frombuffer(text, np.uint8), starts, 400)
    many = Counter(text[k : k + 400] for k in starts.tolist())
    assert (np.bincount(got)[got] > 1).tolist() == [many[text[k : k + 400]] > 1 for k in starts.tolist()]


def test_shards_stay_below_the_suffix_limit():
    rng = np.random.default_rng(9)

    def rows(h, salt, count, shards):
        return [(h, salt, h * 10_000 + k, 0, 337, True, shards, rng.bytes(736)) for k in range(count)]

    both = rows(1, 0, 1010, 1) + rows(2, 0, 1019, 3) + rows(2, 1, 3000, 3) + rows(3, 0, 1000, 1)
    names = ["h", "salt", "doc_id", "lo", "n", "single", "shards", "bytes"]
    batches = [pa.table(dict(zip(names, map(list, zip(*both[k : k + 700]))))).to_batches()[0] for k in range(0, len(both), 700)]
    out = [b for b in op1_suffix.shard_marks(400)(iter(batches))]
    assert sum(len(d) for b in out for d in b.column(5).to_pylist() if d) == 337 * 4019 and all(b.column(0).null_count for b in out)


def test_whole_table_matches_window_hashes(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(path).collect()]
    digests = [[xxhash.xxh3_128_intdigest(b[k : k + 400]) for k in range(len(b) - 399)] for _, b in rows]
    seen = Counter(d for ds in digests for d in ds)
    got = {r["doc_id"]: r for r in remove_repeated(spark.read.parquet(path)).collect()}
    for (i, b), ds in zip(rows, digests):
        mark = np.zeros(len(b) + 1, np.int64)
        for k, d in enumerate(ds):
            if seen[d] > 1:
                mark[k] += 1
                mark[k + 400] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"], got[i]["repeated"]) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest(), bool(gone.any()))


def test_null_and_repeated_ids_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op1_suffix, "CHUNK_BITS", 12)
    rng = np.random.default_rng(11)
    long = "".join(rng.choice(list("abcdefgh "), 30_000))
    rows = [(1, long, "x"), (2, long[10_000:15_000] + "z" * 500, "x"), (3, "q" * 2500, "x")]
    df = spark.createDataFrame(rows + [(None, long, "x")], SCHEMA)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeated(df).collect()}
    assert got.pop(None)[1] == 0 and got == brute(rows, 400)
    twice = remove_repeated(spark.createDataFrame([(7, long[:900], "x"), (7, long[:900], "y")], SCHEMA)).collect()
    assert [(r["doc_id"], r["n_removed"]) for r in twice] == [(7, 900)] * 2

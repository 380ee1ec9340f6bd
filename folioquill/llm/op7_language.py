"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of three and four bytes of the whole text, A-Z lower-cased and other ASCII
non-letters blank. The embeddings and the softmax are trained with stochastic gradient descent in
numpy on a bounded sample of labelled rows; the score is calibrated by a temperature and the
rejection threshold by a quantile, both on rows of the sample kept out of training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKETS, DIM, EPOCHS, RATE = 1 << 15, 16, 6, 25.0
#: The most labelled rows that training reads: those with the lowest hashes of doc_id.
SAMPLE = 4000
#: Share of the correctly told validation rows that the rejection threshold may turn away.
REJECT = 0.001
CHUNK, ROWS = 4_000_000, 1000
BLANK = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in bytes(range(256)).lower()], np.uint8)


def subwords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of a cleaned byte array, and where it starts."""
    y = x.astype(np.uint32)
    three = (y[:-2] << np.uint32(16)) | (y[1:-1] << np.uint32(8)) | y[2:]
    four = (three[:-1] << np.uint32(8)) | y[3:]
    a = np.flatnonzero(x[1:-1] != 32)
    b = np.flatnonzero((x[1:-2] != 32) & (x[2:-1] != 32))
    shift = np.uint32(32 - 15)
    h3 = (three[a] * np.uint32(0x9E3779B1)) >> shift
    h4 = ((four[b] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)) >> shift
    return np.concatenate([h3, h4]), np.concatenate([a, b])


def cleaned(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one cleaned byte array, blanks between them, and where each starts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    x = np.frombuffer(b" " + b"  ".join(raw) + b"   ", np.uint8)
    return BLANK[x], np.cumsum([0] + [len(r) + 2 for r in raw])[:-1]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Weights of every bucket for every language, the bias, the temperature and the rejection threshold."""

    def __init__(self, langs, weights, bias, temperature=1.0, threshold=0.0):
        self.langs, self.weights, self.bias, self.temperature, self.threshold = langs, weights, bias, temperature, threshold

    def logits(self, texts: list[str]) -> np.ndarray:
        x, start = cleaned(texts)
        h, at = subwords(x)
        doc = np.searchsorted(start, at, side="right") - 1
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        total = np.stack([np.bincount(doc, self.weights[h, k], len(texts)) for k in range(len(self.langs))], 1)
        return total / n[:, None] + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = RATE, reject: float = REJECT, seed: int = 3) -> Model:
    """Train on four of five texts, calibrate on the fifth. Needs one text at least."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    table, out, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    out[:] = rng.normal(0, 0.1, out.shape)
    bags = []
    for t in texts:
        h, _ = subwords(cleaned([t])[0])
        bags.append(np.unique(h, return_counts=True))
    train = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            h, c = bags[i]
            if len(h):
                w = c / c.sum()
                v = w @ table[h]
                g = softmax((v @ out + bias)[None])[0]
                g[y[i]] -= 1
                step = rate * (1 - done / steps)
                back = out @ g
                out -= 0.02 * step * np.outer(v, g)
                bias -= 0.001 * step * g
                table[h] -= step * w[:, None] * back
            done += 1
    model = Model(langs, (table @ out).astype(np.float32), bias)
    kept = np.setdiff1d(np.arange(len(y)), train)
    if len(kept):
        z = np.concatenate([model.logits([texts[i]]) for i in kept])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(kept)), y[kept]] + 1e-12).mean()
        model.temperature = min(np.geomspace(1, 20, 40), key=loss)
        p = softmax(z / model.temperature)
        right = p.argmax(1) == y[kept]
        if right.any():
            model.threshold = float(min(0.5, np.quantile(p.max(1)[right], reject)))
    return model


def held_out(doc_id):
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; None if there are none with letters."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = rows.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("doc_id", "text", "lang").toArrow().to_pylist()  # at most `sample` rows
    found = sorted((r for r in found if has_letter(r["text"])), key=lambda r: (r["doc_id"] or 0, r["text"], r["lang"]))[:sample]
    return fit([r["text"] for r in found], [r["lang"] for r in found]) if found else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` with _lang, _score and _rejected.

    ``und`` with score 0, rejected, where text is null or has no letter, and everywhere if nothing
    could be learned; else the likeliest language and its calibrated probability, rejected below
    the model's threshold. Only text is read. Extra columns pass through; those with a name of the
    three new ones give way. Rows are told one by one, whatever their doc_id. An empty table gives no rows.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("_lang", "_score", "_rejected")])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _lang string, _score double, _rejected boolean"

    def tell(batches):
        model = sent.value
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = [t.as_py() for t in batch.column(names.index("text"))]
            lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            some = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            at = 0
            while at < len(some):
                end, size = at, 0
                while end < len(some) and (end == at or size + len(texts[some[end]]) < CHUNK // (8 + len(model.langs))):
                    size += len(texts[some[end]])
                    end += 1
                best, p = model.predict([texts[i] for i in some[at:end]])
                for i, b, s in zip(some[at:end], best.tolist(), p.tolist()):
                    lang[i], score[i], rejected[i] = model.langs[b], s, s < model.threshold
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "_lang", "_score", "_rejected"])

    return docs.mapInArrow(tell, schema)


def predict_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected. See ``identify``."""
    x = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), learn(docs, sample))
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))

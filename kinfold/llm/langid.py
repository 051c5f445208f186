"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are its 3- to 5-byte runs of letters, with the gaps between words as letters at their ends. A
held-back part of the training rows calibrates a temperature and the score below which a prediction is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._learn import held_out, sample_classes
from kinfold.llm._text import chunks, texts_as_bytes, word_table
from kinfold.plans.runtime import table

BUCKET_BITS, ORDERS, DIM = 15, (3, 4, 5), 12
#: Bound of the training sample, in rows of each language; every row outside it is only predicted.
PER_LANGUAGE = 800
EPOCHS, RATE, SEED = 12, 10.0, 7
UNKNOWN = "und"

_LETTER = word_table()
_LETTER[0x30:0x3A] = 0
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def subwords(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the buckets of all subwords in order, and where those of each text begin (one more entry than texts)."""
    joined = b"\0" + b"\0".join(texts) + b"\0"
    c = _LETTER[np.frombuffer(joined, np.uint8)]
    inner = c != 0
    wide = c.astype(np.uint32)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=ends[1:])
    found = []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            found.append((np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)))
            continue
        ok = inner[1 : 1 + m].copy()
        for j in range(2, n - 1):
            ok &= inner[j : j + m]
        h = np.full(m, n * 0x51ED270B & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h ^= wide[j : j + m]
            h *= np.uint32(_MULTIPLIERS[j])
        h = h[ok]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        before = np.concatenate([[0], np.cumsum(ok)])
        found.append((h >> np.uint32(32 - BUCKET_BITS), before[np.minimum(ends, m)]))
    return found


def has_letter(raw: bytes) -> bool:
    if any(65 <= b <= 90 or 97 <= b <= 122 for b in raw[:64]):
        return True
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def _bags(df: DataFrame, label: str, text: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) of each text: at most 2**BUCKET_BITS numbers, however long the text is."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw in texts_as_bytes(batch.column(1)):
                b = np.concatenate([x for x, _ in subwords([raw])]).astype(np.int64)
                n = np.bincount(b, minlength=1)
                at = np.flatnonzero(n)
                rows.append((at.astype(np.uint16).tobytes(), (n[at] / max(1, len(b))).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "at", "share"])

    rows = df.select(F.col(label).cast("string"), text).mapInArrow(run, "label string, at binary, share binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    return [(r[0], np.frombuffer(r[1], np.uint16).astype(np.int64), np.frombuffer(r[2], np.float32)) for r in rows]


def train(bags: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> dict:
    """Model with the bucket scores (embeddings times output weights), temperature and rejection score."""
    rng = np.random.default_rng(seed)
    langs = sorted({b[0] for b in bags})
    if not langs:
        return {"langs": [], "scores": np.zeros((1 << BUCKET_BITS, 0), np.float32), "temperature": 1.0, "reject": 1.0}
    index = {x: i for i, x in enumerate(langs)}
    usable = [(index[y], at, w) for y, at, w in bags if len(at)]
    order = rng.permutation(len(usable))
    cut = len(usable) - len(usable) // 5
    fit, held = [usable[i] for i in order[:cut]], [usable[i] for i in order[cut:]] or usable
    emb = (rng.uniform(-1, 1, (1 << BUCKET_BITS, DIM)) / DIM).astype(np.float32)
    out = np.zeros((DIM, len(langs)))
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            y, at, w = fit[i]
            lr = rate * (1 - done / steps)
            done += 1
            own = emb.take(at, 0)
            mean = w @ own
            z = mean @ out
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = out @ g
            out -= lr * 0.25 * np.outer(mean, g)
            own -= np.outer(w, (lr * back).astype(np.float32))
            emb[at] = own
    scores = emb @ out
    z = np.array([w @ scores[at] for _, at, w in held]) if held else np.zeros((0, len(langs)))
    y = np.array([h[0] for h in held])

    def probability(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    best = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(probability(t)[np.arange(len(y)), y] + 1e-12).mean()) if len(y) else 1.0
    reject = 0.0
    if len(y):
        p = probability(best)
        top, right = p.max(1), p.argmax(1) == y
        by = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(y) + 1) >= 0.99)
        reject = float(top[by][good[-1]]) if len(good) else 1.0
    return {"langs": langs, "scores": scores.astype(np.float32), "temperature": float(best), "reject": reject}


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> dict:
    """Learn from at most about ``per_language`` rows of each language with a non-null label and text.

    Every language of the labels is learned, however rare; all of them together bound the sample that comes to the driver.
    """
    rows, _ = sample_classes(df.where(F.col(text).isNotNull()), label, key, per_language)
    return train(_bags(rows, label, text))


def predict(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: (key, *carry, lang_pred, score, accepted).

    ``score`` is the calibrated probability of ``lang_pred``. Null texts and texts without a letter are ``und`` with
    score 0 and not accepted, and so is all if nothing was learned. Repeated and null keys keep their rows.
    """
    langs, temperature, reject = model["langs"], model["temperature"], model["reject"]
    by_lang = np.ascontiguousarray(model["scores"].T.astype(np.float64))

    def run(batches):
        for batch in batches:
            texts = texts_as_bytes(batch.column(batch.num_columns - 1))
            names, values = [], []
            for a, b in chunks(texts):
                part = texts[a:b]
                n, z = np.zeros(len(part), np.int64), np.zeros((len(part), len(langs)))
                for bucket, first in subwords(part):
                    own = np.diff(first)
                    n += own
                    full = own > 0
                    if full.any():
                        for k in range(len(langs)):
                            z[full, k] += np.add.reduceat(by_lang[k][bucket], first[:-1][full])
                for i, raw in enumerate(part):
                    if not langs or not has_letter(raw):
                        names.append(UNKNOWN)
                        values.append(0.0)
                        continue
                    x = z[i] / max(1, n[i]) / temperature
                    e = np.exp(x - x.max())
                    k = int(e.argmax())
                    names.append(langs[k])
                    values.append(float(e[k] / e.sum()))
            score = np.array(values)
            accepted = (score >= reject) & (np.array(names, object) != UNKNOWN)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(accepted.astype(bool))], names=[*batch.schema.names[:-1], "lang_pred", "score", "accepted"])

    kept = [key, *carry]
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, text).mapInArrow(run, f"{head}, lang_pred string, score double, accepted boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, carry=("held_out",))

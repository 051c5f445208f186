"""Toxicity: a convolutional text classifier trained in numpy.

Words are the sum of two hashed embeddings; filters of several widths slide over the whole text and the largest
value of each goes through a linear layer. As filters are linear in the words, scoring uses a table of every
bucket's share in every filter, so a text costs a few table rows a word. Probabilities and, for each language,
the rejection threshold are calibrated on training rows that the weights have not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._learn import held_out, sample_classes
from kinfold.llm._text import chunks, mix, slices, texts_as_bytes, word_hashes
from kinfold.plans.runtime import table

BITS, DIM, WIDTHS, FILTERS = 16, 8, (1, 2, 3), 6
#: Bounds of the training sample: rows of each class, and words of a text. Of a text with more, stretches of ``STRETCH`` words are drawn from all over it.
PER_CLASS, WORDS_PER_TEXT, STRETCH = {0: 5000, 1: 2000}, 4096, 64
EPOCHS, BATCH, RATE, SEED = 40, 64, 0.1, 11
#: Words that are scored at once.
SLICE = 1 << 17
_N = 1 << BITS
_PAD = max(WIDTHS) - 1
_COLUMNS = [(w, k) for w in WIDTHS for k in range(w)]


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent buckets of each word; the second range follows the first."""
    return (h & np.uint64(_N - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(_N - 1)).astype(np.int64) + _N


def padded(ids: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both bucket columns with empty words (bucket 2 * _N) after each text, and where texts start and their words end."""
    n = np.diff(first)
    starts = first[:-1] + _PAD * np.arange(len(n))
    at = np.arange(first[-1]) + _PAD * np.repeat(np.arange(len(n)), n)
    cols = []
    for x in ids:
        c = np.full(first[-1] + _PAD * len(n), 2 * _N, np.int64)
        c[at] = x
        cols.append(c)
    return cols[0], cols[1], starts, starts + n


def new_model(seed: int = SEED) -> dict:
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (2 * _N + 1, DIM))
    emb[-1] = 0
    kernels = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS}
    return {"emb": emb, "kernels": kernels, "bias": np.zeros(len(WIDTHS) * FILTERS), "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "shift": 0.0}


def _texts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    h = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    return padded(buckets(h), first)


def forward(model: dict, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Logits, filter maxima after the rectifier, their places, which texts have words, and the word columns."""
    a, b, starts, ends = _texts(docs)
    e = model["emb"][a] + model["emb"][b]
    places = np.zeros((len(docs), len(WIDTHS) * FILTERS), np.int64)
    top = np.full(places.shape, -np.inf)
    full = ends > starts
    cuts = np.stack([starts[full], ends[full]], 1).ravel()
    n = (ends - starts)[full]
    inside = np.arange(n.sum()) + np.repeat(starts[full] - (np.cumsum(n) - n), n)
    g, done = e @ np.concatenate([model["kernels"][w][k] for w, k in _COLUMNS], 1), 0
    for i, w in enumerate(WIDTHS):
        conv = g[:, done * FILTERS : (done + 1) * FILTERS].copy()
        for k in range(1, w):
            conv[: len(conv) - k] += g[k:, (done + k) * FILTERS : (done + k + 1) * FILTERS]
        done += w
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        if len(cuts):
            best = np.maximum.reduceat(conv, cuts, 0)[::2]
            top[full, cols] = best
            # The first place of each maximum: the last to be written of the places in falling order.
            at, filter_ = np.nonzero(conv[inside] == np.repeat(best, n, 0))
            first = np.zeros(best.shape, np.int64)
            first[np.repeat(np.arange(len(n)), n)[at][::-1], filter_[::-1]] = inside[at][::-1]
            places[full, cols] = first
    z = np.where(full[:, None], np.maximum(np.where(full[:, None], top, 0) + model["bias"], 0), 0)
    return z @ model["out"] + model["shift"], z, places, full, (a, b, e)


def train(docs: list[np.ndarray], y: np.ndarray, langs: list, epochs: int = EPOCHS, seed: int = SEED, prior: float | None = None) -> dict:
    """Weights by stochastic gradient descent (Adagrad steps), then calibration on a fifth of the rows.

    The embeddings' first coordinate starts from how much more often a bucket occurs in toxic texts, which the
    first filters pick up; all weights are then trained.
    """
    rng = np.random.default_rng(seed)
    model = new_model(seed)
    order = rng.permutation(len(docs))
    cut = len(docs) - len(docs) // 5
    fit, held = order[:cut], order[cut:]
    if len(docs) == 0 or len(set(y.tolist())) < 2:
        rate = float(np.mean(y)) if len(y) else 0.0
        return {"table": np.zeros((2 * _N + 1, len(_COLUMNS) * FILTERS), np.float32), "bias": model["bias"], "out": model["out"] * 0, "shift": float(np.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 1.5))), "thresholds": {}, "threshold": 0.5}
    distinct = list({docs[i].tobytes(): i for i in fit}.values())
    seen = np.zeros((2, 2 * _N + 1))
    for i in distinct:
        for x in buckets(np.unique(docs[i])):
            seen[int(y[i]), np.unique(x)] += 1
    n1, n0 = max(1, int(y[distinct].sum())), max(1, int((1 - y[distinct]).sum()))
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    sure = np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)), 0)
    model["emb"][:-1, 0] += np.clip(sure, -1, 3)[:-1] * 0.5
    for w in WIDTHS:
        model["kernels"][w][:, 0, : FILTERS // 2] = np.abs(model["kernels"][w][:, 0, : FILTERS // 2]) + 0.3
    model["out"] = np.tile(np.where(np.arange(FILTERS) < FILTERS // 2, np.abs(model["out"][:FILTERS]), model["out"][:FILTERS]), len(WIDTHS))
    grown = {"emb": np.full((2 * _N + 1, 1), 1e-3), **{("k", w): np.full_like(model["kernels"][w], 1e-3) for w in WIDTHS}, "bias": np.full_like(model["bias"], 1e-3), "out": np.full_like(model["out"], 1e-3), "shift": 1e-3}
    by_class = np.array([1.0, min(8.0, n0 / n1)])
    for _ in range(epochs):
        mixed = rng.permutation(fit)
        for s in range(0, len(mixed), BATCH):
            part = mixed[s : s + BATCH]
            z_out, z, places, full, (a, b, e) = forward(model, [docs[i] for i in part])
            p = 1 / (1 + np.exp(-np.clip(z_out, -30, 30)))
            g = (p - y[part]) * by_class[y[part].astype(int)] / len(part)
            dz = g[:, None] * model["out"] * (z > 0) * full[:, None]
            d_out, d_shift, d_bias = g @ z, g.sum(), dz.sum(0)
            rows, values = [], []
            for i, w in enumerate(WIDTHS):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                dk = np.zeros_like(model["kernels"][w])
                for k in range(w):
                    at = np.minimum(places[:, cols] + k, len(e) - 1)
                    dk[k] = np.einsum("dfe,df->ef", e[at], dz[:, cols])
                    d_emb = dz[:, cols][:, :, None] * model["kernels"][w][k].T[None]
                    live = (dz[:, cols] != 0).ravel()
                    for column in (a, b):
                        rows.append(column[at].ravel()[live])
                        values.append(d_emb.reshape(-1, DIM)[live])
                grown["k", w] += dk**2
                model["kernels"][w] -= RATE * dk / np.sqrt(grown["k", w])
            for name, d in (("bias", d_bias), ("out", d_out)):
                grown[name] += d**2
                model[name] = model[name] - RATE * d / np.sqrt(grown[name])
            grown["shift"] += d_shift**2
            model["shift"] -= RATE * d_shift / np.sqrt(grown["shift"])
            at, back = np.unique(np.concatenate(rows), return_inverse=True)
            d = np.zeros((len(at), DIM))
            np.add.at(d, back, np.concatenate(values))
            d[at == 2 * _N] = 0
            grown["emb"][at] += (d**2).mean(1, keepdims=True)
            model["emb"][at] -= RATE * d / np.sqrt(grown["emb"][at])
    out = {
        "table": np.concatenate([model["emb"] @ model["kernels"][w][k] for w, k in _COLUMNS], 1).astype(np.float32),
        "bias": model["bias"], "out": model["out"], "shift": float(model["shift"]),
    }
    held = held if len(held) >= 10 else order
    logit = np.concatenate([forward(model, [docs[i] for i in held[s : s + BATCH]])[0] for s in range(0, len(held), BATCH)])
    truth = y[held]
    share = float(truth.mean()) if 0 < truth.mean() < 1 else 0.5
    real = share if prior is None else min(max(prior, 1e-6), 1 - 1e-6)
    weight = np.where(truth == 1, real / share, (1 - real) / (1 - share))
    slope, shift = calibrate(logit, truth, weight)
    out["out"], out["shift"] = out["out"] * slope, out["shift"] * slope + shift
    p = 1 / (1 + np.exp(-np.clip(logit * slope + shift, -30, 30)))
    out["threshold"] = best_cut(p, truth, weight)
    tags = np.array([str(langs[i]) for i in held], object)
    out["thresholds"] = {t: best_cut(p[tags == t], truth[tags == t], weight[tags == t]) for t in sorted(set(tags)) if (tags == t).sum() >= 40 and 5 <= truth[tags == t].sum() < (tags == t).sum()}
    return out


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets; the slope stays positive."""
    pos, neg = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [(g * x).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = float(np.clip(a - np.clip(step[0], -0.5, 0.5), 0.2, 5)), float(b - np.clip(step[1], -1, 1))
    return a, b


def best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score with the least weighted error, drawn to 0.5 by half a percent of the rows' weight."""
    xs = np.unique(p)
    cuts = np.array([0.5, *((xs[1:] + xs[:-1]) / 2)])
    errors = [(weight * ((p >= c) != (y == 1))).sum() + 0.01 * weight.sum() * abs(c - 0.5) for c in cuts]
    return float(cuts[int(np.argmin(errors))])


def drawn(h: np.ndarray, most: int) -> np.ndarray:
    """All words, or of more than ``most`` whole stretches from all over the text, those whose first words hash lowest."""
    if len(h) <= most:
        return h
    n = len(h) // STRETCH
    low = np.argsort(mix(h[: n * STRETCH : STRETCH] + np.arange(n, dtype=np.uint64)), kind="stable")[: max(1, most // STRETCH)]
    return np.concatenate([h[i * STRETCH : (i + 1) * STRETCH] for i in np.sort(low).tolist()])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", lang: str = "lang", per_class: dict | None = None, words_per_text: int = WORDS_PER_TEXT) -> dict:
    """Learn from a sample of labelled rows, bounded by ``per_class`` rows of each class and ``words_per_text`` words of a text.

    Texts with more words are learned from stretches drawn from the whole of them. Repeated labels of a key count as
    often; null labels, keys and texts are passed over.
    """
    wanted = per_class or PER_CLASS
    labels = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where("_key is not null and _y in (0, 1)")
    rows0, n = sample_classes(labels, "_y", "_key", wanted[0])
    rows1, _ = sample_classes(labels, "_y", "_key", wanted[1])
    rows = rows0.where("_y = 0").union(rows1.where("_y = 1"))  # at most about the sum of wanted rows
    joined = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(rows), "_key")

    def run(batches):
        for batch in batches:
            words = [drawn(word_hashes([raw])[0], words_per_text).tobytes() for raw in texts_as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], names=["y", "lang", "words"])

    got = [(bytes(r[2]), r[0], r[1]) for r in joined.select("_y", "_lang", "_text").mapInArrow(run, "y int, lang string, words binary").collect()]
    got.sort(key=lambda r: (r[0], r[1]))
    seen = n.get(0, 0) + n.get(1, 0)
    return train([np.frombuffer(r[0], np.uint64) for r in got], np.array([r[1] for r in got], np.float64), [r[2] for r in got], prior=n.get(1, 0) / seen if seen else None)


def _maxima(model: dict, h: np.ndarray, first: np.ndarray, more: int = 0) -> np.ndarray:
    """The largest value of each filter in each text (0 without words); the last ``more`` words of a text only end windows."""
    a, b, starts, ends = padded(buckets(h), first)
    ends = ends - more
    g = model["table"][a] + model["table"][b]
    z = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS))
    full = ends > starts
    cuts = np.stack([starts[full], ends[full]], 1).ravel()
    done = 0
    for i, w in enumerate(WIDTHS):
        conv = g[:, done * FILTERS : (done + 1) * FILTERS].copy()
        for k in range(1, w):
            conv[: len(conv) - k] += g[k:, (done + k) * FILTERS : (done + k + 1) * FILTERS]
        done += w
        if len(cuts):
            z[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(conv, cuts, 0)[::2]
    return z


def logits(model: dict, texts: list[bytes], at_once: int = SLICE) -> np.ndarray:
    """Of whole texts, with the table of bucket shares. A text of more than ``at_once`` words goes slice by slice, whose maxima's maximum is that of the text."""
    h, first = word_hashes(texts)
    if len(texts) == 1 and len(h) > at_once:
        z = np.full((1, len(WIDTHS) * FILTERS), -np.inf)
        for s in range(0, len(h), at_once):
            part = h[s : s + at_once + _PAD]
            z = np.maximum(z, _maxima(model, part, np.array([0, len(part)]), max(0, min(_PAD, len(part) - at_once))))
    else:
        z = _maxima(model, h, first)
    full = np.diff(first) > 0
    z[full] = np.maximum(z[full] + model["bias"], 0)
    return z @ model["out"] + model["shift"]


def predict(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text", lang: str | None = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: (key, *carry, score, predicted, threshold, rejected).

    ``predicted`` is score >= 0.5. ``rejected`` is score >= ``threshold``, that of the row's language (of all, where
    the language is null or has too few examples); the language touches neither score nor ``predicted``. Null and
    wordless texts get the score of no evidence. Repeated and null keys keep their rows.
    """
    kept = [key, *carry]

    def run(batches):
        for batch in batches:
            texts = texts_as_bytes(batch.column(batch.num_columns - 1))
            parts = [logits(model, texts[a:b]) for a, b in chunks(texts, 1 << 19)]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.zeros(0), -30, 30)))
            cut = np.array([model["thresholds"].get(str(x), model["threshold"]) for x in batch.column(batch.num_columns - 2).to_pylist()], np.float64)
            more = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(cut), pa.array(score >= cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *more], names=[*batch.schema.names[:-2], "score", "predicted", "threshold", "rejected"])

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    tag = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    return df.select(*kept, tag.alias("_lang"), F.col(text).alias("_text")).mapInArrow(run, f"{head}, score double, predicted int, threshold double, rejected boolean")


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> dict:
    labels = table(spark, sf_dir, "labels")
    return fit(docs, labels.where(~held_out("doc_id", 5, 0)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = trained(spark, sf_dir, docs)
    return predict(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model, carry=("held_out",))


def keep_accepted(df: DataFrame, model: dict, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that are not rejected, with all their columns; nothing is shuffled."""

    def run(batches):
        for batch in slices(batches):
            texts = texts_as_bytes(batch.column(batch.schema.get_field_index(text)))
            parts = [logits(model, texts[a:b]) for a, b in chunks(texts, 1 << 17)]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.zeros(0), -30, 30)))
            cut = np.array([model["thresholds"].get(str(x), model["threshold"]) for x in batch.column(batch.schema.get_field_index(lang)).to_pylist()], np.float64)
            yield batch.filter(pa.array(score < cut))

    return df.mapInArrow(run, df.schema)

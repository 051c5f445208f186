import random

import numpy as np
import pytest

from kinfold.llm import _learn, _text, langid, toxicity
from tests.llm.conftest import ODD

PARTS = {"aa": ["the", "ing", "wh", "and", "th"], "bb": ["sch", "ung", "ein", "der", "keit"], "cc": ["eau", "que", "ré", "oi", "les"]}


def corpus(spark, n=300, toxic=False):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        bad = toxic and rng.random() < 0.3
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["blorg", "snark", "Fleeb"]))
        rows.append((i, " ".join(words), lang, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_words_are_hashed_in_little_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(_text, "_powers", {})
    texts = [b"some words of a text " * 100] * 2000
    tracemalloc.start()
    n = sum(len(_text.word_hashes(texts[a:b])[0]) for a, b in _text.chunks(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 5 * 100 * 2000
    assert most < 32e6, most


def test_words_by_brute_force():
    import re

    texts = [(t or "") for _, t, *_ in ODD] + ["a\x00b C-D_e", "ÀB1", "  ", "\n"]
    h, first = _text.word_hashes([t.encode() for t in texts])
    seen = {}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        mine = h[first[k] : first[k + 1]].tolist()
        assert len(mine) == len(words)
        for a, b in zip(mine, words, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)
    assert len(_text.shingle_set(h[:0], b"!!!")) == 1 and len(_text.shingle_set(h[:3], b"")) == 1


def test_language(spark, odd, empty):
    docs = corpus(spark).withColumn("held_out", _learn.held_out("doc_id", 4, 2))
    model = langid.fit(docs.where("not held_out"))
    got = langid.predict(docs, model, carry=("held_out", "lang")).where("held_out").collect()
    assert len(got) > 40 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert model["langs"] == ["aa", "bb", "cc"] and np.mean([r.accepted for r in got]) > 0.8
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t, *_ in ODD if i == r.doc_id)
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) and (r.lang_pred in model["langs"] or (r.score == 0 and not r.accepted))
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.fit(docs.where("not held_out"))["scores"].tobytes() == model["scores"].tobytes()


def test_toxicity(spark, odd, empty):
    docs = corpus(spark, 600, True)
    labels = docs.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~_learn.held_out("doc_id", 5, 0)))
    got = toxicity.predict(docs.withColumn("held_out", _learn.held_out("doc_id", 5, 0)), model, carry=("held_out", "toxic")).where("held_out").collect()
    assert len(got) > 70 and np.mean([r.predicted == r.toxic for r in got]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and r.rejected == (r.score >= r.threshold) for r in got)
    rows = toxicity.predict(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id in (1, 6)]
    assert len(set(same)) == 1
    assert toxicity.predict(empty, model).count() == 0
    kept = toxicity.keep_accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(not r.rejected for r in rows)
    plain = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.predict(odd, plain).collect()} == {0}


def test_table_form_equals_training_form():
    rng = np.random.default_rng(0)
    texts = [b"", b"one", b"two words", b"a few more words than that", b"!!"] * 3
    model = toxicity.new_model()
    model["bias"] = rng.normal(0, 0.1, len(model["bias"]))
    h, first = _text.word_hashes(texts)
    docs = [h[first[i] : first[i + 1]] for i in range(len(texts))]
    want = toxicity.forward(model, docs)[0]
    table = np.concatenate([model["emb"] @ model["kernels"][w][k] for w, k in toxicity._COLUMNS], 1)
    got = toxicity.logits({**model, "table": table}, texts)
    assert got == pytest.approx(want)


def test_long_texts_go_piece_by_piece():
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcé ,") for _ in range(rng.randint(1, 9))) for _ in range(4000)).encode()
    h, first = _text.word_hashes([long])
    for limit in (1, 7, 1000):
        g, at = _text.word_hashes([long], limit)
        assert (g == h).all() and at.tolist() == first.tolist()
    model = toxicity.new_model()
    model["table"] = np.concatenate([model["emb"] @ model["kernels"][w][k] for w, k in toxicity._COLUMNS], 1)
    for at_once in (3, 4, 100, len(h) - 1, len(h) - 2):
        assert toxicity.logits(model, [long], at_once) == pytest.approx(toxicity.logits(model, [long]))
    some = toxicity.drawn(h, 256)
    assert len(some) == 256 and (toxicity.drawn(h, len(h)) == h).all()
    at = [np.flatnonzero((h[: len(h) - 63] == s[0]) & (h[63:] == s[63])).tolist() for s in some.reshape(-1, 64)]
    assert all(at) and max(a[0] for a in at) > len(h) // 2


def test_filters_see_the_order_of_words():
    """The same words in every text: what makes it toxic is their order, which a bag of words cannot tell."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]

    def make(n):
        texts, toxic = [], []
        for i in range(n):
            w = [rng.choice(words) for _ in range(rng.randint(10, 60))]
            at = rng.randrange(len(w))
            w[at:at] = ["vile", "person"] if i % 3 == 0 else ["person", "vile"]
            texts.append(" ".join(w).encode())
            toxic.append(float(i % 3 == 0))
        return texts, np.array(toxic)

    texts, toxic = make(1200)
    model = toxicity.train([_text.word_hashes([t])[0] for t in texts], toxic, ["x"] * len(texts))
    texts, toxic = make(300)
    assert ((toxicity.logits(model, texts) >= 0) == (toxic == 1)).mean() > 0.95

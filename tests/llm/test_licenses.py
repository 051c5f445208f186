import random
import re

import pytest

from kinfold.llm import licenses
from tests.llm.conftest import ODD

TEXTS = [
    "This is under the MIT License. Mit license, mit  license!",
    "Apache-License and the apache license; General public license",
    "general general public license public license",
    "x y z " + licenses.TEMPLATES["mit-text"] + " tail",
    "head " + licenses.TEMPLATES["bsd-text"].replace("with or without modification", "with or, if you like, without any modification") + " tail",
    licenses.TEMPLATES["gpl-short"] * 3,
    "this software is not free",
    None,
    "",
]


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[3].labels == "mit-text" and got[3].score == 1 and got[3].spans[0].start == 3
    assert "bsd-text" in got[4].labels and "gpl-short" in got[5].labels and got[6].labels == "" and got[8].score == 0


def test_one_word_more_at_every_place(spark):
    texts = []
    for label in ("bsd-text", "apache-notice"):
        words = licenses.TEMPLATES[label].split()
        texts += [(label, " ".join(["head", *words, "tail"]))]
        texts += [(label, " ".join(["head", *words[:at], "inserted", *words[at:], "tail"])) for at in range(len(words) + 1)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    lost = [(label, t) for i, (label, t) in enumerate(texts) if label not in got[i].labels.split(",")]
    assert not lost
    assert got[0].score == 1 and [s.label for s in got[0].spans] == ["bsd-text"]
    assert all(sum(s.label == label for s in got[i].spans) == 1 for i, (label, _) in enumerate(texts))


def test_odd_rows(odd, empty):
    got = licenses.scan(odd).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), base(t)[0]) for i, t, *_ in ODD)
    assert licenses.scan(empty).count() == 0


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def voted_labels(text, coverage=0.8):
    """Diagonal voting without any hash: exact k-grams, chains of offsets, words compared."""
    out = set()
    w = licenses.words(text)
    for label, template in licenses.TEMPLATES.items():
        own = licenses.words(template)
        k, half = min(4, len(own)), max(1, len(own) // 2)
        by = {}
        for p in range(len(w) - k + 1):
            for at in range(len(own) - k + 1):
                if w[p : p + k] == own[at : at + k]:
                    by.setdefault(p - at, []).append((p, at))
        chains, last = [], None
        for d in sorted(by):
            if last is None or d - last > min(8, half):
                chains.append((d, {}))
            first, parts = chains[-1]
            parts.setdefault((d - first) // max(8, half), []).extend(by[d])
            last = d
        for _, parts in chains:
            for votes in parts.values():
                covered = {at + j for _, at in votes for j in range(k)}
                lo, end = min(p for p, _ in votes), max(p for p, _ in votes) + k
                if len(covered) / len(own) >= coverage and lcs(own, w[lo:end]) / len(own) >= coverage:
                    out.add(label)
    return out


def test_labels_against_diagonal_voting_by_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for label, template in licenses.TEMPLATES.items():
        own = template.split()
        for at in range(0, len(own), 5):
            texts.append(" ".join([*own[:at], "three", "words", "more", *own[at:]]))
        for n in range(1, 8):
            cut = list(own)
            for _ in range(n):
                cut[rng.randrange(len(cut))] = "other"
            texts.append("before " + " ".join(cut) + " after " + label)
        half = len(own) // 2
        texts += [" ".join(own[half:] + own[:half]), " ".join(own * 3), " ".join(own[:half] + ["x"] * 30 + own[half:]), " ".join(own[: len(own) * 9 // 10])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) - set(r.base_labels.split(",")) - {""} for r in licenses.scan(df).collect()}
    wrong = [(t, got[i], voted_labels(t)) for i, t in enumerate(texts) if got[i] != voted_labels(t)]
    assert not wrong
    assert sum(map(len, got.values())) > 100


def test_short_phrases_and_templates(spark):
    df = spark.createDataFrame([(1, "Unlicensed; all rights reserved by WTFPL, do what you want"), (2, "rights all reserved"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df, phrases={"WTFPL": "wtfpl"}, templates={"none": "unlicensed", "kept": "All rights reserved", "want": "what you want"}).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base, got[1].first_word) == ("wtfpl", "kept,none,want,wtfpl", 1, 5)
    assert got[2].labels == "" and got[3].labels == "" and got[3].n_words == 0
    with pytest.raises(ValueError):
        licenses.scan(df, phrases={"...": "x"})


def test_long_texts_in_slices(spark, monkeypatch):
    words = ["w%d" % (i % 977) for i in range(250_000)]
    words[123_000:123_000] = licenses.TEMPLATES["isc-text"].split()
    words[99_999:99_999] = ["MIT", "License"]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    r = licenses.scan(df).first()
    assert (r.n_words, r.n_base, r.first_word) == (len(licenses.words(" ".join(words))), 1, 99_999) and r.labels == "isc-text,mit"

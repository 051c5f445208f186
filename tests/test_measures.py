import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import measures as m
from kinfold.functions import phonetics as p
from kinfold.functions import transforms as t

STRINGS = [("MARTHA", "MARHTA"), ("DWAYNE", "DUANE"), ("DIXON", "DICKSONX"), ("elephant", "hippo"), ("", ""), ("a", ""), ("abcdefghij", "abcdefghix"), ("müller", "mueller"), (None, "a"), ("a", None), (None, None), ("same", "same")]
LISTS = [(["a", "b"], ["b", "c"]), ([], []), ([], ["a"]), (["a", "a", "b"], ["a"]), (None, ["a"]), (["aaa", "ddd", "bbb", "ccc"], ["abcd", "cc", "ab", "bb"])]

STRING_MEASURES = {
    "equality": m.equality(), "inequality": m.inequality(), "levenshtein": m.levenshtein(), "cut .9": m.levenshtein().cutoff(0.9), "cut .8": m.levenshtein().cutoff(0.8),
    "jaro_winkler": m.jaro_winkler(), "scaled": m.levenshtein().scale_with_threshold(0.5), "binarize": m.levenshtein().binarize(), "zero": m.levenshtein().unknown_if_zero(), "if": m.levenshtein().unknown_if(lambda s: s < 0.5),
    "max": m.max_(m.levenshtein(), m.jaro_winkler()), "min": m.min_(m.levenshtein(), m.jaro_winkler()), "min compat": m.min_(m.equality(), m.levenshtein(), compat=True), "mean": m.mean(m.equality(), m.unknown(), m.levenshtein()),
    "first": m.first(m.unknown(), m.levenshtein()), "last": m.last(m.levenshtein(), m.equality()), "bigrams": m.jaccard().of(t.bigram()), "cosine": m.cosine().of(t.trigram()), "words": m.monge_elkan(m.levenshtein()).of(t.words()),
    "average": m.weighted_average().add(2, m.equality()).add(1, m.levenshtein()), "cologne": m.equality().of(p.cologne_phonetic()), "sound": m.equality().of(p.beider_morse()), "negate": m.levenshtein().negate(), "any": m.similarity_score(lambda a, b: float(len(a) == len(b))),
}
LIST_MEASURES = {
    "jaccard": m.jaccard(), "cosine": m.cosine(), "elkan": m.monge_elkan(m.levenshtein()), "elkan 1": m.monge_elkan(m.levenshtein(), 1), "elkan 1 compat": m.monge_elkan(m.levenshtein(), 1, compat=True),
    "place": m.position_wise(m.levenshtein()), "place compat": m.position_wise(m.levenshtein(), compat=True), "elkan jw": m.monge_elkan(m.jaro_winkler()), "stable": m.stable_matching(m.levenshtein()), "strong": m.matching_similarity("strong", m.levenshtein()),
}


def near(a, b):
    return a is b if a is None or b is None else math.isclose(a, b, abs_tol=1e-9)


@pytest.mark.parametrize("pairs,kind,measures", [(STRINGS, "string", STRING_MEASURES), (LISTS, "array<string>", LIST_MEASURES)])
def test_expression_equals_plain_form(spark, pairs, kind, measures):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, l {kind}, r {kind}")
    got = df.select("i", *[x(F.col("l"), F.col("r")).alias(f"m{k}") for k, x in enumerate(measures.values())]).collect()
    for row in got:
        for k, (name, x) in enumerate(measures.items()):
            assert near(row[f"m{k}"], x.score(*pairs[row.i])), (name, pairs[row.i], row[f"m{k}"], x.score(*pairs[row.i]))


def test_published_jaro_winkler_values():
    for a, b, s in (("MARTHA", "MARHTA", 0.9611), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.8133), ("elephant", "hippo", 0.4417), ("", "", 1.0), ("a", "", 0.0)):
        assert abs(m.jaro_winkler_score(a, b) - s) < 1e-4


def test_levenshtein_edges():
    assert m.levenshtein().score("", "") is None
    assert m.levenshtein().cutoff(0.9).score("abcdefghij", "abcdefghix") == 0  # floor of 10 * (1 - 0.9) is 0
    assert m.levenshtein().cutoff(0.8).score("abcdefghij", "abcdefghix") == 0.9
    assert m.levenshtein().cutoff(0.9).cutoff(0.5).threshold == 0.9
    assert isinstance(m.levenshtein().of(t.lower()).cutoff(0.8).inner, m.Levenshtein)


def test_matching_similarity_vectors():
    left, right = ["aaa", "ddd", "bbb", "ccc"], ["abcd", "cc", "ab", "bb"]
    s = 1 / 3 + 2 / 3 + 2 / 3 + 1 / 4
    x = m.stable_matching(m.levenshtein())
    assert abs(x.score(left, right) - s / 4) < 1e-4
    assert abs(x.score([*left, "x"], right) - s / 5) < 1e-4
    assert abs(x.score(left, [*right, "x"]) - s / 5) < 1e-4
    assert x.score(None, right) is None and x.score(left, None) is None


def test_differences(spark):
    df = spark.createDataFrame([(1.0, 1.5, dt.date(2020, 1, 31), dt.date(2020, 2, 1)), (1.0, None, None, dt.date(2020, 2, 1)), (0.0, 9.0, dt.date(2020, 1, 1), dt.date(2021, 1, 1))], "a double, b double, d date, e date")
    got = df.select(m.scaled_difference(2)(F.col("a"), F.col("b")), m.scaled_difference(2, "DAY")(F.col("d"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(0.75, 0.5), (None, None), (0.0, 0.0)]


def test_null_measure_cache_and_clash(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None), (None, None)], "l string, r string")
    x = m.with_similarity(df, m.levenshtein(), "l", "r", cache=True)
    assert sorted(map(str, (r.similarity for r in x.collect()))) == ["0.0", "0.0", "None", "None"]
    assert [r[0] for r in df.select(m.levenshtein()(F.col("l"), F.col("r"), F.lit(0.5))).collect()] == [0.0, 0.0, 0.5, 0.5]
    with pytest.raises(ValueError):
        m.with_similarity(df, m.levenshtein(), "l", "r", "l")
    assert m.with_similarity(df.limit(0), m.levenshtein(), "l", "r", cache=True).count() == 0


TEXTS = ["Robert", "Rupert", "Tymczak", "Pfister", "Honeyman", "Ashcraft", "", "O'Brien", "Müller", " a  b", "(x)Élan-1", None]
TRANSFORMS = {"words": t.words(), "bigram": t.bigram(), "trigram": t.trigram(), "soundex": t.soundex(), "refined": t.refined_soundex(), "cologne": p.cologne_phonetic(), "name": t.normalize_name(), "sound": p.beider_morse(), "both": t.lower().and_then(t.bigram())}


def test_transformations(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TEXTS)], "i int, s string")
    for row in df.select("i", *[x(F.col("s")).alias(k) for k, x in TRANSFORMS.items()]).collect():
        for k, x in TRANSFORMS.items():
            try:
                want = x.value(TEXTS[row.i])
            except ValueError:
                want = None
            assert row[k] == want, (k, TEXTS[row.i])
    failed = df.where(t.soundex().fails(F.col("s")).isNotNull()).collect()
    assert [r.s for r in failed] == ["Müller", "(x)Élan-1"]


def test_known_codes():
    assert t.soundex().value("Robert") == t.soundex().value("Rupert") == "R163" and t.soundex().value("Tymczak") == "T522" and t.soundex().value("Pfister") == "P236"
    assert p.cologne("Müller") == "657" and p.cologne("Breschnew") == "17863" and p.cologne("Wikipedia") == "3412"
    assert t.words().value(" a  b") == ["", "a", "b"] and t.ngram(3).value("ab") == []


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=8), st.text("abcé ", max_size=8))
def test_scores_are_bounded_and_symmetric(a, b):
    for x in (m.levenshtein(), m.jaro_winkler(), m.jaccard().of(t.bigram()), m.cosine().of(t.bigram())):
        s = x.score(a, b)
        assert s is None or -1e-9 <= s <= 1 + 1e-9
        assert near(s, x.score(b, a)) or not x.symmetric


def test_beider_morse_against_another_encoder(spark):
    """Codes of names and of random spellings equal those of the encoder among Spark's libraries."""
    encoder = spark.sparkContext._jvm.org.apache.commons.codec.language.bm.BeiderMorseEncoder()
    rng = random.Random(1)
    parts = ["sch", "tz", "ei", "au", "ou", "cz", "w", "a", "e", "i", "o", "u", "r", "n", "m", "l", "ck", "ph", "th", "gn", "lh", "ñ", "ü", "ö", "ć", "y", "j", "ii", "gh", "ch", "sz", "q", "x", "-", " "]
    names = ["Meyer", "Maier", "Renault", "Schwarzenegger", "d'Arc", "van der Berg", "de la Cruz", "O'Brien", "Müller", "Škoda", "Jean-Luc", "Ω", "", "Nguyễn", "von trapp", "dela rosa", "Ceauşescu", "Tchaikovsky", "Ng", "Иванов", "כהן", "García Lorca"]
    names += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    got = {r.name: r.code for r in df.select("name", p.beider_morse()(F.col("name")).alias("code")).collect()}
    assert got.pop(None) is None
    assert {n: c for n, c in got.items() if c != encoder.encode(n)} == {}
    plain = p.BeiderMorse()
    assert plain("Meyer") == plain("Maier") == got["Meyer"] != plain("Smith")

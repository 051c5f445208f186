import datetime as dt
import random

from pyspark.sql import functions as F

from kinfold.functions import measures as m
from kinfold.operators import candidates, classify, fusion
from kinfold.plans import person
from kinfold.plans.pipeline import Deduplication, DuplicateDetection
from kinfold.sources import tables
from kinfold.streaming.online import OnlineDeduplication, OnlineDetection

SYLLABLES = ["ka", "ro", "mi", "ven", "tal", "shu", "dor", "lin", "pex", "gru", "bal", "nok"]


def name(rng):
    return "".join(rng.sample(SYLLABLES, 3)).capitalize()


def write_people(path, n=60):
    """A tab-separated file of people and a second one of copies with changed titles, names and a birth year."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        rows.append([str(i), "dr" if i % 7 == 0 else "", name(rng), name(rng), name(rng), f"{rng.randrange(1, 29):02d}.{rng.randrange(1, 13):02d}.{rng.randrange(10, 70)}", rng.choice(["male", "female"]), "mr", "Nogai", "EUR", "u", str(i)])
    copies = []
    for k, i in enumerate((3, 15, 16, 26, 39)):
        c = list(rows[i])
        c[0] = str(i + 100)
        if k == 1:
            c[1] = "prof"
        if k == 2:
            c[5] = c[5][:-1] + str((int(c[5][-1]) + 1) % 10)
        copies.append(c)
    for p, data in ((path / "people.tsv", rows), (path / "copies.tsv", copies)):
        p.write_text("\n".join("\t".join(r) for r in [list(tables.PERSON_FIELDS), *data]) + "\n", encoding="utf-8")
    return rows, copies


def test_person_deduplication(spark, tmp_path):
    rows, copies = write_people(tmp_path)
    old = tables.read_persons(spark, str(tmp_path / "people.tsv"))
    new = tables.read_persons(spark, str(tmp_path / "copies.tsv"))
    assert old.where("id = '3'").first().birthDate.year >= 2000
    both = old.withColumn("arrival", F.col("id").cast("long")).union(new.withColumn("arrival", F.col("id").cast("long") + 1000))
    for online in (True, False):
        out = person.deduplication(online).deduplicate(both).collect()
        fused = {r.id: r for r in out if r.n_records > 1}
        alone = [r for r in out if r.n_records == 1]
        assert len(alone) == 55 and len(fused) == 5
        assert {frozenset(r.fusedIds) for r in fused.values()} == {frozenset((str(i), str(i + 100))) for i in (3, 15, 16, 26, 39)}
        for r in fused.values():
            assert r.id == min(r.fusedIds) and r.errors == [] or set(r.fusedIds) == {"16", "116"}
    assert person.deduplication(False).deduplicate(both.where("id < '2'").limit(0)).count() == 0


def test_multiple_names(spark):
    schema = "firstName string, lastName string, gender string, birthDate date"
    day = dt.date(2010, 5, 6)
    rows = [
        (("Johnatan", "Smithson", "MALE", day), ("Smithson", "Johnatan", "MALE", day), "DUPLICATE"),
        (("Johnatan", "Smithson", "MALE", day), ("Johnatan", "Smithsen", "MALE", day), "DUPLICATE"),
        (("Jo Hna", "Smithson", "MALE", day), ("Smithson Hna", "Jo", "MALE", day), "DUPLICATE"),
        (("Johnatan", "Smithson", "MALE", day), ("Mary", "Poppins", "FEMALE", dt.date(1999, 1, 1)), "UNKNOWN"),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], f"i int, left struct<{schema.replace(' string', ':string').replace(' date', ':date')}>, right struct<{schema.replace(' string', ':string').replace(' date', ':date')}>")
    got = {r.i: r.result.classification for r in person.classifier_with_multiple_names().classify(df).collect()}
    assert got == {i: r[2] for i, r in enumerate(rows)}


def detection():
    keys = [candidates.sorting_key("name", "name")]
    rules = classify.RuleBasedClassifier().default_rule(m.levenshtein().of("name"), 0.8)
    return keys, DuplicateDetection(lambda df: candidates.online_sorted_neighborhood(df, keys, "id", "arrival", 6), rules, "id", ("name",))


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    base = [name(rng) for _ in range(12)]
    rows = [(i, base[i % 12] if i < 12 or i % 3 else base[i % 12] + "x", i) for i in range(36)]
    keys, found = detection()
    df = spark.createDataFrame(rows, "id long, name string, arrival long")
    want = {(r.record_id, r.cluster_id) for r in found.clusters(df).collect()}
    inbox = tmp_path / "in"
    for k in range(3):
        df.where(F.col("arrival").between(12 * k, 12 * k + 11)).coalesce(1).write.parquet(str(inbox / f"p{k}"))
    online = OnlineDetection(found, keys, str(tmp_path / "state"), "arrival", 6)
    changes = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(inbox))
    query = online.start(stream, str(tmp_path / "checkpoint"), lambda c, b: changes.append((b, c.count())))
    query.awaitTermination(240)
    assert query.exception() is None and len(changes) == 3
    state = tables.read_version(spark, str(tmp_path / "state" / "clusters"))[1]
    assert {(r.record_id, r.cluster_id) for r in state.collect()} == want
    assert online.process(df.limit(1), 2).count() == 0  # a repeated batch changes nothing


def test_small_utilities(spark, tmp_path):
    words = ["aa", "ab", "ac", "ba", "bb", "bc"]
    assert list(tables.take_while_inclusive_iter(words, lambda s: s[0] == "a")) == words[:4]
    df = spark.createDataFrame([(words,), (words[:2],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(tables.take_while_inclusive(F.col("w"), lambda x: x.startswith("a"))).collect()] == [words[:4], words[:2], []]
    a = tables.records(spark, [(1, "a"), (2, "b")], "k long, v string")
    tables.upsert(spark, str(tmp_path / "t"), a, "k", 0)
    out = tables.upsert(spark, str(tmp_path / "t"), tables.records(spark, [(2, "c"), (3, "d")], "k long, v string"), "k", 1)
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert tables.upsert(spark, str(tmp_path / "t"), a, "k", 1).count() == 3
    assert tables.latest_by_key(out.withColumn("n", F.lit(1)), "k", "n").count() == 3


def test_oracle_detection(spark):
    df = spark.createDataFrame([(i, str(i), i) for i in range(6)], "id long, name string, arrival long")
    gold = spark.createDataFrame([(1, 0), (3, 2)], "left_id long, right_id long")
    keys, found = detection()
    from dataclasses import replace

    got = replace(found, classifier=classify.OracleClassifier(gold)).clusters(df).collect()
    assert {(r.cluster_id, r.record_id) for r in got} == {(0, 0), (0, 1), (2, 2), (2, 3)}
    assert fusion.dont_fuse(df).count() == 0 and fusion.accept_all(df).count() == 6


def test_online_deduplication(spark, tmp_path):
    keys, found = detection()
    f = fusion
    merging = f.merge().field("id").with_(f.min_()).field("name").with_(f.longest(), f.min_()).field("arrival").with_(f.max_())
    path = str(tmp_path / "s")
    online = OnlineDeduplication(OnlineDetection(found, keys, path, "arrival", 6), merging)
    schema = "id long, name string, arrival long"
    first = online.process(spark.createDataFrame([(1, "abcdefghij", 1), (2, "zzzzzz", 2), (3, "abcdefghi", 3)], schema), 0)
    assert {(r.cluster_id, r.name, r.n_records) for r in first.collect()} == {(1, "abcdefghij", 2), (2, "zzzzzz", 1)}
    second = online.process(spark.createDataFrame([(0, "zzzzzzz", 4), (5, "mmmm", 5)], schema), 1)
    assert {(r.cluster_id, r.name, r.arrival, r.n_records) for r in second.collect()} == {(0, "zzzzzzz", 4, 2), (5, "mmmm", 5, 1)}
    assert {(r.id, r.name) for r in online.representations(spark).collect()} == {(0, "zzzzzzz"), (1, "abcdefghij"), (5, "mmmm")}
    batch = Deduplication(found, merging).deduplicate(spark.createDataFrame([(1, "abcdefghij", 1), (2, "zzzzzz", 2), (3, "abcdefghi", 3), (0, "zzzzzzz", 4), (5, "mmmm", 5)], schema))
    assert {(r.id, r.name) for r in batch.collect()} == {(0, "zzzzzzz"), (1, "abcdefghij"), (5, "mmmm")}

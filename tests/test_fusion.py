import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinfold.operators import fusion as f
from kinfold.plans import person

VALS = "array<struct<value:{v},source:string,weight:double,ts:timestamp_ntz>>"


def run(spark, resolution, values, kind="string", tags=None):
    """Values are (value, source, weight, day)."""
    rows = [(v, s, float(w), dt.datetime(2020, 1, d)) for v, s, w, d in values]
    df = spark.createDataFrame([(rows,)], f"vals {VALS.format(v=kind)}")
    ctx = f.Context(F.lit(7))
    if tags:
        ctx.tags["t"] = F.filter("vals", lambda v: v["source"].isin(tags))
    return [(r.value, r.source) for r in df.select(resolution.run(F.col("vals"), ctx).alias("o")).first().o]


A = [("b", "s1", 1, 1), ("aa", "s2", 3, 2), ("b", "s3", 1, 3), ("aa", "s2", 3, 3), ("c", "s4", 1, 1)]
N = [(3.0, "s1", 1, 1), (1.0, "s2", 1, 2), (2.0, "s3", 1, 3), (8.0, "s4", 1, 3)]


def test_resolutions(spark):
    names = lambda r, v=A: [x[0] for x in run(spark, r, v)]
    assert names(f.min_()) == ["aa", "aa"] and names(f.max_()) == ["c"]
    assert names(f.shortest()) == ["b", "b", "c"] and names(f.longest()) == ["aa", "aa"]
    assert names(f.first()) == ["b"] and names(f.last()) == ["c"]
    assert run(spark, f.distinct(), A) == [("b", "calculated"), ("aa", "calculated"), ("c", "s4")]
    assert names(f.most_frequent()) == ["b", "aa", "b", "aa"] and names(f.vote()) == ["aa", "aa"]
    assert names(f.earliest()) == ["b", "c"] and names(f.latest()) == ["b", "aa"]
    assert names(f.prefer_source("s4", "s2")) == ["c"] and names(f.prefer_source("zz", "s3")) == ["b"] and names(f.prefer_source("s4", compat=True)) == ["b", "aa", "b", "aa"]
    assert [x[0] for x in run(spark, f.corresponding("t"), A, tags=["s2"])] == ["aa", "aa"]
    assert names(f.transform(F.upper)) == ["B", "AA", "B", "AA", "C"]
    assert len(names(f.random(3))) == 1 and names(f.random(3)) == names(f.random(3))
    assert names(f.chain(f.longest(), f.vote(), f.first())) == ["aa"] and names(f.assume_equal_value()) == [x[0] for x in A]
    number = lambda r, v=N: [x[0] for x in run(spark, r, v, "double")]
    assert number(f.sum_()) == [14.0] and number(f.mean()) == [3.5] and run(spark, f.mean(), N, "double")[0][1] == "calculated"
    assert number(f.median()) == [2.0, 3.0] and number(f.median(), N[:3]) == [2.0] and number(f.median(compat=True)) == [] and number(f.median(), N[:1]) == [3.0]
    lists = [(["b", "a"], "s1", 1, 1), (["a"], "s2", 1, 2)]
    assert [x[0] for x in run(spark, f.union(), lists, "array<string>")] == [["a", "b"]] and [x[0] for x in run(spark, f.union_all(), lists, "array<string>")] == [["b", "a", "a"]]
    for r in (f.min_(), f.sum_(), f.median(), f.first(), f.last(), f.vote(), f.latest(), f.random(), f.mean(), f.distinct(), f.prefer_source("a")):
        assert run(spark, r, [], "double") == []
    with pytest.raises(KeyError):
        run(spark, f.corresponding("unset"), A)


PEOPLE = "cluster_id long, id string, firstName string, lastName string, birthDate date, gender string, source string, originalId string, lastModified timestamp_ntz, fusedIds array<string>, arrival long"


def people(spark):
    return spark.createDataFrame(
        [
            (1, "id1", "Joanna", "Doe", dt.date(2017, 12, 31), "FEMALE", "source1", None, dt.datetime(2030, 1, 1), [], 0),
            (1, "id2", "John", "Smith", dt.date(2018, 1, 1), "MALE", "source2", None, dt.datetime(2000, 1, 1), [], 1),
            (2, "id3", "Ann", "", None, None, None, None, None, None, 2),
        ],
        PEOPLE,
    )


def test_person_merge(spark):
    rows = {r.cluster_id: r for r in f.fuse(people(spark), "cluster_id", person.merging(), "source", "lastModified", "arrival", {"source1": 1.0, "source2": 2.0}).collect()}
    one = rows[1].fused
    assert (one.id, one.firstName, one.lastName, one.gender, one.birthDate, one.lastModified) == ("id1", "Joanna", "Doe", None, dt.date(2018, 1, 1), dt.datetime(2030, 1, 1))
    assert sorted(one.fusedIds) == ["id1", "id2"]
    assert len(rows[1].errors) == 1 and "Could not fully resolve" in rows[1].errors[0] and "FEMALE" in rows[1].errors[0] and "MALE" in rows[1].errors[0]
    assert rows[2].fused.firstName == "Ann" and rows[2].errors == [] and len(rows[2].originals) == 1


def test_merge_failures_and_order(spark):
    with pytest.raises(ValueError, match="Unknown property"):
        f.fuse(people(spark), "cluster_id", f.merge().field("nope").with_(f.first()))
    with pytest.raises(KeyError):
        f.fuse(people(spark), "cluster_id", f.merge().field("id").corresponding("later").field("lastName").with_(f.first()).save_as("later"))
    m = f.merge().field("id").with_(f.last()).field("n", read=lambda r: F.length(r["firstName"])).with_(f.max_()).converting_back(lambda x: x * 10).field("none", read=lambda r: r["originalId"]).with_(f.vote())
    got = {r.cluster_id: r for r in f.fuse(people(spark), "cluster_id", m, arrival_col="arrival").collect()}
    assert got[1].fused.id == "id2" and got[1].fused.n == 60 and got[1].fused.none is None
    assert f.fuse(people(spark).limit(0), "cluster_id", m).count() == 0
    assert f.accept_complete(f.fuse(people(spark), "cluster_id", person.merging(), "source", "lastModified", "arrival")).count() == 1


def test_group_values(spark):
    df = people(spark)
    g = f.group_values(df, "cluster_id", "lastName", ["arrival"], "source", ts="lastModified")
    got = {r.cluster_id: [v.value for v in r.vals] for r in g.collect()}
    assert got == {1: ["Doe", "Smith"], 2: [""]}


def test_aggregated_fields(spark):
    df = people(spark)
    fields = {"a": ("firstName", "longest"), "b": ("firstName", "shortest"), "c": ("lastName", "first"), "d": ("lastName", "last"), "e": ("lastName", "latest"), "f": ("lastName", "earliest"), "g": ("gender", "vote"), "h": ("id", "min"), "i": ("id", "max"), "j": ("arrival", "sum"), "k": ("arrival", "mean"), "n": ("gender", "count")}
    got = {r.cluster_id: tuple(r)[1:] for r in f.aggregate_fields(df, "cluster_id", fields, "source", "lastModified", "arrival", {"source2": 2.0}).collect()}
    assert got[1] == ("Joanna", "John", "Doe", "Smith", "Doe", "Smith", "MALE", "id1", "id2", 1, 0.5, 2)
    assert got[2] == ("Ann", "Ann", None, None, None, None, None, "id3", "id3", 2, 2.0, 0)
    assert f.aggregate_fields(df, "cluster_id", {"g": ("gender", "most_frequent")}).count() == 2
    with pytest.raises(ValueError):
        f.aggregate_fields(df, "cluster_id", {"g": ("gender", "union")})

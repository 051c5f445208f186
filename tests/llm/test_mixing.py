import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing
from tests.llm.conftest import ODD


def targets(sizes):
    """By sharing the excess anew until no target is above its stop."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: Fraction(mixing.WEIGHTS[i % 3]) for i, s in enumerate(names)}
    left, out, free = Fraction(sum(sizes.values())), {}, set(names)
    while free:
        total = sum(weight[s] for s in free)
        stopped = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not stopped:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in stopped:
            out[s] = Fraction(3 * sizes[s])
        left -= sum(out[s] for s in stopped)
        free -= stopped
    return {s: float(out.get(s, 0)) for s in names}


def table(spark, n=700, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "é", "z", "B", None, "tiny" if i % 50 == 0 else "a"])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 200]) if i else 900)), source, "x"))
    rows += [(n, None, "b", "x"), (n + 1, "\t  w\x0bq ", "b", "x"), (n + 2, "same", "b", "x"), (n + 2, "same", "b", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, u string")


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows, df = table(spark, seed=seed)
    got = mixing.mix(df, seed=seed).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    total = {}
    for i, _, s, _ in rows:
        total[s] = total.get(s, 0) + size[i]
    want = targets(total)
    taken, largest = {}, {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 and (r["size"] or not r.copies)
        rate = r.target / r.source_size if r.source_size else 0
        assert not r["size"] or rate - 1 < r.copies < rate + 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s in total:
        assert abs(taken[s] - want[s]) <= largest[s], s
    again = mixing.mix(df.repartition(7), seed=seed).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = mixing.apply_mix(df, seed=seed)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in got)


def test_expectations(spark):
    """Each row is taken as often as its source's rate says: 300 copies of a table under keys of their own are 300 draws of every row."""
    n = 300
    units = spark.createDataFrame([(i, s) for i, s in enumerate([1, 1, 2, 3, 5, 8, 40, 40, 100, 7, 7, 3])], "i int, size long")
    drawn = spark.range(n).crossJoin(units).selectExpr("id AS g", "i", f"named_struct('size', size, 'u', (xxhash64(id, i) & {(1 << 52) - 1}) / {float(1 << 52)}, 'doc_id', i, 'tie', 0L, 'occ', 1, 'p', 0.3D) AS x")
    gathered = drawn.groupBy("g").agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("units"))
    for form, p in ((mixing._leaf, 0.3), (mixing._fold, 0.3)):
        f = gathered.select(F.expr(form("units", "int")).alias("f")).select(F.expr("concat(f.done, array(f.cur))").alias("x"))
        rows = f.select(F.explode("x").alias("x")).groupBy("x.doc_id").agg(F.avg("x.p").alias("p"), F.count("*").alias("n")).collect()
        assert len(rows) == 12 and all(r.n == n and abs(r.p - p) < 4 * (p * (1 - p) / n) ** 0.5 for r in rows), (form, rows)
        sums = f.select(F.expr("aggregate(x, 0D, (t, v) -> t + v.size * v.p)").alias("t")).agg(F.min("t"), F.max("t")).first()
        assert sums[0] == pytest.approx(0.3 * 217) and sums[1] == pytest.approx(0.3 * 217)


def test_many_equal_rows_and_many_sources(spark, monkeypatch):
    same = [(None, "the same words again", "a", i) for i in range(70)] + [(1, "w " * 50, "b", i) for i in range(9)] + [(2, "w", "b", 0), (3, "", "a", 0)]
    rows = same + [(10 + i, "x y " * (i % 7 + 1), f"s{i % 40}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(6)
    want = sorted(map(str, mixing.mix(df).collect()))
    times = {}
    for r in mixing.apply_mix(df).collect():
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    by = {}
    for r in mixing.mix(df).collect():
        by[r.doc_id, r.tie] = by.get((r.doc_id, r.tie), 0) + r.copies
    assert sorted(times.values()) == sorted(v for v in by.values() if v)
    monkeypatch.setattr(mixing, "BLOCK", 8)
    assert sorted(map(str, mixing.mix(df).collect())) == want
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    assert sorted(map(str, mixing.mix(df).collect())) == want
    assert mixing.apply_mix(df).count() == sum(times.values())


def test_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD)
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    assert mixing.apply_mix(odd).columns == odd.columns
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

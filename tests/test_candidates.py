import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import candidates as c


def naive_online(rows, window):
    """Records one by one against a sorted index."""
    half, seen, out = window // 2, [], set()
    for i, key, arrival in sorted(rows, key=lambda r: r[2]):
        if key is None:
            continue
        down = sorted((r for r in seen if r[1] <= key), key=lambda r: r[2])
        down = sorted(down, key=lambda r: r[1], reverse=True)[:half]
        up = sorted(sorted((r for r in seen if r[1] >= key), key=lambda r: r[2]), key=lambda r: r[1])[:half]
        out |= {(i, r[0]) for r in down + up}
        seen.append((i, key, arrival))
    return out


def naive_offline(rows, window):
    order = sorted((k, i) for i, k, _ in rows if k is not None)
    return {(max(a[1], b[1]), min(a[1], b[1])) for x, a in enumerate(order) for b in order[x + 1 : x + window]}


@pytest.mark.parametrize("n,keys,window,how", [(60, 12, 4, "mixed"), (90, 90, 7, "mixed"), (80, 80, 6, "rising"), (80, 2, 5, "mixed"), (70, 70, 2, "falling"), (0, 1, 4, "mixed")])
def test_sorted_neighbourhoods(spark, n, keys, window, how):
    rng = random.Random(n * window)
    arrivals = list(range(n))
    rng.shuffle(arrivals)
    rows = [(i, None if rng.random() < 0.05 else rng.randrange(keys) if how == "mixed" else i if how == "rising" else n - i, arrivals[i] if how == "mixed" else i) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, key long, arrival long")
    key = [c.sorting_key("k", "key")]
    got = c.online_sorted_neighborhood(df, key, default_window=window).collect()
    assert {tuple(r) for r in got} == naive_online(rows, window) and len(got) == len({tuple(r) for r in got})
    got = c.sorted_neighborhood(df, key, default_window=window).collect()
    assert {tuple(r) for r in got} == naive_offline(rows, window) and len(got) == len({tuple(r) for r in got})


def test_passes_and_keys(spark):
    with pytest.raises(ValueError):
        c.Pass(c.sorting_key("k", "a"), 1)
    assert [p.window for p in c.passes([c.sorting_key("k", "a"), (c.sorting_key("l", "b"), 3)])] == [10, 3]
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x")], "id long, a string, b string")
    pairs = c.sorted_neighborhood(df, [c.sorting_key("k", "a").and_("b"), c.sorting_key("k", "b")], default_window=2)
    assert [tuple(r) for r in pairs.collect()] == [(3, 2)]
    joined = c.with_records(pairs, df)
    assert joined.select("left.a", F.col("right.a").alias("r")).first() == ("b", "a")
    assert {r.rank for r in c.global_rank(df, ["a", "id"]).collect()} == {0, 1, 2}


def test_keys_that_end_in_long_texts(spark):
    rng = random.Random(3)
    heads = ["", "a", "\u00e4" * c.HEAD, "a" * c.HEAD, "a" * (c.HEAD - 1) + "\U0001f600", "a" * (c.HEAD - 1)]
    texts = [h + t for h in heads for t in ("", "a", "b", "ab" * c.HEAD, "\uffff", "\U0001f600")]
    rows = [(i, rng.choice(["x", "xy"]), rng.choice(texts)) for i in range(400)] + [(400, None, "a"), (401, "x", None)]
    df = spark.createDataFrame(rows + rows[:5], "id long, lang string, text string")
    key = c.sorting_key("k", "lang", "text")
    ranked = c.key_rank(df.select("id", key.column().alias("key")).where("key is not null"))
    got = [r.id for r in ranked.orderBy("rank").collect()]
    whole = sorted((r[1].encode(), r[2].encode(), r[0]) for r in [*rows[:400], *rows[:5]])
    assert got == [r[2] for r in whole]
    assert c.sorted_neighborhood(df.limit(0), [key]).count() == 0
    pairs = c.sorted_neighborhood(df, [key], default_window=3)
    order = [r[2] for r in whole]
    want = {(max(a, b), min(a, b)) for x, a in enumerate(order) for b in order[x + 1 : x + 3] if a != b}
    assert {tuple(r) for r in pairs.collect()} == want

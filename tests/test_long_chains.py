"""Queries on clusters over customers that form one long chain in no order of ids."""

import random

import pytest

from kinfold.plans import catalog

QUERIES = ["cluster_ids_prefix", "transitive_closure", "refined_closure", "consistent_clustering", "changed_clusters", "cluster_ids_number", "cluster_sizes", "cluster_split_events"]
N = 400


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("chain"))
    ids = random.Random(1).sample(range(1, 10 * N), N)
    rows = [(i, 7, 10.0 + 2 * n, "BUILDING" if n % 2 else "MACHINERY") for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    return d, sorted(ids)


@pytest.mark.parametrize("name", QUERIES)
def test_one_chain(spark, chain, name):
    """The estimated size of the result had thousands of digits, twice as many with every round."""
    d, ids = chain
    out = catalog.QUERIES[name](spark, d)
    assert len(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 200
    rows = out.collect()
    if name == "cluster_sizes":
        assert [(r.cluster_id, r.n, r.records) for r in rows] == [(ids[0], N, ",".join(map(str, ids)))]
    elif name == "cluster_split_events":
        assert rows == []  # one nation, one cluster
    else:
        assert sorted(r.record_id for r in rows) == ids
        if name != "refined_closure":
            assert {r.cluster_id for r in rows} == {{"cluster_ids_prefix": "c0", "cluster_ids_number": 0}.get(name, ids[0])}

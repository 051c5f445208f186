from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from kinfold.llm import registry

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@needs_data
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name in ("toxicity", "ngram_jaccard_join"):
            assert 0.7 * n < out.count() < n
            n = out.count()
        if name == "pii":
            assert out.count() == n
        docs = out
    assert corpus_pipeline.run(spark, str(DATA)).count() == docs.count()


@needs_data
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    rel = con.sql(registry.oracle_sql()[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(str(tuple(r[at[c]] for c in cols)) for r in rel.fetchall())


@needs_data
def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    more = odd.select("*", odd.row.alias("_row"), odd.row.alias("_key"), odd.row.alias("kept"), odd.row.alias("id"), odd.row.alias("copies"), odd.row.alias("_text"))
    for docs in (more, more.limit(0)):
        n = docs.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(DATA))
            if k < 4:
                assert out.columns == more.columns, name
            else:
                assert {"doc_id", "start", "sequence_id"} <= set(out.columns)
            rows = out.count()
            assert (rows > 0) == (n > 0) and (name != "pii" or rows == n)


def test_registry():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize(("stage", "most"), [("ngram_jaccard_join", 1), ("mixing", 2)])
def test_stages_leave_few_files_of_small_tables(spark, tmp_path, stage, most):
    """Each file of a lineage cut is four processes of the executor's on a local file system; at most so many tables have one a shuffle partition."""
    rows = [(i, " ".join(f"w{i // 3 if j < 90 else i}x{j}" for j in range(100)), "en", "abc"[i % 3], 0) for i in range(60)]
    sc, named = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        kept = dict(corpus_pipeline.STAGES)[stage](spark, df, str(tmp_path)).collect()
        files = len(list(tmp_path.rglob("part-*")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", named)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        if before:
            sc._jsc.sc().setCheckpointDir(before.rsplit("/", 1)[0])
    assert stage == "mixing" or {r.doc_id for r in kept} == {i for i in range(60) if i % 3 == 0}
    assert kept
    assert files < most * 40, files

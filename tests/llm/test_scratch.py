"""Shuffle files of a step that was written."""

from pathlib import Path

from rillwork.llm.jaccard_join import without_near_duplicates


def test_shuffle_files_of_written_steps_are_freed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    local = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p: p.stat().st_size for d in local for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    kept = without_near_duplicates(docs)
    assert sum(n for p, n in files().items() if p not in before) < 10_000
    assert 0 < kept.count() < docs.count()

"""Stages of the pipeline begin with small heaps."""

import corpus_pipeline
from lectern.llm import common


def test_executors_collect_garbage(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    common.shrink(spark)
    assert full() > before


def test_every_stage_shrinks_first(spark, sf_dir, monkeypatch):
    seen = []

    def stop(spark):
        seen.append(spark)
        raise InterruptedError

    monkeypatch.setattr(corpus_pipeline, "shrink", stop, raising=False)
    for _, stage in corpus_pipeline.STAGES:
        try:
            stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), sf_dir)
        except InterruptedError:
            pass
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]
    assert len(seen) == len(corpus_pipeline.STAGES)


def test_driver_gives_back_after_each_table(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    for work in (lambda: common.saved(spark.range(3), "three"), lambda: common.lighten(spark)):
        before = full()
        work()
        assert full() > before
    assert "rim" in (common.trim_native(spark) or "no trim in this JVM")

from tallywell.llm import common


def test_staging_collects_the_drivers_garbage_once_its_heap_is_large(spark, monkeypatch):
    """Whole collections, after which the heap shrinks: one for a heap over the share, none below it."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]

    def collections_at(share):
        monkeypatch.setattr(common, "HEAP_SHARE", share, raising=False)
        before = sum(b.getCollectionCount() for b in whole)
        assert common.stage(spark.range(10), "few").count() == 10
        return sum(b.getCollectionCount() for b in whole) - before

    assert collections_at(0.0) >= 1
    assert collections_at(1.0) == 0

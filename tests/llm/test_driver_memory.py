"""What long runs of small jobs leave in the driver's JVM."""

from corvane.llm import common, near_dedup


def test_the_jvm_gives_freed_memory_back(spark):
    assert "native heap" in common.trim_driver(spark).lower()


def test_near_duplicates_collect_garbage_after_each_verdict(spark, monkeypatch):
    seen = []
    collect, judge = near_dedup.collect_garbage, near_dedup._Links.judge
    monkeypatch.setattr(near_dedup, "collect_garbage", lambda s: (seen.append("collect"), collect(s)))
    monkeypatch.setattr(near_dedup._Links, "judge", lambda *a: (judge(*a), seen.append("judged"))[0])
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, text + " and"), (4, "another one")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.component_id) for r in rows] == [(1, 1), (2, 1), (3, 1), (4, 4)]
    ends = [i for i, x in enumerate(seen) if x == "judged"]
    assert ends and all(i and seen[i - 1] == "collect" for i in ends)

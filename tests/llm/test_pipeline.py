"""The pipeline: each stage against brute force on its own input."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from corvane.llm import queries, toxicity

from . import data


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, s) for i, t, s in data.texts() if i not in (20, 21, 22, 30)] + [(100 + i, f"{'idiot moron ' * 3 if i % 3 == 0 else 'kind calm '}{data.words(500 + i, 40)}", "abc"[i % 3]) for i in range(200)]
    data.frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 3 == 0), 1) for i in range(200)], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, data.words(3, 30)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]

    clean = corpus_pipeline.STAGES[0][1](spark, docs, tables).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    assert {r["doc_id"] for r in clean.collect()} == want and all(100 + i not in want for i in range(0, 200, 3))

    distinct = corpus_pipeline.STAGES[1][1](spark, clean, tables).cache()
    classes = data.near_classes([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(d for d, c in classes.items() if d == c)

    left = corpus_pipeline.STAGES[2][1](spark, distinct, tables).cache()
    items = [(1, data.words(3, 30))]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in distinct.collect() if not data.contamination(r["text"], items)[1])
    assert left.count() < distinct.count()

    mixed = corpus_pipeline.STAGES[3][1](spark, left, tables).cache()
    for df in (clean, distinct, left, mixed):
        assert df.columns == columns
    words = lambda df: df.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0]
    assert abs(words(mixed) - words(left)) < 0.05 * words(left)

    tokens = corpus_pipeline.STAGES[4][1](spark, mixed, tables).collect()
    assert len(tokens) == mixed.count()
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = sorted((r["doc_id"], zlib.crc32(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in mixed.collect())
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in tokens) == want


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 50 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)


def test_run_on_nothing(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    numbers = sorted(int(k[2:].split("_")[0]) for k in entry.queries() if k[:2] == "op" and k[2].isdigit())
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries() and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


def test_near_dedup_stage_links_from_080(spark):
    rows, alike = [], {}
    for i, (length, edits) in enumerate([(60, 1), (120, 2), (124, 2), (190, 3), (250, 5), (260, 5), (700, 13), (80, 2), (100, 3)] * 4):
        base = [f"w{i}x{k}" for k in range(length)]
        near = list(base)
        for e in range(edits):
            near[5 + e * (length - 10) // edits] = f"e{i}x{e}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        a, b = data.shingles(rows[-2][1]), data.shingles(rows[-1][1])
        alike[2 * i + 1] = 100 * len(a & b) / len(a | b)
    want = [d for d, _ in rows if alike.get(d, 0) < 80]
    assert sum(80 <= x < 85 for x in alike.values()) >= 12 and any(x < 80 for x in alike.values())
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want

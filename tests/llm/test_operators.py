"""The ten operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import math
import random
import re
import shutil
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate, fingerprint, mixing, near_dedup, queries, repeats, shard_pack, token_counts, token_store, toxicity, url_rules

from ..conftest import SF
from . import data

ALL = [(d, t) for d, t, _ in data.with_nulls()]


def collected(df):
    return [tuple(r) for r in df.collect()]


def sorted_rows(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return data.frame(spark).cache()


@pytest.fixture(scope="module")
def nulls(spark):
    return data.frame(spark, data.with_nulls()).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return data.frame(spark, [])


# ---- 1: token store -------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return path, t


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_token_store_round_trip(spark, nulls, tokenizer, tmp_path):
    path, t = tokenizer
    store = f"file://{tmp_path}/store"
    token_store.write_store(nulls, store, path)
    want = sorted(((-1 if d is None else d, encoded(t, x)) for d, x in ALL), key=lambda r: r[0])
    got = sorted((tuple(r) for r in token_store.verify(spark, store).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert [-1 if g[1] is None else g[1] for g in got] == [d for d, _ in want]
    crcs = sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    assert sorted((-1 if g[1] is None else g[1], g[2], g[3]) for g in got) == crcs
    ids = collected(token_store.read_ids(spark, store))
    assert sorted((-1 if d is None else d, list(i)) for d, _, i in ids) == sorted((d, i) for d, i in want)
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    stored, total = chunks.selectExpr("sum(n)").first()[0], sum(len(i) for _, i in want)
    assert stored < total  # copies and shared passages are stored once
    manifest = spark.read.parquet(f"{store}/manifest")
    assert manifest.selectExpr("sum(n_docs)", "sum(n_tokens)").first() == (len(want), total)


def test_token_store_sees_damage(spark, docs, tokenizer, tmp_path):
    store = f"file://{tmp_path}/store"
    token_store.write_store(docs, store, tokenizer[0])
    chunks = spark.read.parquet(f"{store}/chunks").cache()
    kept = chunks.orderBy("digest").limit(chunks.count() - 1).collect()
    spark.createDataFrame(kept, chunks.schema).write.mode("overwrite").parquet(f"{store}/chunks")
    with pytest.raises(Exception, match="missing"):
        token_store.verify(spark, store).collect()
    other = [(r["digest"], r["n"], r["width"], r["uses"], kept[0]["data"]) for r in kept]
    spark.createDataFrame(other, chunks.schema).write.mode("overwrite").parquet(f"{store}/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_chunks(spark, store).collect()


@pytest.fixture(scope="module")
def packs(spark, docs, tokenizer, tmp_path_factory):
    """A store of several packs."""
    store = tmp_path_factory.mktemp("store") / "s"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_store(docs, f"file://{store}", tokenizer[0])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return store


def test_token_store_files_ascend(spark, packs):
    files = sorted(f for f in (packs / "docs").iterdir() if f.name.startswith("part-"))
    rows = [r["doc_id"] for f in files for r in pq.read_table(f).to_pylist()]
    assert len(files) > 1 and rows == sorted(rows) and len(rows) == len(data.texts())
    assert sorted(x.name for x in packs.iterdir()) == ["chunks", "docs", "manifest", "top"]


@pytest.mark.parametrize("lost", ["row", "pack", "file", "pack and manifest", "manifest", "top", "order"])
def test_token_store_sees_lost_files(spark, packs, tmp_path, lost):
    store = tmp_path / "s"
    shutil.copytree(packs, store)
    assert token_store.verify(spark, f"file://{store}").count() == len(data.texts())
    docs, manifest = (spark.read.parquet(f"file://{packs}/{x}") for x in ("docs", "manifest"))
    last = docs.selectExpr("max(pack)").first()[0]
    if lost == "file":
        for f in [f for f in (store / "docs").iterdir() if f.name.endswith(".parquet")][:1]:
            f.unlink()
            (store / "docs" / f".{f.name}.crc").unlink(missing_ok=True)
    if lost == "row":
        docs.where("NOT (pack = 0 AND seq = 1)").write.mode("overwrite").parquet(f"file://{store}/docs")
    if lost == "order":
        docs.withColumn("seq", F.when(F.col("pack") == 0, 1 - F.col("seq")).otherwise(F.col("seq"))).write.mode("overwrite").parquet(f"file://{store}/docs")
    if "pack" in lost:
        docs.where(f"pack < {last}").write.mode("overwrite").parquet(f"file://{store}/docs")
    if lost == "pack and manifest":
        manifest.where(f"pack < {last}").write.mode("overwrite").parquet(f"file://{store}/manifest")
    if lost in ("manifest", "top"):
        shutil.rmtree(store / lost)
    with pytest.raises(Exception, match="differs from|PATH_NOT_FOUND"):
        token_store.verify(spark, f"file://{store}").collect()


def test_token_store_answers_frequent_chunks(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FREQUENT", 4)
    rows = [(i, ["", "the very same text", data.words(i, 30)][i % 3 if i < 3000 else 2], "s") for i in range(3100)]
    token_store.write_store(data.frame(spark, rows), f"file://{tmp_path}/s", tokenizer[0])
    got = sorted(collected(token_store.verify(spark, f"file://{tmp_path}/s").select("doc_id", "n_tokens", "ids_crc32")))
    ids = {t: encoded(tokenizer[1], t) for _, t, _ in rows}
    assert got == [(d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t, _ in rows]


def test_encoder_on_random_strings(tokenizer):
    path, t = tokenizer
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "Bc", "1", "é", ".", ",", "\n", " ", " ", "'s", "!", "α", "\t", "²", "<|endoftext|>", "\x1e", "\u00a0"]) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    encode = token_store.Encoder(path, remember=500)
    for some in (texts[:100], texts[100:], texts):
        assert [np.frombuffer(r, "<u4").tolist() for r in encode(some)] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]


def test_chunks_follow_content_not_place():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 50_000, 9000)
    a, b = np.concatenate([rng.integers(0, 50_000, 777), shared]).astype("<u4"), np.concatenate([rng.integers(0, 50_000, 1500), shared]).astype("<u4")

    def chunks(x):
        ends = token_store.cut_points(token_store.cut_marks(x).tolist(), len(x))
        assert ends[-1] == len(x) and max(np.diff([0, *ends])) <= token_store.MOST
        return {x[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)}

    assert len(chunks(a) & chunks(b)) >= 5
    assert token_store.cut_points([], 10_000) == [4096, 8192, 10_000] and token_store.cut_points([], 0) == []


def test_crc_combination():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 7, 1000, 33)]
    n = np.array([len(p) for p in parts])
    bare = token_store.crc_bare(np.array([zlib.crc32(p) for p in parts], np.uint32), n)
    rest = n.sum() - np.cumsum(n)
    whole = np.bitwise_xor.reduce(token_store.crc_shift(bare, rest))
    assert token_store.crc_whole(np.array([whole]), np.array([n.sum()]))[0] == zlib.crc32(b"".join(parts))


def test_merkle_depends_on_every_leaf_and_order():
    leaves = [bytes([i]) * 16 for i in range(7)]
    roots = {token_store.merkle(leaves), token_store.merkle(leaves[::-1]), token_store.merkle(leaves[:-1]), token_store.merkle([]), token_store.merkle([*leaves[:3], b"x" * 16, *leaves[4:]])}
    assert len(roots) == 5


# ---- 2: decontamination ---------------------------------------------------------------------------------------------
ITEMS = [(1, data.words(3, 70)), (2, "one TWO three"), (3, data.words(99, 40)), (4, None), (5, "  ,. "), (None, data.words(2, 30)), (6, "x1"), (6, "日本"), (7, data.words(1, 12))]


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_decontamination(spark, nulls, block):
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, n_words int")
    got = collected(decontaminate.scan(nulls, bench, block_bytes=block).select("doc_id", "n_words", "n_hit", "items"))
    want = [(d, *data.contamination(t, ITEMS)) for d, t in ALL]
    assert sorted_rows((d, a, b, list(c)) for d, a, b, c in got) == sorted_rows((d, a, b, c) for d, a, b, c in want)


def test_decontamination_spans_are_in_the_original(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = {d: t for d, t, _ in data.texts()}
    for r in decontaminate.scan(docs, bench).collect():
        found = "".join(" " + texts[r["doc_id"]][a:b] for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True))
        assert len(decontaminate.normal_words(found)) == r["n_hit"]


def test_decontamination_without_items_or_documents(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.scan(docs, none).collect()} == {0}
    assert decontaminate.scan(nothing, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


def test_drop_contaminated_in_blocks(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench, block_bytes=600)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, t, _ in data.texts() if not data.contamination(t, ITEMS)[1])
    assert kept.columns == docs.columns and kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


# ---- 3: sharding ----------------------------------------------------------------------------------------------------
def check_shards(rows, texts, shards):
    by: dict = {}
    for d, size, crc, tokens, shard, slot in rows:
        assert 0 <= shard < shards
        by.setdefault(shard, []).append((slot, size))
    for own in by.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    assert sorted_rows((d, s, c) for d, s, c, *_ in rows) == sorted_rows((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    return by


def test_shards(spark, docs):
    texts = [(d, t) for d, t, _ in data.texts()]
    check_shards(collected(shard_pack.pack(docs, 4)), texts, 4)


def test_shards_balance_and_keep_groups(spark):
    rng = random.Random(4)
    rows = [(i, data.words(i % 700, rng.randint(1, 40) + (i % 700) % 50), "s") for i in range(2500)] + [(9000 + i, "the same text " * 9, "s") for i in range(100)]
    texts = [(d, t) for d, t, _ in rows]
    got = collected(shard_pack.pack(data.frame(spark, rows), 8))
    by = check_shards(got, texts, 8)
    sizes = [sum(x for _, x in own) for own in by.values()]
    assert max(sizes) < 1.01 * min(sizes)
    tokens: dict = {}
    for r in got:
        tokens[r[4]] = tokens.get(r[4], 0) + r[3]
    assert max(tokens.values()) < 1.1 * min(tokens.values())
    counts = [len(own) for own in by.values()]
    assert max(counts) < 1.4 * min(counts)
    where: dict = {}
    text = dict(texts)
    for r in got:
        where.setdefault(text[r[0]], set()).add(r[4])
    assert max(map(len, where.values())) == 1


def shards_by_brute_force(texts, shards, cells):
    """doc_id -> shard: groups by text, the large ones first, then those of each cell. cells: of each text."""
    groups: dict = {}
    for d, t in texts:
        groups.setdefault(t, []).append(d)
    vectors = {t: [(len((t or "").encode()) + 1) * len(own), len((t or "").split()) * len(own), len(own)] for t, own in groups.items()}
    total = [max(1.0, sum(v[i] for v in vectors.values())) / shards for i in range(3)]
    part = {t: max(x / y for x, y in zip(v, total, strict=True)) for t, v in vectors.items()}
    name = {t: hashlib.sha256(t.encode()).hexdigest() if t is not None else b"null".hex() for t in groups}
    order = sorted(groups, key=lambda t: (-part[t], name[t]))
    where = {}

    def put(some, scale, room, turn, last):
        left = sum(vectors[t][0] / scale[0] for t in some)
        for t in some:
            v = [x / y for x, y in zip(vectors[t], scale, strict=True)]
            gain = lambda s: sum(a * b for a, b in zip(room[s], v, strict=True)) if left > last else room[s][0]  # noqa: B023, E731
            at = max((s for s in range(shards)), key=lambda s: (round(gain(s), 12), -((s - turn) % shards)))
            where[t], left = at, left - v[0]
            room[at] = [a - b for a, b in zip(room[at], v, strict=True)]

    room = [[1.0] * 3 for _ in range(shards)]
    put([t for t in order if part[t] > shards / shard_pack.LARGE], total, room, 0, 0.0)
    free = [[max(0.0, x) for x in r] for r in room]
    sums = [max(1e-12, sum(r[i] for r in free)) for i in range(3)]
    free = [[x / y for x, y in zip(r, sums, strict=True)] for r in free]
    for c in sorted(set(cells.values())):
        some = [t for t in order if part[t] <= shards / shard_pack.LARGE and cells[t] == c]
        scale = [max(1e-12, float(sum(vectors[t][i] for t in some))) for i in range(3)]
        put(some, scale, [list(r) for r in free], c, shard_pack.LAST)
    return {d: where[t] for t, own in groups.items() for d in own}


@pytest.mark.parametrize("cell", [8192, 200])
def test_shards_by_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(shard_pack, "CELL_GROUPS", cell)
    rows = [(i, data.words(i % 900, 1 + (i % 900) % 37), "s") for i in range(1100)] + [(5000 + i, None, "s") for i in range(30)] + [(6000, data.words(1, 4000), "s")]
    texts = [(d, t) for d, t, _ in rows]
    count = max(1, len({t for _, t in texts}) // cell)
    keys = spark.createDataFrame([(t,) for t in {t for _, t in texts}], "t string").selectExpr("t", f"pmod(xxhash64(coalesce(unhex(sha2(t, 256)), cast('null' as binary)), 0), {count}) c")
    got = {r["doc_id"]: r["shard"] for r in shard_pack.pack(data.frame(spark, rows), 8).collect()}
    assert got == shards_by_brute_force(texts, 8, dict(collected(keys)))


def test_shards_split_a_group_that_is_larger_than_a_shard(spark):
    rows = [(i, "hot " * 20, "s") for i in range(900)] + [(1000 + i, data.words(i, 30), "s") for i in range(900)]
    by = check_shards(collected(shard_pack.pack(data.frame(spark, rows), 8)), [(d, t) for d, t, _ in rows], 8)
    sizes = [sum(x for _, x in own) for own in by.values()]
    assert max(sizes) < 1.2 * min(sizes)


def test_shards_of_nulls_and_nothing(spark, nulls, nothing):
    check_shards(collected(shard_pack.pack(nulls)), ALL, 16)
    assert shard_pack.pack(nothing).count() == 0


def test_shards_written(spark, docs, tmp_path):
    shard_pack.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted_rows(collected(back.select(docs.columns))) == sorted_rows(collected(docs))
    by: dict = {}
    for r in back.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


# ---- 4: near duplicates ---------------------------------------------------------------------------------------------
def test_near_duplicates(spark, docs):
    rows = [(d, t) for d, t, _ in data.texts()]
    want = data.near_classes(rows)
    got = collected(near_dedup.near_duplicates(docs))
    assert sorted_rows(got) == sorted_rows((d, len(data.shingles(t)), want[d], want[d] == d) for d, t in rows)


def variants(n, length, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(length)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = f"e{rng.randint(0, 10_000)}"
        out.append((seed * 1000 + i, " ".join(own)))
    return out


def test_near_duplicates_in_large_groups(spark):
    rows = [*variants(150, 200, 5, 1), *variants(60, 60, 2, 2), *variants(30, 800, 20, 3), (5, "just this"), (6, "just this")]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == data.near_classes(rows)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Hubs, hot keys and cells of several blocks; a group of near copies costs about its number of confirmations."""
    judged = []
    confirm = near_dedup._confirm
    monkeypatch.setattr(near_dedup, "_confirm", lambda pairs, *a: judged.append(pairs.count()) or confirm(pairs, *a))
    for k, v in (("BLOCK", 8), ("FEW", 20), ("HOT", 8), ("CELL_ROWS", 64)):
        monkeypatch.setattr(near_dedup, k, v)
    rows = [*variants(120, 150, 2, 7), *variants(40, 150, 16, 8)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == data.near_classes(rows)
    assert sum(judged) <= 4 * len(rows)


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 400)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(250)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_near_duplicates_of_nulls_and_nothing(spark, nulls, nothing):
    classes = data.near_classes([(d, t) for d, t, _ in data.texts()])
    want = [(d, len(data.shingles(t)), classes.get(d), d == classes.get(d)) for d, t in ALL]
    assert sorted_rows(collected(near_dedup.near_duplicates(nulls))) == sorted_rows(want)
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.one_of_each(nulls)
    assert kept.columns == nulls.columns
    assert sorted_rows((r["doc_id"],) for r in kept.collect()) == sorted_rows([(d,) for d, c in classes.items() if d == c] + [(None,)] * 2)
    assert near_dedup.one_of_each(nothing).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("corvane_")]


def test_one_of_each_keeps_one_row_of_a_class(spark):
    long, near = data.words(77, 100), data.words(77, 100) + " end"
    rows = [(1, long), (1, near), (1, long), (2, near), (None, data.words(78, 50)), (None, data.words(78, 50)), (None, data.words(78, 50) + " x"), (3, ""), (3, None), (3, "")]
    kept = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted_rows((r["doc_id"], len(r["text"] or "") > 0) for r in kept) == sorted_rows([(1, True), (None, True), (3, False), (3, False)])


def test_sketches_never_reject_links():
    rng = random.Random(8)
    for n in (5, 30, 200, 1500):
        for _ in range(40):
            a = rng.sample(range(10**9), n)
            b = a[: max(1, int(n * 0.95))] + rng.sample(range(10**9, 2 * 10**9), n // 25)
            x, y = (np.unique(near_dedup.mix64(np.array(s, np.uint64))) for s in (a, b))
            if near_dedup.linked(x, y):
                sketch = [np.frombuffer(near_dedup.odd_sketch(near_dedup.minhashes(s)), np.uint64) for s in (x, y)]
                whole = [np.frombuffer(near_dedup.set_sketch(s), np.uint64) for s in (x, y)]
                i, _, _ = near_dedup.allowed_pairs(np.array([len(x), len(y)]), np.array(sketch), np.array(whole), np.array([0]), np.array([1]), np.array([0, 1]))
                assert len(i) == 1


# ---- 5: token counts ------------------------------------------------------------------------------------------------
def unigram(byte_fallback):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if byte_fallback or not model.is_byte(i)]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return public_tokenizers.path("piece_bpe_32k.model"), t


def test_token_counts(spark, nulls):
    _, t = unigram(True)
    got = collected(token_counts.count_tokens(nulls).select("doc_id", "n_tokens"))
    assert sorted_rows(got) == sorted_rows((d, len(t.encode(x or "").ids)) for d, x in ALL)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_token_counts_on_random_strings(byte_fallback):
    path, t = unigram(byte_fallback)
    v = token_counts.Vocabulary.read(path)
    counter = token_counts.Counter(token_counts.Vocabulary(v.pieces, byte_fallback), remember=50)
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "the", "in", "g", "é", "梦", "😀", "☃", " ", "  ", "▁", "\n", "x", "-", "0"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert counter(texts)[0].tolist() == [len(e.ids) for e in t.encode_batch(texts)]


def test_token_count_ties():
    # ab+c and a+bc score alike; the longer last piece that starts earlier wins only if it is strictly better
    v = token_counts.Vocabulary({"▁": 0.0, "a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -3.0}, False)
    assert v.count("▁abc") == (2, -3.0)


def test_token_counts_of_nothing(nothing):
    assert token_counts.count_tokens(nothing).count() == 0


# ---- 6: repeated passages -------------------------------------------------------------------------------------------
def test_repeats(spark, nulls):
    got = collected(repeats.repeated(nulls).drop("spans"))
    assert sorted_rows(got) == sorted_rows(data.repeats(ALL))


def test_repeats_across_batches(spark, monkeypatch):
    rng = random.Random(10)
    shared = [data.words(100 + i, 25) for i in range(6)]
    rows = [(i, " ".join(rng.choice([shared[rng.randrange(6)], data.words(1000 + i * 7 + j, 9)]) for j in range(rng.randint(1, 6)))) for i in range(120)]
    rows += [(200 + i, "ab" * 300) for i in range(3)] + [(300, "é" * 60), (301, "x" + "é" * 60)]
    monkeypatch.setattr(repeats, "BATCH", 4000)
    monkeypatch.setattr(repeats, "SEGMENT", 512)
    got = collected(repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("spans"))
    assert sorted_rows(got) == sorted_rows(data.repeats(rows))


def test_repeat_spans(spark):
    rows = [(1, "p" * 10 + data.words(50, 30)), (2, "other start " + data.words(50, 30) + " end")]
    r = repeats.repeated(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").first()
    a, b = r["spans"]
    assert rows[1][1].encode()[a:b] in rows[0][1].encode() and r["n_removed"] == b - a


def test_repeats_of_nothing(nothing):
    assert repeats.repeated(nothing).count() == 0


def test_run_index_against_brute_force():
    rng = random.Random(11)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(40, 70))) for _ in range(40)]
    strings += [s[5:] + b"a" for s in strings[:10]] + [strings[0]] * 3 + [b"a" * 76]
    owner = np.array([rng.randrange(1000) for _ in strings])
    index = repeats.RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings]))
    assert len(index.run_start) < index.n / 2 and len(index.run_end_sample) == len(index.run_start)
    got = index.least_by_window(owner, 27)
    for i, s in enumerate(strings):
        for j in range(27):
            w = s[j : j + 50]
            want = min((int(owner[k]) for k, x in enumerate(strings) if w in x), default=None) if len(w) == 50 else np.iinfo(np.int64).max
            assert got[i, j] == want


# ---- 7: mixing ------------------------------------------------------------------------------------------------------
def fixed_point(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        share = {s: target[s] + left * w[s] / total for s in free}
        left = 0.0
        for s in list(free):
            if share[s] > most * sizes[s]:
                left += share[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
            else:
                target[s] = share[s]
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 3, "c": 10, "é": 50, "Z": 0, None: 7}, {None: 5}, {"x": 0}, {"a": 10, "b": 1, "c": 1, "d": 1, "e": 1}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets_of(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(fixed_point(sizes))


def test_mixing(spark):
    rng = random.Random(12)
    rows = [(i, data.words(i, rng.randint(1, 60)), rng.choice(["a", "a", "a", "a", "b", "c", "é", None])) for i in range(1500)]
    docs = data.frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fixed_point(sizes)
    for s, n in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {n} and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 20
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def mix_by_brute_force(rows, hashes, measure, bucket_rows):
    """doc_id -> copies. rows: distinct (doc_id, text, source); hashes: of each doc_id."""
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    out = {}
    for source, target in fixed_point(sizes).items():
        own = [(d, len((t or "").split()), 2 ** (math.floor(math.log2(measure(t)) * mixing.LEVELS) / mixing.LEVELS)) for d, t, s in rows if s == source]
        low, high = 0.0, 1e6  # the factor, by halving
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(3, mid * w) * n for _, n, w in own) < target else (low, mid)
        m = {d: min(3, (low + high) / 2 * w) if sizes[source] else 0 for d, n, w in own}
        m = {d: round(x) if abs(x - round(x)) < 1e-9 else x for d, x in m.items()}
        buckets, ranked = math.ceil(len(own) / bucket_rows), []
        for d, n, _ in own:
            p = m[d] - math.floor(m[d])
            if p > 0:
                u = ((hashes[d] % (1 << 64) >> 11) + 0.5) / (1 << 53)
                odds = u / (1 - u) * (1 - p) / p
                ranked.append((odds / (1 + odds), d, n))
        gap = target - sum(math.floor(m[d]) * n for d, n, _ in own)
        out |= {d: math.floor(m[d]) for d, _, _ in own}
        ranked.sort()
        by: dict = {}
        for q, d, n in ranked:
            by.setdefault(math.floor(q * buckets), []).append((d, n))
        for b in sorted(by):
            if sum(n for _, n in by[b]) < gap and any(c > b for c in by):  # taken whole
                out |= {d: out[d] + 1 for d, _ in by[b]}
                gap -= sum(n for _, n in by[b])
                continue
            left = []
            for d, n in by[b]:
                if n <= gap:
                    out[d], gap = out[d] + 1, gap - n
                else:
                    left.append((abs(n - gap), n, d))
            near = [(abs(n - gap), i, d) for i, (_, n, d) in enumerate(left) if n < 2 * gap]
            if near:
                out[min(near)[2]] += 1
            break
    return out


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_mixing_by_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(17)
    rows = [(i, data.words(i, rng.randint(1, 80)), rng.choice(["a", "a", "a", "b", "c", "c", "é", None])) for i in range(900)] + [(1000, None, "a"), (1001, "", "z")]
    docs = data.frame(spark, rows)
    hashes = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(7, doc_id, text) h").collect()}
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    want = mix_by_brute_force(rows, hashes, lambda t: math.log(math.e + len((t or "").split())), bucket_rows)
    assert got == want
    expected: dict = {}
    for r in mixing.mix(docs).collect():
        expected.setdefault(r["source"], []).append((r["size"], r["copies"]))
    long, short = ([c for n, c in expected["a"] if (n > 60) == x and n] for x in (True, False))
    assert sum(long) / len(long) > sum(short) / len(short)  # inclusion odds are unequal


def test_mixing_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, data.words(i, 1 + i % 30), "abc"[i % 3]) for i in range(900)]
    got = mixing.mix(data.frame(spark, rows)).collect()
    assert len(got) == 900
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30


def test_mixing_by_weight(spark):
    rows = [(i, data.words(i, 20), "ab"[i % 2]) for i in range(2000)]
    docs = data.frame(spark, rows).selectExpr("*", "if(doc_id % 4 < 2, 3.0, 1.0) AS quality")
    got = mixing.mix(docs, weight_col="quality").collect()
    up = sum(r["taken"] for r in got if r["doc_id"] % 4 < 2)
    assert up > 1.5 * sum(r["taken"] for r in got if r["doc_id"] % 4 >= 2)


def test_mixed_documents(spark, nulls, nothing):
    taken = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(data.frame(spark)).collect()}
    out = mixing.mixed(data.frame(spark))
    assert out.columns == nulls.columns and out.schema == nulls.schema
    assert {r["doc_id"] for r in out.collect()} == {d for (d, _), n in taken.items() if n}
    assert sorted_rows((r["doc_id"], r["size"]) for r in mixing.mix(nulls).collect()) == sorted_rows((d, len((t or "").split())) for d, t in ALL)
    assert mixing.mix(nulls.selectExpr("*", "if(doc_id = 1, double('NaN'), if(doc_id = 5, -1, null)) AS w"), weight_col="w").where("taken > 0").count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# ---- 8: URLs --------------------------------------------------------------------------------------------------------
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "http://example.net", "http://example.net/", "http://example.net/en", "http://example.net/en/?q#f", "http://notexample.net/en/", "ftp://x.example.com/de/1",
        "http://example.com/DE/", "http://example.com:80/de/", "http://org/fr/", "http://a.b.org/fr/z?u=http://x.net/", "http://net/", "http://x.net?/", "http://x.net#/", "x://é.net/é", "a://b://c.net/", "http://user@x.net/", "http://..net/", "http://" + "a." * 3000 + "net/" + "p/" * 3000]


def judged(url, rules):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = __import__("re").match(r"[^/?#]*", rest)[0]
    path = __import__("re").match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(data.LOWER)
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in [*enumerate(URLS), (None, URLS[6]), (3, URLS[3])]], "page_id long, url string, html string, rule string")
    got = collected(url_rules.judge_urls(pages, url_rules.rules_frame(spark)))
    want = [(i, *judged(u, url_rules.RULES)) for i, u in [*enumerate(URLS), (None, URLS[6]), (3, URLS[3])]]
    assert sorted_rows(got) == sorted_rows(want)


def test_url_rules_of_all_shapes(spark):
    rng = random.Random(13)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "/".join(rng.choice("xy") for _ in range(rng.randint(0, 3))) for _ in range(60)]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in zip(hosts, paths, strict=True)}.values())
    urls = [f"s://{'.'.join(rng.choice('abc') for _ in range(rng.randint(1, 5)))}/{'/'.join(rng.choice('xy') for _ in range(rng.randint(0, 4)))}" for _ in range(400)]
    got = collected(url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_rules.rules_frame(spark, rules)))
    assert sorted(got, key=str) == sorted([(i, *judged(u, rules)) for i, u in enumerate(urls)], key=str)


def test_url_rules_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert collected(url_rules.judge_urls(pages, url_rules.rules_frame(spark, [("block", None, "/")]))) == [(1, "x.net", "/", None, "allow")]
    assert url_rules.judge_urls(pages.where("false"), url_rules.rules_frame(spark)).count() == 0


def test_url_oracle(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op8_url_filter']})").fetchall()
    assert sorted_rows(collected(queries.QUERIES["op8_url_filter"](spark, SF))) == sorted_rows(want)


# ---- 9: toxicity ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("dense", [0, 12])
def test_nearest_is_exact(dense):
    rng = random.Random(14)
    vectors = []
    for _ in range(500):
        v = {t: rng.random() for t in rng.sample(range(40), rng.randint(1, 8))}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / norm for t, w in v.items()})
    vectors += vectors[:20]
    rows = lambda some: (np.array(x) for x in zip(*[(i, t, w) for i, v in enumerate(some) for t, w in sorted(v.items())], strict=True))
    index = toxicity.Index(*rows(vectors), len(vectors), 40, block=16, dense=dense)
    queries = vectors[::25]
    for i, (q, (cosines, found)) in enumerate(zip(queries, index.nearest(*rows(queries), len(queries), 10, [[25 * i] for i in range(len(queries))]), strict=True)):
        want = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), j) for j, v in enumerate(vectors) if j != 25 * i))
        assert [(-s, j) for s, j in want if s < 0][:10] == list(zip(cosines.tolist(), found.tolist(), strict=True))
    none = np.zeros(0, int)
    assert [len(f) for _, f in index.nearest(none, none, np.zeros(0), 2, 5, [[], []])] == [0, 0]
    assert [len(f) for _, f in toxicity.Index(none, none, np.zeros(0), 0, 3).nearest(np.array([0]), np.array([1]), np.ones(1), 1, 5, [[]])] == [0]


def terms_of(text):
    """Counts of a text's terms, without the module's code."""
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    out = Counter([*words, *(w[:5] + "*" for w in words if len(w) > 5)])
    return out + Counter({f"{t}+": 1 for t, n in out.items() if n >= 3})


def toxicity_by_brute_force(rows, labels, k=toxicity.K):
    """doc_id -> score, neighbours; rows are distinct doc_ids with texts, labels a dict."""
    texts = dict(rows)
    ids = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 5)
    y = {i: labels[i] for i in ids}
    every = {i: terms_of(t) for i, t in rows}
    known = {t for i in ids for t in every[i]}
    n, up, n_up = len(ids), Counter(t for i in ids if y[i] for t in every[i]), sum(y.values())
    having = Counter(t for i in ids for t in every[i])
    df = Counter(t for c in every.values() for t in c)
    factor = {}
    for t in known:
        cells = [(up[t], having[t], n_up), (having[t] - up[t], having[t], n - n_up), (n_up - up[t], n - having[t], n_up), (n - n_up - having[t] + up[t], n - having[t], n - n_up)]
        ratio = 2 * sum(x * math.log(x / (a * b / n)) for x, a, b in cells if x > 0)
        ratio = ratio if up[t] * (n - n_up) > 2 * (having[t] - up[t]) * n_up else 0
        relevance = toxicity.PLAIN + (1 - toxicity.PLAIN) * ratio**2 / (ratio**2 + toxicity.TELLING**2)
        factor[t] = (math.log((len(rows) + 1) / (df[t] + 1)) + 1) * relevance

    def vector(i):
        v = {t: (1 + math.log(n)) * factor[t] for t, n in every[i].items() if t in known}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    vectors, base = {i: vector(i) for i in every}, (n_up + 0.5) / (n + 1)

    def vote(i):
        found = sorted((-round(sum(w * vectors[j].get(t, 0) for t, w in vectors[i].items()), 9), j) for j in ids if (texts[j] or "") != (texts[i] or ""))
        found = [(-c, j) for c, j in found if c < 0][:k]
        w = [1 / (1.05 - min(c, 1)) for c, _ in found]
        return (base + sum(x * y[j] for x, (_, j) in zip(w, found, strict=True))) / (1 + sum(w)), [j for _, j in found[:5]]

    votes = {i: vote(i) for i in every}
    knots = toxicity.isotonic(np.array([votes[i][0] for i in ids]), np.array([float(y[i]) for i in ids]))
    return {i: (min(1, max(0, 0.99 * float(np.interp(v, *knots)) + 0.01 * v)), own) for i, (v, own) in votes.items()}


def test_toxicity_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "DENSE", 20)
    rng = random.Random(15)
    rows = [(i, f"{rng.choice(['Idiot, moronic ' * rng.randint(1, 4), 'kind calm ', ''])}{data.words(i % 260, 5 + i % 40)}") for i in range(300)] + [(900, None), (901, ""), (902, "unseen"), (903, "ÊTRE être Être")]
    labels = {i: int("diot" in t) if rng.random() < 0.95 else 1 for i, t in rows[:250]}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")))
    want = toxicity_by_brute_force(rows, labels)
    for r in out.collect():
        score, found = want[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-7) and list(r["neighbours"]) == found
        assert all(x in terms_of(dict(rows)[r["doc_id"]]) for x in r["matched"])


def test_toxicity_sample_is_bounded_and_repeatable(spark):
    rows = [(i % 50, f"text {i} " * 20, "s") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    docs = data.frame(spark, rows)
    got = toxicity.sample_of(docs, labels).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [min(t for d, t, _ in rows if d == r["doc_id"]) for r in got] and len(got) > 30
    assert toxicity.sample_of(docs.repartition(5), labels, 20).count() == 20
    few = toxicity.sample_of(docs, labels, 50, 3200)
    assert 0 < few.count() < len(got) and sum(len(r["text"]) for r in few.collect()) < 4800


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    out = queries.QUERIES["op9_toxicity"](spark, d)
    assert out.count() == 1000 and out.where("score < 0 OR score > 1").count() == 0
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = out.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r[0] == r[1] for r in held) / len(held) > 0.9
    known = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out())
    assert all(zlib.crc32(str(r[0]).encode()) % 5 for r in known.select("doc_id").collect())


def test_toxicity_never_learns_from_held_out_rows(spark):
    rows = [(i, f"{'idiot moron ' if i % 2 else 'kind calm '}{data.words(i, 30)}", "s") for i in range(400)]
    docs = data.frame(spark, rows)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    honest = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    lying = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(400)], "doc_id long, toxic int")
    scores = []
    for labels in (honest, lying):
        scores.append(sorted(collected(toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "score"))))
    assert scores[0] == scores[1]
    assert all((s >= 0.5) == bool(i % 2) for i, s in scores[0])
    left = toxicity.drop_toxic(docs, honest)
    assert left.columns == docs.columns and sorted(r[0] for r in left.select("doc_id").collect()) == list(range(0, 400, 2))


def test_toxicity_of_nulls_and_nothing(spark, nulls, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score(nulls, toxicity.fit(nulls, none)).collect()
    assert sorted_rows((r["doc_id"], r["score"]) for r in out) == sorted_rows((d, 0.0) for d, _ in ALL)
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (3, 0), (99, 1)], "doc_id long, toxic int")
    out = toxicity.score(nulls, toxicity.fit(nulls, odd)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in ALL) and all(0 <= r["score"] <= 1 for r in out)
    by: dict = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[30]) == 1 and by[4] == by[7] == by[8]
    assert toxicity.score(nothing, toxicity.fit(nothing, odd)).count() == 0


# ---- 10: fingerprints -----------------------------------------------------------------------------------------------
def test_fingerprints(spark):
    rows = sorted({d: t for d, t, _ in data.texts()}.items())
    got = {r["doc_id"]: r for r in fingerprint.fingerprint(data.frame(spark, [(d, t, "s") for d, t in rows])).collect()}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())
        assert r["next_doc_id"] == rows[(i + 1) % len(rows)][0]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[1]["fingerprint"] == got[5]["fingerprint"] != got[3]["fingerprint"]
    assert got[4]["fingerprint"] == got[7]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) > 10


def test_fingerprint_by_brute_force(spark):
    """Terms, band, subsets and hashes as the docstring has them; the subsets' hash is Spark's."""
    from pyspark.sql import functions as F

    rows = [(i, data.words(i % 37, 60), "s") for i in range(200)]
    n, df, terms = len(rows), {}, {}
    for i, t, _ in rows:
        terms[i] = set(data.WORD.findall(t.translate(data.LOWER)))
        for x in terms[i]:
            df[x] = df.get(x, 0) + 1
    band = sorted(x for x, k in df.items() if max(2, fingerprint.LOW * n) <= k <= max(2, fingerprint.HIGH * n))
    hashes = spark.createDataFrame([(x,) for x in band], "term string").select("term", *[(F.pmod(F.xxhash64(F.lit(k), "term"), F.lit(c)) == 0).alias(f"m{k}") for k, c in enumerate(fingerprint.CHANCES)]).collect()
    chosen = [{r["term"] for r in hashes if r[f"m{k}"]} for k in range(len(fingerprint.CHANCES))]
    for r in fingerprint.fingerprint(data.frame(spark, rows)).collect():
        own = [sorted(terms[r["doc_id"]] & c, key=lambda x: x.encode()) for c in chosen]
        want = ".".join(hashlib.sha256(" ".join(o).encode()).hexdigest()[:8] if o else "" for o in own)
        if not any(own):
            want = hashlib.sha256(rows[r["doc_id"]][1].encode()).hexdigest()
        assert r["fingerprint"] == want


def test_fingerprints_tell_edits_from_others(spark):
    rows = [r[0] for r in fingerprint.fingerprint(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).selectExpr("struct(near_edited, near_next)").collect()]
    assert sum(r[0] > r[1] for r in rows) > 0.85 * len(rows)


def test_fingerprints_of_equal_rows_nulls_and_nothing(spark, nulls, nothing):
    got = fingerprint.fingerprint(nulls).collect()
    assert len(got) == len(ALL)
    twice = [r for r in got if r["doc_id"] == 30]
    text = data.words(8, 40)
    k = len(text) // 4
    shas = {r["edited_sha256"] for r in twice}
    nxt = dict((d, t) for d, t, _ in data.texts())[31]
    assert shas == {hashlib.sha256((text[: len(text) - k] + x[:k]).encode()).hexdigest() for x in (text, nxt)}
    assert fingerprint.fingerprint(nothing).count() == 0
    (alone,) = fingerprint.fingerprint(data.frame(spark, [(1, "abcdefgh", "s")])).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1.0


def test_fingerprint_plan_has_no_python(spark, docs):
    plan = fingerprint.fingerprint(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

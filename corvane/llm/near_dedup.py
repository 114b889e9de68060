"""Near-duplicate documents by banded MinHash, odd sketches and exact confirmation (operator 4).

A document's set holds its distinct shingles of five words (lower-cased A-Z; a shorter text is one shingle). Documents
are linked if 100 * |A & B| >= share * |A | B|; the classes are the connected components. The share is 85 in op4; callers
may pass another, and bands and bounds follow from it.

1. Documents with equal sets are one node from the start, so copies never meet again.
2. bands x ROWS MinHashes give each node band keys. Buckets (keys with several nodes) that hold the same nodes are merged.
   A pair at the threshold shares no bucket with probability (1 - (share / 100)^5)^bands <= MISS: 25 bands at 85, 37 at 80.
3. Nodes in buckets get two parity bitmaps: the odd sketch, into which the MinHash samples are folded, and the same of
   the whole set. XOR population counts estimate similarity; the whole set's count never exceeds the symmetric
   difference, so it also rejects with certainty. Bounds lie 6 standard deviations beyond the threshold.
4. Stars: each bucket has a pivot, its smallest node, and each of its nodes is a candidate with the pivot if the bitmaps
   allow it. Every node's best candidate is confirmed on the full sets, links merge components, and what is left between
   components is confirmed then. That is all for buckets of two, and a group of m near copies costs about m confirmations.
5. The rest: in a bucket that still has several components, the nodes outside its largest one (the left side) meet all its
   nodes (the right side), in cells of at most BLOCK nodes a side; pairs of one component are not looked at. Rounds propose
   the best pairs that the bitmaps allow (the first: a spanning forest a cell, of which one pair for two components; then
   FURTHER pairs a node), and refuted pairs are not proposed again. It ends when no bucket has a pair left, so no proposal
   is dropped. Only nodes whose buckets hold many components cost more than their number.

Buckets with more than 1/HOT of all rows (HOT at most) are joined by broadcast, and a node with more than that share of
the pairs (a hub) is sent to several tasks, so that no large group meets in one. Components are found by the large-star
and small-star steps on staged tables. Nothing but counts comes to the driver.

Defined results: null, empty and wordless texts have an empty set and are their own class; rows with equal doc_id and
text fall into one class; a class's id is its smallest doc_id, null only if all are null; an empty table gives an empty
result; a very long text is one set like others, held with its batch; further columns are ignored by near_duplicates()
and kept by one_of_each(), which keeps one row of each class, the first by doc_id (null first) and a hash of the text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collect_garbage, delete, forget, fresh, map_batches, stage, table, unstage, work_dir
from .token_store import mix64

SHINGLE, SHARE = 5, 85
ROWS, MISS = 5, 5e-7
ODD_BITS, SET_BITS = 512, 1024
BLOCK, FURTHER, CELL_ROWS = 2048, 8, 2048
HOT, FEW = 4096, 256

_K = 125
_SEEDS = mix64(np.arange(1, 1 + 2 * _K + 256 + 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE = _SEEDS[2 * _K : 2 * _K + 256]
_PLACE = _SEEDS[2 * _K + 256 :] | np.uint64(1)
_BASE = np.uint64(0x9FB21C651E98DF25)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def _expected(differences: np.ndarray | float, bits: int):
    """Mean and deviation of the population count of a parity bitmap after so many toggles."""
    return bits / 2 * (1 - np.exp(-2 * differences / bits)), np.sqrt(bits / 4 * (1 - np.exp(-4 * differences / bits)))


class Threshold(NamedTuple):
    """What follows from a share: bands, multipliers and addends of bands * ROWS MinHashes, most bits of two odd sketches."""

    bands: int
    mul: np.ndarray
    add: np.ndarray
    odd_bound: float


@cache
def threshold(share: int) -> Threshold:
    bands = math.ceil(math.log(MISS) / math.log1p(-((share / 100) ** ROWS))) if share < 100 else 1
    k = bands * ROWS
    more = mix64(np.arange(1 + len(_SEEDS), 1 + len(_SEEDS) + 2 * max(0, k - _K), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mul, add = np.concatenate([_SEEDS[:_K], more[::2]])[:k], np.concatenate([_SEEDS[_K : 2 * _K], more[1::2]])[:k]
    apart = k * (1 - share / 100)
    mean, noise = _expected(2 * apart, ODD_BITS)
    return Threshold(bands, (mul >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (add >> np.uint64(32)).astype(np.uint32), mean + 6 * np.sqrt(4 * apart * share / 100 + noise**2))


# ---- sets -----------------------------------------------------------------------------------------------------------
def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the blob's words, and where they start. Words are separated by spaces."""
    a = np.frombuffer(blob, np.uint8)
    inside = np.concatenate([[False], a != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) - 1, _BASE)]))
    values = _BYTE[a[a != 32]]
    values *= powers[np.arange(len(values)) - np.repeat(first, sizes)]
    return mix64(np.add.reduceat(values, first) + sizes.astype(np.uint64) * _PLACE[15]), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode() for t in texts]
    blob = b" ".join(raw).translate(_FOLD)
    words, starts = word_hashes(blob)
    ends = np.cumsum([len(r) + 1 for r in raw])
    cuts = np.searchsorted(starts, ends - 1, side="left")
    n = max(0, len(words) - SHINGLE + 1)
    full = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        full += words[j : j + n] * _PLACE[j]
    full = mix64(full)
    out, a = [], 0
    for b in cuts.tolist():
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[5 + b - a]
            out.append(mix64(short))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def minhashes(shingles: np.ndarray, share: int = SHARE) -> np.ndarray:
    _, mul, add, _ = threshold(share)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512] * mul[:, None] + add[:, None]).min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """Documents x bands keys."""
    m = mins.astype(np.uint64).reshape(len(mins), -1, ROWS)
    h = np.broadcast_to(np.arange(m.shape[1], dtype=np.uint64) * _PLACE[11], m.shape[:2]).copy()
    for r in range(ROWS):
        h = mix64(h ^ (m[:, :, r] + _PLACE[r]))
    return h.view(np.int64)


def parity(values: np.ndarray, bits: int) -> bytes:
    return np.packbits((np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def odd_sketch(mins: np.ndarray) -> bytes:
    return parity(mix64(mins.astype(np.uint64) + np.arange(len(mins), dtype=np.uint64) * _PLACE[13]), ODD_BITS)


def set_sketch(shingles: np.ndarray) -> bytes:
    return parity(shingles >> np.uint64(7), SET_BITS)


def linked(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


# ---- candidates -----------------------------------------------------------------------------------------------------
def distances(n: tuple, odd: tuple, whole: tuple, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Do the bitmaps allow pairs (each argument but share: of the left and of the right nodes), and their sketches'
    distances."""
    ones = np.bitwise_count
    small, large = np.minimum(*n), np.maximum(*n)
    most = (100 - share) * (small + large) / (100 + share)
    o, w = (ones(x ^ y).sum(axis=1, dtype=np.int32) for x, y in (odd, whole))
    mean, noise = _expected(most, SET_BITS)
    bound = threshold(share).odd_bound
    near = (100 * small >= share * large) & (o <= bound) & (w <= np.minimum(most, mean + 6 * noise))
    return near, o / bound + w / np.maximum(1, np.minimum(most, mean))


def allowed_pairs(n, odd, whole, left, right, label, share: int = SHARE, node=None, outside=None):
    """Pairs (i in left, j in right) of different labels that the bitmaps allow, with the distances of their sketches. Where
    outside is given, nodes that it marks stand on both sides, and their pairs are taken once, by node."""
    found = []
    for i in left.tolist():
        j = right[label[right] != label[i]]
        if outside is not None:
            j = j[~outside[j] | (node[j] > node[i])]
        j = j[100 * np.minimum(n[j], n[i]) >= share * np.maximum(n[j], n[i])]
        if not len(j):
            continue
        near, far = distances((n[i], n[j]), (odd[i], odd[j]), (whole[i], whole[j]), share)
        if near.any():
            found.append((np.full(near.sum(), i), j[near], far[near]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Forest:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while self.up.get(root, root) != root:
            root = self.up[root]
        while self.up.get(x, x) != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


_PROPOSED = {"key": "long", "a": "long", "b": "long", "la": "long", "lb": "long", "far": "double"}


def _propose(forest_only: bool, share: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Over the rows of some bucket cells and the refuted pairs of their buckets."""

    def run(rows: pd.DataFrame, refuted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows):
            key, i, j, node, right = (rows[c].to_numpy() for c in ("key", "i", "j", "node", "right"))
            order = np.lexsort((node, right, j, i, key))
            key, i, j, node, right = (x[order] for x in (key, i, j, node, right))
            label, n, own = (rows[c].to_numpy()[order] for c in ("label", "n", "outside"))
            odd, whole = (np.frombuffer(b"".join(rows[c]), np.uint64).reshape(len(rows), -1)[order] for c in ("odd", "whole"))
            known = {*zip(refuted["a"].tolist(), refuted["b"].tolist(), strict=True)}
            forest = Forest()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                cell = slice(lo, hi)
                sides = np.flatnonzero(~right[cell]), np.flatnonzero(right[cell])
                x, y, far = allowed_pairs(n[cell], odd[cell], whole[cell], *sides, label[cell], share, node[cell], own[cell])
                some = 0
                for k in np.lexsort((node[cell][y], node[cell][x], far)).tolist():
                    p, q = lo + int(x[k]), lo + int(y[k])
                    if node[p] > node[q]:
                        p, q = q, p
                    if (node[p], node[q]) in known or forest_only and not forest.join(int(label[p]), int(label[q])):
                        continue
                    out.append((int(key[lo]), int(node[p]), int(node[q]), int(label[p]), int(label[q]), float(far[k])))
                    some += 1
                    if some >= FURTHER * (hi - lo):  # the rest has its turn in the next round
                        break
        return pd.DataFrame(out, columns=list(_PROPOSED)) if out else pd.DataFrame({c: [] for c in _PROPOSED})

    return run


# ---- components -----------------------------------------------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """links(a, b long) -> node, root: the smallest node of its component. Nodes without links are left out. Staged."""

    def local(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        pairs = [(x, r) for x in forest.up if (r := forest.find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["v", "u"])

    edges = stage(links.where("a != b").select("a", "b").mapInArrow(local, "v long, u long"), "edges")  # v > u
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        large = stage(large, "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = stage(small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "small")
        # done when every node hangs on one root and no root hangs on another
        hung = small.groupBy("v").count().where("count > 1").limit(1).count()
        if not hung and not small.select(F.col("u").alias("v")).distinct().join(small.select("v"), "v", "left_semi").limit(1).count():
            return small.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(small.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        edges = small


# ---- the operator ---------------------------------------------------------------------------------------------------
_LOWEST = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))).withColumn("h", F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), "text"))


def _first_pass(docs: DataFrame, share: int) -> DataFrame:
    def make():
        forget()

        def run(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch.column("text").to_pylist())
            names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            seen: dict[bytes, int] = {}
            for i, x in enumerate(names):
                if x is not None:
                    seen.setdefault(x, i)
            own = list(seen.values())
            keys: list = [None] * len(sets)
            if own:
                for i, row in zip(own, band_keys(np.array([minhashes(sets[i], share) for i in own])).tolist(), strict=True):
                    keys[i] = row
            return {"k": batch.column("k"), "h": batch.column("h"), "doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "name": names, "bands": keys}

        return run

    return map_batches(docs.select("k", "h", F.col("doc_id").cast("long"), "text"), make, "k long, h long, doc_id long, n long, name binary, bands array<long>")


def _sketched(texts: DataFrame, share: int) -> DataFrame:
    def make():
        forget()

        def run(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch.column("text").to_pylist())
            return {"node": batch.column("node"), "text": batch.column("text"), "n": [len(s) for s in sets], "odd": [odd_sketch(minhashes(s, share)) for s in sets], "whole": [set_sketch(s) for s in sets]}

        return run

    return map_batches(texts, make, "node long, text string, n long, odd binary, whole binary")


def _often(total: int) -> int:
    """Rows above which a key is hot: at most HOT keys of so many rows are."""
    return max(FEW, total // HOT)


def _attach(pairs: DataFrame, column: str, side: DataFrame) -> DataFrame:
    """pairs with the other columns of side(node, ...), as <name>_<column>, for pairs[column] = node."""
    named = side.select(F.col("node").alias(column), *[F.col(c).alias(f"{c}_{column}") for c in side.columns if c != "node"])
    # the HOT commonest keys at most: what is not among them has less than 1/HOT of the rows, or FEW
    hubs = pairs.groupBy(column).count().where(F.col("count") > FEW).orderBy(F.desc("count"), column).limit(HOT).collect()
    if not hubs:
        return pairs.join(named, column)
    hubs = pairs.sparkSession.createDataFrame([(r[0], -(-r[1] // FEW)) for r in hubs], f"{column} long, parts int")
    split = pairs.join(F.broadcast(hubs), column, "left")
    plain = split.where("parts IS NULL").drop("parts").join(named, column)
    copies = named.join(F.broadcast(hubs), column).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    hot = split.where("parts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64(*[c for c in ("a", "b") if c != column]), F.col("parts")).cast("int")).drop("parts")
    return plain.unionByName(hot.join(copies, [column, "part"]).drop("part"))


def _by_key(rows: DataFrame, keys: DataFrame, often: int) -> DataFrame:
    """rows with the columns of keys(key, m, ...), of which those with m > often are broadcast."""
    hot = rows.join(F.broadcast(keys.where(F.col("m") > often)), "key", "left")
    return hot.where("m IS NOT NULL").unionByName(hot.where("m IS NULL").select(*rows.columns).join(keys.where(F.col("m") <= often), "key").select(*hot.columns))


def _candidates(pairs: DataFrame, sketches: DataFrame, share: int) -> DataFrame:
    """pairs(a, b) -> a, b, far: those that the bitmaps allow."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            n = [np.array(batch.column(f"n_{c}")) for c in "ab"]
            odd, whole = ([np.frombuffer(b"".join(batch.column(f"{x}_{c}").to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in "ab"] for x in ("odd", "whole"))
            near, far = distances(n, odd, whole, share)
            keep = pa.array(near)
            return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep), "far": far[near]}

        return run

    both = _attach(_attach(pairs, "b", sketches), "a", sketches)
    return map_batches(both.select("a", "b", *[f"{x}_{c}" for x in ("n", "odd", "whole") for c in "ab"]), make, "a long, b long, far double")


def _confirm(pairs: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """pairs(a, b) -> a, b, ok by the full sets. Staged."""

    def make():
        last: dict = {"a": None, "set": None}

        def run(batch: pa.RecordBatch) -> dict:
            a = batch.column("a").to_pylist()
            right, ok = shingle_sets(batch.column("text_b").to_pylist()), []
            left = batch.column("text_a")
            for i, x in enumerate(a):
                if last["a"] != x:
                    last["a"], last["set"] = x, shingle_sets([left[i].as_py()])[0]
                ok.append(linked(last["set"], right[i], share))
            return {"a": batch.column("a"), "b": batch.column("b"), "ok": ok}

        return run

    both = _attach(_attach(pairs, "b", texts.select("node", "text")), "a", texts.select("node", "text"))
    return stage(map_batches(both.select("a", "b", "text_a", "text_b"), make, "a long, b long, ok boolean"), "confirmed")


class _Links:
    """Confirmed links so far, and the label (smallest node of its component) of each node."""

    def __init__(self, texts: DataFrame, share: int):
        self.texts, self.share = texts, share
        self.links, self.labels = [], texts.select("node", F.col("node").alias("label"))

    def judge(self, pairs: DataFrame) -> DataFrame:
        """Confirms pairs(a, b) and merges what they link; a, b, ok."""
        verdict = _confirm(pairs, self.texts, self.share)
        self.links.append(verdict.where("ok").select("a", "b"))
        rooted = components(reduce(DataFrame.unionByName, self.links))
        self.labels = stage(self.texts.select("node").join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")
        collect_garbage(self.texts.sparkSession)
        return verdict

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) whose nodes are in different components."""
        both = _attach(_attach(pairs, "b", self.labels), "a", self.labels)
        return both.where("label_a != label_b").select(*pairs.columns)


def classes(docs: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """First pass over docs (k, h, doc_id, n, name), and name, label, component_id, rep (first k and h) of every set with words."""
    spark = docs.sparkSession
    keyed = _keyed(docs.select("doc_id", "text"))
    first = stage(_first_pass(keyed, share), "first")
    nodes = first.where("name IS NOT NULL").groupBy("name").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("k", "h")).alias("rep"), F.first("bands", ignorenulls=True).alias("bands")
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("pivot")).where("m > 1")
    buckets = stage(buckets.groupBy("m", "who").agg(F.min(F.struct("key", "pivot")).alias("x")).select("x.key", "m", "x.pivot"), "buckets")
    often = _often(buckets.agg(F.sum("m")).first()[0] or 0)
    members = stage(_by_key(banded, buckets, often), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep.k", "rep.h"), "node")
    found = keyed.select("k", "h", "text").join(wanted, ["k", "h"]).dropDuplicates(["node"]).select("node", "text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    # texts by node in buckets, so that the rounds' joins need not move them
    folder = work_dir(spark)
    name = f"corvane_{folder.rsplit('-', 1)[1]}"
    _sketched(found, share).repartition(parts, "node").write.option("path", f"{folder}/texts").option("compression", "zstd").bucketBy(parts, "node").saveAsTable(name)
    texts = spark.table(name)
    sketches = texts.select("node", "n", "odd", "whole")
    state = _Links(texts, share)
    collect_garbage(spark)
    # stars
    pairs = stage(members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    candidates = stage(_candidates(pairs, sketches, share), "candidates")
    best = stage(candidates.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select("x.a", "b"), "best")
    if best.limit(1).count():
        state.judge(best)
        rest = stage(state.apart(candidates.select("a", "b").join(best, ["a", "b"], "left_anti")), "rest")
        if rest.limit(1).count():
            state.judge(rest)
    _rounds(members.where("m > 2").select("key", "node"), sketches, state, often)
    named = nodes.join(state.labels, "node", "left").select("name", "least", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    out = stage(named.join(least, "label").select("name", "label", "component_id", "rep"), "classes")
    spark.sql(f"DROP TABLE {name}")
    delete(spark, folder)
    unstage(nodes, buckets, members, pairs, candidates, best)
    return first.drop("bands"), out


def _rounds(members: DataFrame, sketches: DataFrame, state: _Links, often: int) -> None:
    """Proposals and verdicts until no bucket of members(key, node) has a pair left."""
    spark = members.sparkSession
    refuted = spark.createDataFrame([], "key long, a long, b long")
    history = spark.createDataFrame([], "a long, b long")
    tried = 0
    while True:
        labelled = stage(members.join(state.labels, "node"), "labelled")
        sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        mixed = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("x"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        mixed = stage(
            mixed.select("key", "m", F.col("x.label").alias("largest"), F.ceil((F.col("m") - F.col("x.c")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("m") / BLOCK).cast("int").alias("rights")), "mixed"
        )
        rows = _by_key(labelled.select("key", "node", "label"), mixed, often).join(sketches, "node").withColumn("outside", F.col("label") != F.col("largest"))
        i, j = (F.pmod(F.xxhash64(F.lit(side), "node"), F.col(side)).cast("int") for side in ("lefts", "rights"))
        every = {side: F.explode(F.sequence(F.lit(0), F.col(side) - 1)) for side in ("lefts", "rights")}
        columns = ["key", "node", "label", "outside", "n", "odd", "whole"]
        cells = rows.where("outside").select(*columns, F.lit(False).alias("right"), i.alias("i"), every["rights"].alias("j"))
        cells = cells.unionByName(rows.select(*columns, F.lit(True).alias("right"), every["lefts"].alias("i"), j.alias("j")))
        # cells are dealt to groups of about CELL_ROWS rows
        groups = int(mixed.agg(F.sum(F.col("m") * F.col("lefts"))).first()[0] or 0) // CELL_ROWS + 1
        group = F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)).alias("cell")
        # a refuted pair stands in two cells at most: either node may be on the left
        again = _by_key(refuted, mixed.select("key", "m", "lefts", "rights"), often)
        at = [F.pmod(F.xxhash64(F.lit(side), x), F.col(side)).cast("int") for side, x in (("lefts", "a"), ("rights", "b"), ("lefts", "b"), ("rights", "a"))]
        again = again.select("key", "a", "b", at[0].alias("i"), at[1].alias("j")).unionByName(again.select("key", "a", "b", at[2].alias("i"), at[3].alias("j")))
        schema = ", ".join(f"{c} {t}" for c, t in _PROPOSED.items())
        proposed = cells.select("*", group).groupBy("cell").cogroup(again.select("*", group).groupBy("cell")).applyInPandas(_propose(tried == 0, state.share), schema)
        proposed = stage(proposed, "proposed")
        if not proposed.limit(1).count():
            return
        fresh_ones = proposed.join(history, ["a", "b"], "left_anti")
        if tried == 0:  # one pair for two components
            one = F.struct("far", "a", "b")
            fresh_ones = fresh_ones.groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.min(one).alias("z")).select("z.a", "z.b")
        fresh_ones = stage(fresh_ones.select("a", "b").distinct(), "pairs")
        if fresh_ones.limit(1).count():
            verdict = state.judge(fresh_ones)
            history = stage(history.unionByName(verdict.where("NOT ok").select("a", "b")), "history")
        refuted = stage(refuted.unionByName(proposed.join(history, ["a", "b"], "left_semi").select("key", "a", "b")), "refuted")
        tried += 1


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    first, named = classes(docs, share)
    out = first.join(named, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The first document by doc_id of each class, with all its columns; of equal rows one."""
    first, named = classes(docs, share)
    stay = named.groupBy("label").agg(F.min("rep").alias("rep")).select("rep.k", "rep.h")
    stay = stay.unionByName(first.where("name IS NULL").select("k", "h").distinct())
    k, h = fresh("k", docs.columns), fresh("h", docs.columns)
    keyed = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))).withColumn(h, F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), "text"))
    stay = stay.select(F.col("k").alias(k), F.col("h").alias(h))
    return keyed.dropDuplicates([k, h]).join(stay, [k, h], "left_semi").select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, k, k + 4), ' ') AS g
  FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS t(k) WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM common JOIN n AS p ON x = p.doc_id JOIN n AS q ON y = q.doc_id WHERE 100 * i >= 85 * (p.n + q.n - i)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON reach.r = link.x
), c AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""

"""Repeated passages by run-length compressed BWT indexes (operator 6).

A byte is removed if a string of LENGTH (50) bytes that covers it also starts in a document with a smaller doc_id.

1. Documents are dealt to batches of about BATCH bytes, staged as one compressed row each.
2. Anchors: in every 50-byte window the 24-byte grams with the smallest hash. Equal windows have equal anchors, so two
   documents that share a window share an anchor. Each batch sends its distinct anchor hashes (shortened, sorted, packed)
   to hash ranges, which answer which of them other batches have too.
3. Around each anchor that several documents have, the bytes that its windows can reach (at most 26 before, 50 from it)
   form a context. Each batch sends its distinct contexts with the smallest doc_id that has them to hash ranges.
4. There equal contexts are merged, those that can't share a window with another (none has the same 13 bytes before or
   after the anchor) are set aside, and over the others of some anchors at a time (INDEX bytes, or one anchor's) a
   run-length compressed Burrows-Wheeler transform is built: run heads, run starts, symbol counts before each run, and
   suffix-array samples at run ends; the suffix array and the transform itself are not kept. Longest common prefixes are
   compared at run heads only, with the suffix that a sampled run end gives, and counted on along LF steps. All contexts are streamed through the index by LF steps, from their end; the matching statistic of each
   window (is it at least 50, and the smallest doc_id in its interval) says which windows an earlier document has.
5. Each batch gets back a bit for each window of each of its contexts, marks bytes and digests what is left. A document
   that is not the smallest of its batch with a context has all of the context's windows from that smallest one.

Candidates only route: every match is decided on all 50 bytes. Memory is bounded by a batch, a packed hash range or an
anchor's distinct contexts; a passage in very many documents counts once a batch.

Defined results: null text is empty and has nothing removed; null doc_id is smaller than all; rows with equal doc_ids
do not match each other; texts under 50 bytes are left alone; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, delete, map_batches, stage, table, unstage, work_dir
from .token_store import mix64

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # grams in a window, and windows around a gram
HALF = (LENGTH - GRAM) // 2
BATCH, INDEX = 3 << 20, 1 << 20
SEGMENT = 1 << 19
RANGE_BYTES, CONTEXT_RANGE_BYTES = 24 << 20, 6 << 20
U = np.uint64
_G = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
_LOWEST = -(1 << 63)


# ---- packing --------------------------------------------------------------------------------------------------------
def pack(a: np.ndarray, level: int = 1) -> bytes:
    """An array by planes of bytes, which compress better than its items."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), level)


def unpack(data: bytes, dtype) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.decompress(data), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1) if len(raw) else np.zeros(0, dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


# ---- anchors --------------------------------------------------------------------------------------------------------
def gram_hashes(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64)
    x = x[:-1] | (x[1:] << U(8))
    x = x[:-2] | (x[2:] << U(16))
    x = x[:-4] | (x[4:] << U(32))
    n = len(a) - GRAM + 1
    return mix64(x[:n] * _G[0] + x[8 : 8 + n] * _G[1] + x[16 : 16 + n] * _G[2])


def _slide(f, x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = f(x[: len(x) - n], x[n:])
        n *= 2
    return f(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def anchors(a: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of documents that end at `ends` in the bytes a."""
    invalid = np.zeros(len(a) + 1, np.int8)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    np.add.at(invalid, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(invalid, ends, -1)
    invalid = np.cumsum(invalid[:-1]) > 0
    at, hashes = [], []
    for s in range(0, max(0, len(a) - LENGTH + 1), SEGMENT):
        e = min(s + SEGMENT, len(a) - LENGTH + 1)
        h = gram_hashes(a[s : e + LENGTH - 1])
        least = _slide(np.minimum, h, SPAN)
        least[invalid[s:e]] = 0
        edge = np.zeros(SPAN - 1, np.uint64)
        chosen = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), SPAN) == h)
        at.append(chosen + s)
        hashes.append(h[chosen])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, hashes[first]


# ---- the index ------------------------------------------------------------------------------------------------------
def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, from seven symbols (0 to 256) packed into a word. Symbol 0 ends a string; it is
    smaller than the others, and an earlier one is smaller than a later one, so suffixes differ at the first at latest."""
    n = len(symbols)
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(7):
        here = np.zeros(n, np.int64)
        here[: n - j] = symbols[j:]
        key = (key << 9) | np.where(live, here, 0)
        live &= here > 0
    # a key with an end in it is the suffix's own: of equal ones the earlier suffix comes first
    order = np.argsort(key, kind="stable")
    ordered, own = key[order], ~live[order]
    fresh = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | own[1:]])
    k = 7
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if rank[order[-1]] == n - 1:
            return order
        # only runs of equal ranks are sorted again; each stays within its rows
        alone = fresh & np.append(fresh[1:], True)
        rows = np.flatnonzero(~alone)
        at = order[rows]
        far = np.minimum(at + k, n - 1)
        again = rank[at] * np.int64(n) + rank[far]
        by = np.argsort(again)
        order[rows] = at[by]
        again = again[by]
        fresh[rows] = np.concatenate([[True], again[1:] != again[:-1]])
        k *= 2


class RunIndex:
    """Run-length compressed BWT of strings, each followed by a terminator smaller than all bytes (the i-th smaller than
    the (i+1)-th), with suffix samples at run ends."""

    def __init__(self, strings: np.ndarray, ends: np.ndarray):
        """strings: bytes one after the other; ends: where each ends."""
        m = len(ends)
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        #: Where each string starts in the text with terminators.
        self.starts, self.sizes = starts + np.arange(m), sizes
        n = len(strings) + m
        stops = self.starts + sizes
        inside = np.ones(n, bool)
        inside[stops] = False
        symbols = np.zeros(n, np.int64)
        symbols[inside] = strings.astype(np.int64) + 1
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        heads = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.run_start = np.flatnonzero(heads)
        self.run_symbol = bwt[self.run_start]
        self.run_end_sample = order[np.concatenate([self.run_start[1:], [n]]) - 1]
        lengths = np.diff(np.append(self.run_start, n))
        smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=257))])
        by = np.argsort(self.run_symbol, kind="stable")
        before = np.cumsum(lengths[by]) - lengths[by]
        first = np.concatenate([[True], self.run_symbol[by][1:] != self.run_symbol[by][:-1]])
        before -= np.maximum.accumulate(np.where(first, before, 0))
        #: Row that LF gives for the first row of each run.
        self.run_to = np.empty(len(by), np.int64)
        self.run_to[by] = before + smaller[self.run_symbol[by]]
        #: The run before each with the same symbol, or -1: its end is the row above the run's start after an LF step.
        self.run_before = np.full(len(by), -1)
        self.run_before[by[1:]] = np.where(first[1:], -1, by[:-1])
        self.n, self.m = n, m
        # from here on rows are known by runs and samples alone
        self._walk = self._stream()
        self._same = self._matching(symbols)

    def run_of(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.run_start, rows, side="right") - 1

    def _stream(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All strings from their ends by LF, a byte a step: those that still have one, the rows of their suffixes, and the
        run that the step began with where it began at the run's start, else -1. The i-th terminator's suffix is row i."""
        out = []
        live = rows = np.arange(self.m)
        for d in range(int(self.sizes.max(initial=0))):
            keep = self.sizes[live] > d
            live, above = live[keep], rows[keep]
            run = self.run_of(above)
            within = above - self.run_start[run]
            rows = self.run_to[run] + within
            out.append((live, rows, np.where(within == 0, run, -1)))
        return out

    def _matching(self, symbols: np.ndarray) -> np.ndarray:
        """For each row: do its first LENGTH bytes equal those of the row above? Within a run the common prefix grows by one
        with an LF step; at its start the row above is that of the sampled end of the run before with the same symbol."""
        lcp = np.zeros(self.n, np.int16)
        value = np.zeros(self.m, np.int64)
        for d, (live, rows, run) in enumerate(self._walk, 1):
            head = run >= 0
            value[live] = np.where(head, 0, value[live] + 1)
            other = np.where(head, self.run_before[run], -1)
            own = np.flatnonzero(other >= 0)
            at = live[own]
            a, b = self.starts[at] + self.sizes[at] - d, self.run_end_sample[other[own]] - 1
            for j in range(LENGTH):  # irreducible values: compared up to LENGTH
                if not len(at):
                    break
                x = symbols[np.minimum(a + j, self.n - 1)]
                same = (x == symbols[np.minimum(b + j, self.n - 1)]) & (x > 0)
                value[at[~same]] = j
                at, a, b = at[same], a[same], b[same]
            value[at] = LENGTH
            lcp[rows] = np.minimum(value[live], LENGTH)
        return lcp >= LENGTH

    def least_by_window(self, owner: np.ndarray, windows: int) -> np.ndarray:
        """strings x windows: the smallest owner among strings that hold the same LENGTH bytes as this string does from
        that offset on."""
        interval = np.cumsum(~self._same) - 1
        least = np.full(interval[-1] + 1, np.iinfo(np.int64).max)
        out = np.full((self.m, windows), np.iinfo(np.int64).max)
        deep = list(enumerate(self._walk[LENGTH - 1 :], LENGTH))
        for _, (live, rows, _) in deep:
            np.minimum.at(least, interval[rows], owner[live])
        for d, (live, rows, _) in deep:
            out[live, self.sizes[live] - d] = least[interval[rows]]
        return out


# ---- passes ---------------------------------------------------------------------------------------------------------
def _batches(docs: DataFrame) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        part, seq, ids, raw, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(r) for r in raw]], pa.list_(pa.int64())), pa.array([zstandard.compress(b"".join(raw), 3)], pa.binary())],
                names=["b", "ids", "lens", "data"],
            )

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                raw.append((t.as_py() or "").encode())
                held += len(raw[-1])
                if held >= BATCH:
                    yield row()
                    seq, ids, raw, held = seq + 1, [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "b long, ids array<long>, lens array<long>, data binary")


class _Batch:
    """A batch's bytes and anchors."""

    def __init__(self, ids, lens, data, bits: int, ranges: int):
        self.ids = np.array([_LOWEST if i is None else i for i in ids], np.int64)
        self.ends = np.cumsum(np.array(lens, np.int64))
        self.bytes = np.frombuffer(zstandard.decompress(data), np.uint8)
        self.at, self.hash = anchors(self.bytes, self.ends)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        short = self.hash >> U(64 - bits)
        self.distinct, self.which = np.unique(short, return_inverse=True)
        #: Ranges of the short hashes, as boundaries in `distinct`.
        self.cuts = np.searchsorted(self.distinct, [U(math.ceil((r << bits) / ranges)) for r in range(ranges)] + [U((1 << bits) - 1)], side="left")
        self.cuts[-1] = len(self.distinct)

    def own_shared(self) -> np.ndarray:
        """Which distinct hashes several of its own documents have."""
        o = np.lexsort((self.doc, self.which))
        w, d = self.which[o], self.doc[o]
        out = np.zeros(len(self.distinct), bool)
        out[w[1:][(w[1:] == w[:-1]) & (d[1:] != d[:-1])]] = True
        return out

    def contexts(self, shared: np.ndarray):
        """Distinct contexts of anchors with shared hashes, in order of hash: number of bytes before the anchor and from it,
        and the bytes, padded to SPAN - 1 before and LENGTH from it. With each the hash and the smallest doc_id; and for
        every such anchor, in order of position, its place in anchors, its context and its bytes before."""
        pick = np.flatnonzero(shared[self.which])
        at, doc = self.at[pick], self.doc[pick]
        starts = np.concatenate([[0], self.ends[:-1]])[doc]
        left = np.minimum(at - starts, SPAN - 1)
        right = np.minimum(self.ends[doc] - at, LENGTH)
        grid = at[:, None] + np.arange(-(SPAN - 1), LENGTH)
        rows = self.bytes[np.clip(grid, 0, len(self.bytes) - 1)] if len(at) else np.zeros((0, SPAN - 1 + LENGTH), np.uint8)
        col = np.arange(SPAN - 1 + LENGTH)
        rows[(col < (SPAN - 1 - left)[:, None]) | (col >= (SPAN - 1 + right)[:, None])] = 0
        full = np.concatenate([left.astype(np.uint8)[:, None], right.astype(np.uint8)[:, None], rows], axis=1)
        first, which = distinct_rows(full)
        order = np.lexsort((first, self.hash[pick][first]))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, back[which], self.ids[doc])
        return full[first[order]], self.hash[pick][first[order]], least, pick, back[which], left


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, padded with zeros."""
    wide = np.zeros((len(rows), rows.shape[1] + -rows.shape[1] % 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(np.uint64)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    out, words = np.full(len(rows), _G[0]), _words(rows)
    for j in range(words.shape[1]):
        out = mix64(out ^ words[:, j])
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct row, and each row's place among them; by hash, and checked byte by byte."""
    _, first, which = np.unique(row_hashes(rows), return_index=True, return_inverse=True)
    if not np.array_equal(rows[first][which], rows):
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, which


def _is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


CONTEXT = 2 + SPAN - 1 + LENGTH
ALL_WINDOWS = np.uint32((1 << SPAN) - 1)


def anchor_hashes(contexts: np.ndarray) -> np.ndarray:
    words = _words(contexts[:, 2 + SPAN - 1 : 2 + SPAN - 1 + GRAM])
    return mix64(words[:, 0] * _G[0] + words[:, 1] * _G[1] + words[:, 2] * _G[2])


def repeated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, spans (flat from-to pairs of bytes), kept_sha256."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    total = docs.agg(F.sum(bytes_of("text"))).first()[0] or 0
    folder = work_dir(spark)
    name = f"corvane_{folder.rsplit('-', 1)[1]}"
    _batches(docs).write.option("path", f"{folder}/batches").option("compression", "none").bucketBy(parts, "b").saveAsTable(name)
    held = spark.table(name)
    bits = min(64, max(32, math.ceil(math.log2(max(2, total / 13))) + 14))
    ranges = max(min(parts, 1 + total // (1 << 20)), total // RANGE_BYTES + 1)
    fine = max(ranges, total // CONTEXT_RANGE_BYTES + 1)

    def make_hashes():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {"r": [], "b": [], "data": []}
            for b, ids, lens, data in zip(*(batch.column(c).to_pylist() for c in ("b", "ids", "lens", "data")), strict=True):
                x = _Batch(ids, lens, data, bits, ranges)
                for r in range(ranges):
                    own = x.distinct[x.cuts[r] : x.cuts[r + 1]]
                    if len(own):
                        out["r"].append(r)
                        out["b"].append(b)
                        out["data"].append(pack_sorted(own))
            return out

        return run

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack_sorted(bytes(d)) for d in pdf["data"]]
        every = np.sort(np.concatenate(lists))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        return pd.DataFrame({"r": pdf["r"], "b": pdf["b"], "bits": [zstandard.compress(np.packbits(_is_in(x, twice)).tobytes()) for x in lists]})

    hashes = map_batches(held, make_hashes, "r int, b long, data binary", 1)
    known = stage(hashes.groupBy("r").applyInPandas(answer, "r int, b long, bits binary"), "shared")
    mine = known.groupBy("b").agg(F.collect_list(F.struct("r", "bits")).alias("answers"))

    def shared_of(x: _Batch, answers) -> np.ndarray:
        shared = x.own_shared()
        for a in answers or []:
            lo, hi = x.cuts[a["r"]], x.cuts[a["r"] + 1]
            shared[lo:hi] |= np.unpackbits(np.frombuffer(zstandard.decompress(a["bits"]), np.uint8), count=hi - lo).astype(bool)
        return shared

    def make_contexts():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {"r": [], "b": [], "data": [], "least": []}
            for b, ids, lens, data, answers in zip(*(batch.column(c).to_pylist() for c in ("b", "ids", "lens", "data", "answers")), strict=True):
                x = _Batch(ids, lens, data, bits, ranges)
                full, hashes, least, *_ = x.contexts(shared_of(x, answers))
                cuts = np.searchsorted(_range_of(hashes, fine), np.arange(fine + 1))
                for k in range(fine):
                    lo, hi = cuts[k], cuts[k + 1]
                    if hi > lo:
                        for col, v in zip(out, (k, b, zstandard.compress(full[lo:hi].tobytes(), 3), pack(least[lo:hi])), strict=True):
                            out[col].append(v)
            return out

        return run

    contexts = map_batches(held.join(mine, "b", "left"), make_contexts, "r int, b long, data binary, least binary", 1)
    masks = stage(contexts.groupBy("r").applyInPandas(judge, "r int, b long, masks binary"), "masks")
    found = masks.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("r", "masks"))).alias("masks"))

    def make_result():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept_sha256": []}
            for ids, lens, data, answers, masks in zip(*(batch.column(c).to_pylist() for c in ("ids", "lens", "data", "answers", "masks")), strict=True):
                x = _Batch(ids, lens, data, bits, ranges)
                _, _, least, pick, which, left = x.contexts(shared_of(x, answers))
                mask = np.concatenate([unpack(m["masks"], np.uint32) for m in masks]) if masks else np.zeros(0, np.uint32)
                marks = np.zeros(len(x.bytes) + 1, np.int64)
                at, doc = x.at[pick], x.doc[pick]
                later = x.ids[doc] > least[which]
                room = x.ends[doc] - at
                for j in range(SPAN):  # the window that starts SPAN - 1 - j bytes before the anchor
                    back = SPAN - 1 - j
                    on = (left >= back) & (room >= LENGTH - back) & (later | ((mask[which] >> np.uint32(j)) & np.uint32(1) > 0))
                    np.add.at(marks, at[on] - back, 1)
                    np.add.at(marks, at[on] - back + LENGTH, -1)
                covered = np.cumsum(marks[:-1]) > 0
                start = 0
                for doc_id, end in zip(ids, x.ends.tolist(), strict=True):
                    own, text = covered[start:end], x.bytes[start:end]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    for col, v in zip(out, (doc_id, end - start, int(own.sum()), len(edge) // 2, edge.tolist(), hashlib.sha256(text[~own].tobytes()).hexdigest()), strict=True):
                        out[col].append(v)
                    start = end
            return out

        return run

    full = held.join(mine, "b", "left").join(found, "b", "left")
    out = map_batches(full, make_result, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept_sha256 string", 1)
    out = stage(out, "repeats")
    spark.sql(f"DROP TABLE {name}")
    delete(spark, folder)
    unstage(known, masks)
    return out


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Hash range of each context, by the top 32 bits of its anchor's hash."""
    return (((hashes >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)


def _seen_twice(values: np.ndarray) -> np.ndarray:
    _, which, n = np.unique(values, return_inverse=True, return_counts=True)
    return n[which] > 1


def judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each batch's contexts in a hash range: bits of the windows that a smaller doc_id than its smallest has."""
    blocks = [np.frombuffer(zstandard.decompress(bytes(d)), np.uint8).reshape(-1, CONTEXT) for d in pdf["data"]]
    least = [unpack(bytes(d), np.int64) for d in pdf["least"]]
    cuts = np.cumsum([0, *map(len, least)])
    full, least = np.concatenate(blocks), np.concatenate(least)
    del blocks
    first, which = distinct_rows(full)
    distinct = full[first]
    del full
    owner = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, least)
    bits = np.where(owner[which] < least, ALL_WINDOWS, np.uint32(0))
    # A window has half of the bytes that it holds besides the anchor before it or after it. So contexts that share a
    # window share the anchor with HALF bytes before or after; the others need no index.
    at = 2 + SPAN - 1
    before = row_hashes(distinct[:, at - HALF : at + GRAM])
    after = row_hashes(distinct[:, at : at + GRAM + HALF])
    some = np.flatnonzero((_seen_twice(before) & (distinct[:, 0] >= HALF)) | (_seen_twice(after) & (distinct[:, 1] >= GRAM + HALF)))
    hashes = anchor_hashes(distinct[some])
    some = some[np.argsort(hashes, kind="stable")]
    hashes = np.sort(hashes)
    ends = np.append(np.flatnonzero(hashes[1:] != hashes[:-1]) + 1, len(some)) if len(some) else np.zeros(0, int)
    place = np.full(len(first), -1)
    a = 0
    while a < len(some):
        b = int(ends[max(np.searchsorted(ends, a, side="right"), np.searchsorted(ends, a + INDEX // CONTEXT, side="right") - 1)])
        rows = some[a:b]
        windows = _windows(distinct[rows], owner[rows])
        place[rows] = np.arange(len(rows))
        mine = np.flatnonzero(place[which] >= 0)
        earlier = windows[place[which[mine]]] < least[mine][:, None]
        bits[mine] = (earlier.astype(np.uint32) << np.arange(SPAN, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        place[rows] = -1
        a = b
    return pd.DataFrame({"r": pdf["r"], "b": pdf["b"], "masks": [pack(bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]})


def _windows(contexts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """contexts x SPAN: smallest owner of each window, by the index; owners' largest value where there is no window."""
    left, right = contexts[:, 0].astype(np.int64), contexts[:, 1].astype(np.int64)
    col = np.arange(CONTEXT - 2)
    inside = (col >= (SPAN - 1 - left)[:, None]) & (col < (SPAN - 1 + right)[:, None])
    strings = contexts[:, 2:][inside]
    index = RunIndex(strings, np.cumsum(left + right))
    found = index.least_by_window(owner, SPAN + 1)
    out = np.full((len(contexts), SPAN), np.iinfo(np.int64).max)
    # a string starts `left` bytes before its anchor, a window j at most SPAN - 1 - j
    for j in range(SPAN):
        at = j - (SPAN - 1 - left)
        ok = (at >= 0) & (right >= LENGTH - (SPAN - 1 - j))
        out[ok, j] = found[ok, at[ok]]
    return out


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

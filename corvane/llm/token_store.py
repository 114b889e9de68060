"""Token ids in a content-addressed store (operator 1).

Documents are encoded, each followed by an end id, and every id stream is cut into chunks where a rolling hash over the
last eight ids has zeros in its top bits, so that equal passages give equal chunks wherever they stand. A chunk is named
by the BLAKE2b-128 of its ids (little-endian, 32 bits) and stored once; a document is a recipe of chunk names.

Files, all Parquet, below one folder:
  chunks/   digest, n, width, uses, data   unique chunks; data is the ids, width (2 or 4) bytes each, in pages compressed
                                           with zstd
  docs/     doc_id, at, n_tokens, digests, lens, root, pack, seq   one file a pack, packs and their rows in ascending
                                                                   order of doc_id; at counts from the pack's start
  manifest/ pack, n_docs, n_tokens, start, root   Merkle roots over the documents' roots of a pack
  top/      n_packs, n_docs, n_tokens, root       one row, over the packs

Memory is bounded by a batch; the only rows that are brought together are unique chunks (by digest, pre-aggregated in
each batch and each map task) and recipes (by ranges of doc_id). A reader checks the packs against the manifest and the
manifest against its top, each chunk against its name, each recipe against its root and its chunks' lengths, and combines
the chunks' CRC-32s along the recipes, so that verifying moves no ids. Chunks with more than 1/FREQUENT of all uses (at
most FREQUENT) are answered by broadcast, so that a chunk that very many documents share is no hot key.

Defined results: null and empty texts are the end id alone; equal texts share all their chunks; a very long text is cut
and stored like others, its recipe (24 bytes a chunk) is one row; rows with equal doc_ids or null ones (first) each get a
row, in order of their root; an empty table gives empty files; further columns of documents are ignored. A missing or
changed file of any of the four folders is an error.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, kept, map_batches, table, work_dir

END = 0
LEAST, MOST, SPAN, TOP_BITS = 64, 4096, 8, 9
#: Texts that are encoded uncut: runs of white space, a last line feed after another, white space other than a space or a
#: line feed by Unicode (which includes the marks below).
_UNCUT = "  |\\n | \\n|\\n\\n\\n|\\n\\n\\z|[\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

#: Stand for "no space before" and for a line feed before a piece; texts that hold them are encoded uncut.
BARE, FEED = "\x1f", "\x1e"


def _spelled() -> str:
    """Byte-level BPE writes each byte as a character: printable ones as they are, the others from U+0100 on. Here line
    feeds stay, as they part the words."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)} | {10: "\n"}
    return "".join(spelled[b] for b in range(256))


_SPELLED = _spelled()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of so many items from those starts."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


# ---- encoding -------------------------------------------------------------------------------------------------------
class Encoder:
    """Ids of whole texts, gathered from those of pieces, each of which is encoded once while it is remembered.

    A byte-level BPE's pre-tokenizer always cuts before a space that stands between other characters, around a line feed
    between other characters, and between a letter and a full stop or comma. Texts are cut there, and only there; texts
    with other runs of white space, with rarer white space, or with marks after something else than a letter are encoded
    uncut. Pieces are found and remembered as Arrow arrays; new ones are encoded together, and the ids are dealt back to
    them by the lengths of their tokens."""

    def __init__(self, path: str, remember: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel; a thread pool in each worker only holds memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes that each token stands for.
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.remember = remember
        self.feed = self._encode(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self.pieces = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 256):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        return out

    def _encode_runs(self, runs: pa.Array, lead: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each has, of runs of characters that are one pre-token each after `lead` (nothing or a space);
        the BPE model takes them, spelled in its characters, without the steps before it."""
        ids, sizes, merge = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], self.tokenizer.model.tokenize
        gap = np.frombuffer(b"\n" + lead, np.uint8)
        for i in range(0, len(runs), 1 << 15):
            some = pa.concat_arrays([runs[i : i + (1 << 15)]])
            at = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
            lengths = np.diff(at)
            lines = np.empty(at[-1] - at[0] + len(gap) * len(some), np.uint8)
            inside = np.ones(len(lines), bool)
            starts = at[:-1] - at[0] + len(gap) * np.arange(len(some))
            for j, x in enumerate(gap):
                lines[starts + j], inside[starts + j] = x, False
            lines[inside] = np.frombuffer(some.buffers()[2], np.uint8)[at[0] : at[-1]]
            spelled = codecs.charmap_decode(lines[1:].tobytes(), "strict", _SPELLED)[0]
            own = np.array([t.id for x in spelled.split("\n") for t in merge(x)], "<u4")
            # every byte is in a token, so the bytes tell whose tokens they are
            ends = np.searchsorted(np.cumsum(self.lengths[own]), np.cumsum(lengths + len(lead))) + 1
            ids.append(own)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode_others(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = self._encode(parts)
        return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4

    def _add(self, new: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _learn(self, new: pa.Array) -> None:
        """Remembers new pieces, by kinds: words of letters, such with other signs after them, letters after a line feed,
        and the rest."""
        words = pc.utf8_is_alpha(new)
        ended = pc.and_not(pc.match_substring_regex(new, r"^\pL+[^\pL\pN\s']+$"), words)
        fed = pc.match_substring_regex(new, f"^{FEED}\\pL+$")
        rest = pc.invert(pc.or_(pc.or_(words, ended), fed))
        words, ended, fed, rest = (new.filter(x) for x in (words, ended, fed, rest))
        heads = tails = None
        if len(ended):
            both = pc.extract_regex(ended, r"^(?P<head>\pL+)(?P<tail>[^\pL\pN\s']+)$")
            heads, tails = both.field("head").dictionary_encode(), both.field("tail").dictionary_encode()
            more = heads.dictionary.filter(pc.equal(pc.index_in(heads.dictionary, value_set=self.pieces).fill_null(-1), -1))
            words = pc.unique(pa.concat_arrays([words, more]))
        self._add(words, *self._encode_runs(words, b" "))
        if len(ended):
            # their ids are those of the word and those of the signs
            place = self._find(heads.dictionary)[heads.indices.to_numpy()]
            tail_ids, tail_sizes = self._encode_runs(tails.dictionary)
            tail = tails.indices.to_numpy()
            n, m = self.sizes[place], tail_sizes[tail]
            ids = np.empty((n + m).sum(), "<u4")
            starts = np.cumsum(n + m) - (n + m)
            ids[_spread(starts, n)] = self.ids[_spread((np.cumsum(self.sizes) - self.sizes)[place], n)]
            ids[_spread(starts + n, m)] = tail_ids[_spread((np.cumsum(tail_sizes) - tail_sizes)[tail], m)]
            self._add(ended, ids, n + m)
        if len(fed):
            ids, sizes = self._encode_runs(pc.utf8_slice_codeunits(fed, 1))
            feed = np.frombuffer(self.feed, "<u4")
            out = np.empty(len(ids) + len(feed) * len(fed), "<u4")
            starts = np.cumsum(sizes + len(feed)) - (sizes + len(feed))
            for j, x in enumerate(feed):
                out[starts + j] = x
            out[_spread(starts + len(feed), sizes)] = ids
            self._add(fed, out, sizes + len(feed))
        parts = [x[1:] if x[:1] == BARE else "\n" + x[1:] if x[:1] == FEED else " " + x for x in rest.to_pylist()]
        self._add(rest, *self._encode_others(parts))

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """Where each piece is remembered; -1 for new ones."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNCUT).fill_null(False).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(odd).tolist()
        cut = [i for i, t in enumerate(texts) if t and not odd[i]]
        if cut:
            marked = pa.array([texts[i].replace(", ", f" {BARE}, ").replace(". ", f" {BARE}. ").replace(".\n", f" {BARE}.\n").replace("\n", f" {FEED}") for i in cut], pa.large_string())
            lists = pc.split_pattern(marked, pattern=" ")
            del marked
            at = lists.offsets.to_numpy()
            coded = lists.values.dictionary_encode()
            del lists
            which, distinct = coded.indices.to_numpy(), coded.dictionary
            # a mark must stand after a letter, within the text
            at_mark = np.flatnonzero(pc.starts_with(distinct, BARE).to_numpy(zero_copy_only=False)[which])
            before = which[np.maximum(at_mark - 1, 0)]
            some = np.flatnonzero(np.bincount(before, minlength=len(distinct)))
            letter = np.zeros(len(distinct), bool)
            letter[some] = pc.utf8_is_alpha(pc.utf8_slice_codeunits(distinct.take(pa.array(some)), -1)).to_numpy(zero_copy_only=False)
            first = np.zeros(len(which) + 1, bool)
            first[at[:-1]] = True
            wrong = {*np.searchsorted(at, at_mark[~letter[before] | first[at_mark]], side="right").tolist()}
            heads = distinct.take(pa.array(which[at[:-1]])).to_pylist()  # the first piece of a text stands after no space
            if len(self.pieces) > self.remember:
                self._forget()
            found = self._find(distinct)
            fresh = pa.array(found < 0)
            if pc.any(fresh).as_py():
                self._learn(distinct.filter(fresh))
                found = self._find(distinct)
            place = found[which]
            n = self.sizes[place]
            n[at[:-1]] = 0
            ends = np.cumsum(n)
            gathered = self.ids[_spread((np.cumsum(self.sizes) - self.sizes)[place], n)].tobytes()
            bounds = [0, *(4 * ends[at[1:] - 1]).tolist()]
            for k, (i, head, a, b) in enumerate(zip(cut, self._encode(heads), bounds, bounds[1:], strict=False)):
                if k + 1 in wrong:
                    whole.append(i)
                else:
                    out[i] = head + gathered[a:b]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    """One in each Python worker."""
    return kept(f"encoder {path}", lambda: Encoder(path))


# ---- cutting --------------------------------------------------------------------------------------------------------
def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEAR = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places in id streams, one after the other, where the rolling hash would cut. It looks at SPAN ids, and chunks have
    at least LEAST, so what it sees across the start of a stream is never a cut."""
    gear = _GEAR[ids] if not len(ids) or int(ids.max()) < len(_GEAR) else mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    rolled = gear.copy()
    for j in range(1, SPAN):
        rolled[j:] += gear[:-j] << np.uint64(j * 5)
    return np.flatnonzero(rolled >> np.uint64(64 - TOP_BITS) == 0) + 1


def cut_points(marks: list[int], n: int, most: int = MOST, least: int = LEAST) -> list[int]:
    """Ends of the chunks of a stream of n ids with marks at these places in it."""
    ends, last = [], 0
    for at in marks:
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            last = at
            ends.append(last)
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def unpack_ids(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4").astype("<u4")


def name_of(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.blake2b(b"", digest_size=16).digest()


# ---- CRC-32 over recipes --------------------------------------------------------------------------------------------
def _operators() -> np.ndarray:
    """operators[k][b]: what bit b of a CRC register becomes after 2**k zero bytes."""
    one = np.empty(32, dtype=np.uint32)
    for b in range(32):
        r = 1 << b
        for _ in range(8):
            r = (r >> 1) ^ (0xEDB88320 if r & 1 else 0)
        one[b] = r
    out = [one]
    for _ in range(47):
        out.append(_apply(out[-1], out[-1]))
    return np.array(out)


def _apply(operator: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for b in range(32):
        out ^= np.where((values >> np.uint32(b)) & np.uint32(1), operator[b], np.uint32(0))
    return out


OPERATORS = _operators()


def crc_shift(values: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes each."""
    out, zeros = values.astype(np.uint32).copy(), zeros.astype(np.uint64)
    k = 0
    while len(zeros) and int(zeros.max()) >> k:
        on = np.flatnonzero((zeros >> np.uint64(k)) & np.uint64(1))
        if len(on):
            out[on] = _apply(OPERATORS[k], out[on])
        k += 1
    return out


ALL = np.uint32(0xFFFFFFFF)


def crc_bare(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32s without the initial and final complement, which are linear over concatenation."""
    return crcs.astype(np.uint32) ^ ALL ^ crc_shift(np.full(len(crcs), ALL), lengths)


def crc_whole(bare: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return bare.astype(np.uint32) ^ ALL ^ crc_shift(np.full(len(bare), ALL), lengths)


# ---- writing --------------------------------------------------------------------------------------------------------
STAGED = "doc_id long, n_tokens long, digests binary, lens array<int>, root binary, digest binary, n int, width int, uses long, data binary"
FAN, FREQUENT = 4096, 4096


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END) -> None:
    """docs(doc_id, text) -> the store's files below path."""
    spark = docs.sparkSession

    def make():
        encode = encoder(tokenizer)
        tail = np.array([end_id], dtype="<u4").tobytes()

        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("doc_id", "n_tokens", "digests", "lens", "root", "digest", "n", "width", "uses", "data")}
            seen: dict[bytes, list[int]] = {}
            raw = [r + tail for r in encode(batch.column("text").to_pylist())]
            ids = np.frombuffer(b"".join(raw), "<u4")
            stops = np.cumsum([len(r) // 4 for r in raw])
            marks = cut_marks(ids)
            at = np.searchsorted(marks, stops, side="right").tolist()
            start = first = 0
            for stop, last, r in zip(stops.tolist(), at, raw, strict=True):
                names, a = [], 0
                ends = cut_points((marks[first:last] - start).tolist(), stop - start)
                for b in ends:
                    names.append(name := name_of(r[4 * a : 4 * b]))
                    if name in seen:
                        seen[name][2] += 1
                    else:
                        seen[name] = [start + a, start + b, 1]
                    a = b
                out["n_tokens"].append(stop - start)
                out["digests"].append(b"".join(names))
                out["lens"].append(np.diff(ends, prepend=0))
                out["root"].append(merkle(names))
                start, first = stop, last
            docs, chunks = len(raw), len(seen)
            nothing = [None] * chunks
            for k in ("n_tokens", "digests", "lens", "root"):
                out[k] += nothing
            out["doc_id"] = batch.column("doc_id").to_pylist() + nothing
            out["digest"] = [None] * docs + list(seen)
            width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
            packed = ids.astype(f"<u{width}").tobytes()
            out["n"] = [None] * docs + [b - a for a, b, _ in seen.values()]
            out["width"] = [None] * docs + [width] * chunks
            out["uses"] = [None] * docs + [n for _, _, n in seen.values()]
            out["data"] = [None] * docs + [packed[width * a : width * b] for a, b, _ in seen.values()]
            return out

        return run

    both = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, STAGED, 16 << 20)
    both.write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema(both.schema).parquet(f"{path}/staged")
    first = [F.first(c).alias(c) for c in ("n", "width")]
    chunks = staged.where("digest IS NOT NULL").groupBy("digest").agg(*first, F.sum("uses").alias("uses"), F.first("data").alias("data"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = staged.where("digest IS NULL").select("doc_id", "n_tokens", "digests", "lens", "root")
    ranged = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")

    def number(batches):
        from pyspark import TaskContext

        pack, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = np.array(batch.column("n_tokens"), dtype=np.int64)
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), pack, np.int32)), pa.array(seq + np.arange(len(n), dtype=np.int64)), pa.array(ends - n)], names=[*batch.schema.names, "pack", "seq", "at"])
            seq, start = seq + len(n), int(ends[-1]) if len(n) else start

    # a task writes its pack as one file, and files are named in the packs' order
    numbered = ranged.mapInArrow(number, "doc_id long, n_tokens long, digests binary, lens array<int>, root binary, pack int, seq long, at long")
    numbered.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{path}/docs")
    delete(spark, f"{path}/staged")
    _packs(spark, path).write.parquet(f"{path}/manifest")
    _top(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/top")


def _rolled(column: str) -> Column:
    """Digest of the roots in an array of structs, in its order."""
    return F.unhex(F.sha2(F.concat(F.lit(b"\1"), F.expr(f"aggregate({column}, cast('' as binary), (a, p) -> concat(a, p.root))")), 256))


def _packs(spark: SparkSession, path: str) -> DataFrame:
    """The manifest that docs/ should have. Roots of the packs, each over at most FAN documents' roots and then over those
    of its parts; one row a file afterwards, so the window over them is small."""
    docs = spark.read.parquet(f"{path}/docs").select("pack", "seq", "at", "n_tokens", "root").withColumn("part", F.floor(F.col("seq") / FAN))

    def roots(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq")
        n = pdf["n_tokens"].to_numpy()
        first = int(pdf["at"].iloc[0])
        whole = np.array_equal(pdf["at"].to_numpy(), first + np.cumsum(n) - n) and np.array_equal(pdf["seq"].to_numpy(), pdf["part"].to_numpy() * FAN + np.arange(len(pdf)))
        return pd.DataFrame({"pack": pdf["pack"].iloc[:1], "part": pdf["part"].iloc[:1], "n_docs": [len(pdf)], "n_tokens": [n.sum()], "root": [merkle([bytes(x) for x in pdf["root"]]) if whole else b"broken"]})

    parts = docs.groupBy("pack", "part").applyInPandas(roots, "pack int, part long, n_docs long, n_tokens long, root binary")
    whole = parts.groupBy("pack").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "root"))).alias("parts"))
    before = Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select("pack", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), _rolled("parts").alias("root"))


def _top(packs: DataFrame) -> DataFrame:
    some = packs.groupBy(F.floor(F.col("pack") / FAN).alias("pack")).agg(
        F.count(F.lit(1)).alias("n_packs"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("pack", "start", "root"))).alias("parts")
    )
    some = some.select("pack", "n_packs", "n_docs", "n_tokens", _rolled("parts").alias("root"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_packs", "n_docs", "n_tokens")]
    return some.agg(*sums, F.sort_array(F.collect_list(F.struct("pack", "root"))).alias("parts")).select("n_packs", "n_docs", "n_tokens", _rolled("parts").alias("root"))


# ---- reading --------------------------------------------------------------------------------------------------------
def read_chunks(spark: SparkSession, path: str, which: str = "true") -> DataFrame:
    """digest, n, bare: each chunk of those, checked against its name, with the bare CRC-32 of its ids."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            names, crcs = batch.column("digest").to_pylist(), []
            data, widths = batch.column("data").to_pylist(), batch.column("width").to_pylist()
            ns = [len(d) // w for d, w in zip(data, widths, strict=True)]
            if len(set(widths)) == 1:
                whole = memoryview(unpack_ids(b"".join(data), widths[0]).tobytes())
            else:
                whole = memoryview(b"".join(unpack_ids(d, w).tobytes() for d, w in zip(data, widths, strict=True)))
            a = 0
            for name, k in zip(names, ns, strict=True):
                raw = whole[a : a + 4 * k]
                a += 4 * k
                if name_of(raw) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                crcs.append(zlib.crc32(raw))
            n = np.array(ns, dtype=np.int64)
            return {"digest": batch.column("digest"), "n": n, "bare": crc_bare(np.array(crcs, dtype=np.uint32), 4 * n).astype(np.int64)}

        return run

    chunks = spark.read.parquet(f"{path}/chunks").where(which)
    return map_batches(chunks.select("digest", "width", "data"), make, "digest binary, n long, bare long")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Fails if the packs of docs/ are not those of manifest/, by number, counts, start and root, or if the manifest is not
    what top/ says."""
    told = spark.read.parquet(f"{path}/manifest")
    top = [tuple(r) for r in spark.read.parquet(f"{path}/top").collect()]  # one row
    if top != [tuple(r) for r in _top(told).collect()]:
        raise ValueError("the manifest differs from its top")
    packed = F.struct("n_docs", "n_tokens", "start", "root")
    found = _packs(spark, path).select("pack", packed.alias("found"))
    wrong = found.join(told.select("pack", packed.alias("told")), "pack", "full").where("NOT found <=> told").select("pack").limit(1).collect()
    if wrong:
        raise ValueError(f"pack {wrong[0]['pack']} differs from the manifest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, root of each document, from the files alone; fails if a chunk, or a document of the manifest, is missing."""
    check_manifest(spark, path)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("start", "digest", "rest", "len", "doc_id", "n_tokens", "high", "low")}
            for doc_id, start, names, lens, n, root in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "digests", "lens", "n_tokens", "root")), strict=True):
                leaves = [names[i : i + 16] for i in range(0, len(names), 16)]
                if merkle(leaves) != root or len(leaves) != len(lens):
                    raise ValueError(f"the recipe at {start} is damaged")
                ends, nothing = np.cumsum(lens), [None] * (len(leaves) - 1)
                out["start"] += [start] * len(leaves)
                out["digest"] += leaves
                out["rest"] += (4 * (ends[-1] - ends)).tolist()
                out["len"] += lens
                for k, v in (("doc_id", doc_id), ("n_tokens", n), ("high", int.from_bytes(root[:8], "big", signed=True)), ("low", int.from_bytes(root[8:], "big", signed=True))):
                    out[k].append(v)
                    out[k] += nothing
            return out

        return run

    docs = spark.read.parquet(f"{path}/docs").join(spark.read.parquet(f"{path}/manifest").select("pack", F.col("start").alias("before")), "pack").withColumn("start", F.col("before") + F.col("at"))
    uses = map_batches(docs.select("doc_id", "start", "digests", "lens", "n_tokens", "root"), make, "start long, digest binary, rest long, len int, doc_id long, n_tokens long, high long, low long")
    often = int((spark.read.parquet(f"{path}/chunks").agg(F.sum("uses")).first()[0] or 0) // FREQUENT) + 1000
    known = [read_chunks(spark, path, f"uses {op} {often}").select("digest", F.col("n").alias(f"n_{k}"), F.col("bare").alias(f"bare_{k}")) for k, op in (("often", ">"), ("else", "<="))]
    uses = uses.join(F.broadcast(known[0]), "digest", "left")
    # answered uses keep out of the others' join, each under a key of its own
    uses = uses.withColumn("digest", F.when(F.col("n_often").isNull(), F.col("digest")).otherwise(F.encode(F.col("start").cast("string"), "UTF-8")))
    joined = uses.join(known[1], "digest", "left").withColumn("n", F.coalesce("n_often", "n_else")).withColumn("bare", F.coalesce("bare_often", "bare_else"))

    def make_shift():
        def run(batch: pa.RecordBatch) -> dict:
            if batch.column("bare").null_count:
                raise ValueError("a chunk is missing")
            if not np.array_equal(batch.column("n"), batch.column("len")):
                raise ValueError("a recipe's length is wrong")
            bare = np.array(batch.column("bare"), dtype=np.int64).astype(np.uint32)
            return {c: batch.column(c) for c in ("start", "n", "doc_id", "n_tokens", "high", "low")} | {"part": crc_shift(bare, np.array(batch.column("rest"), dtype=np.int64)).astype(np.int64)}

        return run

    parts = map_batches(joined.select("start", "rest", "bare", "n", "len", "doc_id", "n_tokens", "high", "low"), make_shift, "start long, part long, n long, doc_id long, n_tokens long, high long, low long")
    own = [F.max(c).alias(c) for c in ("doc_id", "n_tokens", "high", "low")]  # of one row each
    whole = parts.groupBy("start").agg(F.bit_xor("part").alias("bare"), F.sum("n").alias("n"), *own)

    def make_whole():
        def run(batch: pa.RecordBatch) -> dict:
            n = np.array(batch.column("n"), dtype=np.int64)
            if not np.array_equal(n, np.array(batch.column("n_tokens"), dtype=np.int64)):
                raise ValueError("a recipe's length is wrong")
            crc = crc_whole(np.array(batch.column("bare"), dtype=np.int64).astype(np.uint32), 4 * n).astype(np.int64)
            roots = np.stack([np.array(batch.column(c), dtype=">i8") for c in ("high", "low")], axis=1).tobytes()
            return {c: batch.column(c) for c in ("doc_id", "start", "n_tokens")} | {"ids_crc32": crc, "root": [roots[i : i + 16] for i in range(0, len(roots), 16)]}

        return run

    return map_batches(whole, make_whole, "doc_id long, start long, n_tokens long, ids_crc32 long, root binary")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: the documents put together again from their chunks."""
    docs = spark.read.parquet(f"{path}/docs").join(spark.read.parquet(f"{path}/manifest").select("pack", F.col("start").alias("before")), "pack")
    uses = docs.select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lens") - 1), lambda i: F.substring(F.col("digests"), i * 16 + 1, F.lit(16)))).alias("k", "digest"))
    full = uses.join(spark.read.parquet(f"{path}/chunks").select("digest", "width", "data"), "digest")

    def gather(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "start": pdf["start"].iloc[:1], "ids": [np.concatenate([unpack_ids(bytes(d), w) for d, w in zip(pdf["data"], pdf["width"], strict=True)]).astype(np.int64).tolist()]})

    return full.groupBy("start").applyInPandas(gather, "doc_id long, start long, ids array<long>")


def store_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the store into the shared folder and verify it from its files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = work_dir(docs.sparkSession)
    write_store(docs, path, tokenizer)
    return verify(docs.sparkSession, path).withColumn("root", F.lower(F.hex("root")))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_tokens(table(spark, sf_dir, "documents"))

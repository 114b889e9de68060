"""Benchmark decontamination by one Aho-Corasick automaton (operator 2).

Texts are normalised alike: A-Z lower-cased, words are runs of 0-9, a-z and every character from U+0080. An item's
windows are its runs of `window` words (a shorter item, but not an empty one, is one window). All windows go into one
Aho-Corasick automaton over normalised text, which passes every document once; words inside a found window are hit, and
spans of hits are mapped back to offsets in the original text.

The automaton is built from the broadcast windows once in each Python worker. Windows are broadcast in blocks of at most
BLOCK_BYTES; a larger benchmark takes further passes over the documents, each adding to the hits of the one before, so
what is held never grows with the benchmark or the corpus; what a pass leaves is staged before the next.

Defined results: null or wordless text has no words and no hits; a null item_id counts as no item in the list of ids but
its windows hit; items without words are ignored; a very long text is scanned whole, as one line; item ids are integers; repeated rows are judged alike; an empty benchmark hits nothing;
further columns of documents are dropped by scan() and kept by drop_contaminated().
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_batches, stage, table, unstage

WINDOW = 10
#: Of normalised windows held by one automaton; about 40 times that in memory at the very most.
BLOCK_BYTES = 6 << 20
ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes to bytes: A-Z to a-z, separators to spaces; the bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows_of(text: str | None, window: int = WINDOW) -> list[bytes]:
    words = normal_words(text)
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def window_blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> Iterator[dict[bytes, dict]]:
    """Windows with the ids of their items, in blocks of bounded size; at least one block."""
    block, held = {}, 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        for w in windows_of(row["text"], window):
            if w not in block:
                block[w], held = {}, held + len(w) + 64
            if row["item_id"] not in block[w]:
                block[w][row["item_id"]] = None
                held += 64
            if held > most:
                yield block
                block, held = {}, 0
    yield block


class Scanner:
    """Finds the windows of one block."""

    def __init__(self, block: dict[bytes, dict]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        self.ids = [list(x) for x in block.values()]
        for k, w in enumerate(block):
            self.found.add_word(f" {w.decode('latin-1')} ", (k, w.count(b" ") + 1, len(w)))
        if block:
            self.found.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, maximal runs of hit words as [from, to), ids of the items found."""
        words = normal_words(text)
        if not words or not self.ids:
            return len(words), [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        ends, ids = [], set()
        for end, (k, n, _) in self.found.iter(line):
            ends.append((end, n))
            ids.update(self.ids[k])
        if not ends:
            return len(words), [], ids
        # the word that ends before the space at `end` has as many spaces up to it as its number
        at = np.cumsum(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        return len(words), union((int(at[e]) - 1 - n, int(at[e]) - 1) for e, n in ends), ids


def union(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as offsets of characters in the original text."""
    if not runs:
        return []
    at = [m.span() for m in ORIGINAL.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


SCHEMA = "doc_id long, n_words long, n_hit long, items array<long>, runs array<int>, spans array<int>"


def _scanner_of(spark: SparkSession, block: dict[bytes, dict]) -> tuple[Broadcast, Callable[[], Scanner]]:
    shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex
    return shared, lambda: kept(key, lambda: Scanner(shared.value))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> one row a document: n_words, n_hit, items (sorted ids found), runs
    (hit words, flat from-to pairs) and spans (the same as offsets in the original text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return _by_blocks(docs, benchmark, window, block_bytes, _pass).drop("text")


def _by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, step: Callable[[DataFrame, Callable[[], Scanner], bool], DataFrame]) -> DataFrame:
    """step with one block's scanner after the other; what a block leaves is staged before the next one is broadcast."""
    before: list = []
    for block in window_blocks(benchmark, window, block_bytes):
        if before:
            held, staged = before
            docs = stage(docs, "passed")
            held.destroy()
            if staged is not None:
                unstage(staged)
        shared, scanner_of = _scanner_of(docs.sparkSession, block)
        before, docs = [shared, docs if before else None], step(docs, scanner_of, bool(before))
    return docs


def _pass(docs: DataFrame, scanner_of: Callable[[], Scanner], more: bool) -> DataFrame:
    def make():
        scanner = scanner_of()

        def run(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            before = zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True) if more else (([], []) for _ in texts)
            out = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": [], "n_hit": [], "items": [], "runs": [], "spans": []}
            for text, (runs, items) in zip(texts, before, strict=True):
                n, found, ids = scanner(text)
                found = union([*found, *zip(runs[::2], runs[1::2], strict=True)]) if runs else found
                out["n_words"].append(n)
                out["n_hit"].append(sum(b - a for a, b in found))
                out["items"].append(sorted({*(x for x in ids if x is not None), *items}) if ids or items else [])
                out["runs"].append([x for r in found for x in r])
                out["spans"].append([x for s in spans_of(text, found) for x in s] if found else [])
            return out

        return run

    return map_batches(docs, make, SCHEMA + ", text string")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns."""
    return _by_blocks(docs, benchmark, window, block_bytes, _clean)


def _clean(docs: DataFrame, scanner_of: Callable[[], Scanner], more: bool) -> DataFrame:
    def run(batches):
        scanner = scanner_of()
        for batch in batches:
            keep = pa.array([not scanner(t)[1] for t in batch.column("text").to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), v AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM w
), windows AS (
  SELECT id AS item_id, least(len(words), 10) AS n, array_to_string(list_slice(words, k, k + 9), ' ') AS g
  FROM v, unnest(range(1, greatest(len(words) - 8, 2))) AS t(k) WHERE kind = 'i' AND len(words) > 0
), grams AS (
  SELECT id AS doc_id, k, n, array_to_string(list_slice(words, k, k + n - 1), ' ') AS g
  FROM v, (SELECT DISTINCT n FROM windows) AS l, unnest(range(1, len(words) - n + 2)) AS t(k) WHERE kind = 'd'
), found AS (
  SELECT doc_id, k, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT v.id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM v LEFT JOIN hit ON v.id = hit.doc_id LEFT JOIN items ON v.id = items.doc_id WHERE kind = 'd'
"""

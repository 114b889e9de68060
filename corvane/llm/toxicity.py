"""Toxicity by the nearest labelled examples under exact TF-IDF cosine (operator 9).

Terms are lower-cased words, their beginnings of STEMS characters (marked `*`; words that are longer only), and each of
these again (marked `+`) where it stands at least REPEATED times in the text. The vocabulary is every term of a bounded
sample of labelled rows: at most EXAMPLES rows in order of a hash of doc_id, of at most EXAMPLE_BYTES bytes together and a
sixteenth of that each. Document frequencies of all its terms are counted over all documents. A text's vector holds every
vocabulary term it has, with weight (1 + ln tf) * idf * relevance; relevance is 1 for a term that surely stands with the
label in the sample and falls to PLAIN, never to 0, for one that tells nothing (by the log-likelihood ratio).

The sample's vectors (unit length) stand in an inverted index whose postings are cut into blocks of BLOCK examples, each
with the largest weight of each term. A query sums the block maxima, scores the blocks with the highest bounds, and then
those whose bound reaches the K-th best cosine so far: the K nearest are exact. The DENSE commonest terms, which hardly any
block lacks, have a full table instead, by which queries are multiplied together; what it gives goes into the bounds. The
K nearest vote with weight 1 / (1.05 - cosine), the sample's rate being a further vote; votes are calibrated by isotonic regression on the sample. Examples whose text is
the scored text itself are left out, in calibration and in scoring alike, so that no label is an input of its own score.
Neighbours and the heaviest terms are the evidence.

Vocabulary and index are built by one task from the sample and broadcast as bytes, both bounded by the sample; each Python
worker unpacks them once. Rows whose
crc32(doc_id as text) mod 5 is 0 are never learned from. Scores depend on the text alone.

Defined results: a text without vocabulary terms (empty and null ones too) has no neighbour, and its vote is the sample's
rate; a very long text is one vector like others, held with its batch; without labels every score is 0; repeated rows
score alike; of several texts of a labelled doc_id the smallest is learned; labels with null parts are ignored, and of
several labels of a doc_id the largest counts; an empty table gives an empty result; further columns of documents are
ignored by score() and kept by drop_toxic().
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collect_garbage, kept, map_batches, slices, stage, table, trim, unstage
from .decontaminate import FOLD
from .token_store import _spread

EXAMPLES, EXAMPLE_BYTES, K, BLOCK = 4_000, 64 << 20, 25, 256
STEMS = (5,)
REPEATED = 3
#: Relevance of a term that tells nothing, and the log-likelihood ratio at which relevance is a half.
PLAIN, TELLING = 0.1, 20.0
CHUNK, PART = 1 << 14, 4 << 20
#: Terms whose weights stand in a full table, and queries multiplied by it at a time.
DENSE, QUERIES = 768, 256
_STAR, _PLUS, _NONE = (pa.scalar(x, pa.large_string()) for x in ("*", "+", ""))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


# ---- terms ----------------------------------------------------------------------------------------------------------
def words_in(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Document of each word, its place among the distinct words, and the distinct words' terms by kind: the word, and for
    each of STEMS its beginning, null where it is not longer."""
    raw = [(t or "").lower().encode() for t in texts]
    ends = np.cumsum([0, *(len(r) + 1 for r in raw)], dtype=np.int64)
    blob = b"".join(r + b" " for r in raw).translate(FOLD)
    lines = pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(blob)])
    lists = pc.split_pattern(lines, pattern=" ")
    coded = lists.values.dictionary_encode()
    doc = np.repeat(np.arange(len(raw)), np.diff(lists.offsets.to_numpy()))
    which, distinct = coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(distinct, "").as_py()
    some = which != empty
    length = pc.utf8_length(distinct)
    kinds = [distinct, *(pc.if_else(pc.greater(length, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(distinct, 0, k), _STAR, _NONE), pa.scalar(None, pa.large_string())) for k in STEMS)]
    return doc[some], which[some], kinds


def counts_of(texts: list[str | None], known: pa.Array, plus: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in `known` and count of each term, in this order. plus: each term's place with +, or -1."""
    doc, which, kinds = words_in(texts)
    if not len(known) or not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    places = [pc.index_in(k, value_set=known).fill_null(-1).to_numpy().astype(np.int64) for k in kinds]
    keys = []
    for place in places:
        term = place[which]
        keys.append((doc * np.int64(len(known)) + term)[term >= 0])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    doc, term = np.divmod(key, len(known))
    again = np.flatnonzero((n >= REPEATED) & (plus[term] >= 0))
    doc, term, n = np.concatenate([doc, doc[again]]), np.concatenate([term, plus[term[again]]]), np.concatenate([n, np.ones(len(again), n.dtype)])
    order = np.lexsort((term, doc))
    return doc[order], term[order], n[order].astype(float)


class Sample:
    """The vocabulary of the examples and their counts."""

    def __init__(self, texts: list[str | None]):
        parts = [texts[i : i + 256] for i in range(0, len(texts), 256)]
        kinds = [pc.unique(pa.concat_arrays([k.drop_null() for k in words_in(p)[2]])) for p in parts]
        plain = pc.unique(pa.concat_arrays(kinds)) if kinds else pa.array([], pa.large_string())
        plain = plain.filter(pc.not_equal(plain, "")).sort()
        counted = [counts_of(p, plain, np.full(len(plain), -1)) for p in parts]
        self.doc = np.concatenate([np.zeros(0, np.int32), *((d + 256 * i).astype(np.int32) for i, (d, _, _) in enumerate(counted))])
        self.term = np.concatenate([np.zeros(0, np.int32), *(t.astype(np.int32) for _, t, _ in counted)])
        self.n = np.concatenate([np.zeros(0), *(n for _, _, n in counted)])
        del counted
        again = np.flatnonzero(self.n >= REPEATED)
        more = np.unique(self.term[again])
        self.known = pa.concat_arrays([plain, pc.binary_join_element_wise(plain.take(pa.array(more)), _PLUS, _NONE)])
        self.plus = np.full(len(self.known), -1, np.int32)
        self.plus[more] = len(plain) + np.arange(len(more))
        doc, term = np.concatenate([self.doc, self.doc[again]]), np.concatenate([self.term, self.plus[self.term[again]]])
        order = np.lexsort((term, doc))
        self.doc, self.term, self.n = doc[order], term[order], np.concatenate([self.n, np.ones(len(again))])[order]
        self.size = len(texts)


def relevance(sample: Sample, labels: np.ndarray) -> np.ndarray:
    """Of each term: PLAIN to 1, by the log-likelihood ratio of its being commoner among examples with the label."""
    size = len(sample.known)
    up = np.bincount(sample.term, weights=labels[sample.doc].astype(float), minlength=size)
    n = np.bincount(sample.term, minlength=size).astype(float)
    all_, all_up = float(len(labels)), float(labels.sum())
    down, all_down = n - up, all_ - all_up

    def part(x, total, of):  # x * log(observed / expected)
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(n * total / of, 1e-12)), 0.0)

    def rest(x, total, of):
        y = total - x
        return np.where(y > 0, y * np.log(np.maximum(y, 1e-12) / np.maximum((of - n) * total / of, 1e-12)), 0.0)

    ratio = 2 * (part(up, all_up, all_) + part(down, all_down, all_) + rest(up, all_up, all_) + rest(down, all_down, all_))
    ratio = np.where(up * all_down > 2 * down * all_up, np.maximum(ratio, 0), 0.0)
    return PLAIN + (1 - PLAIN) * ratio**2 / (ratio**2 + TELLING**2)


# ---- the index ------------------------------------------------------------------------------------------------------
class Index:
    """Block-max inverted index over unit vectors; exact k nearest by cosine."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, block: int = BLOCK, dense: int = DENSE):
        """Vectors of n examples as rows (doc, term, weight), in order of doc and term."""
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        # examples with alike vectors share blocks, which makes the bounds sharp: by their heaviest term, then by their
        # commonest one, which tells languages apart
        often = np.bincount(term, minlength=n_terms)
        heaviest, commonest = np.full(n, -1), np.full(n, -1)
        o = np.lexsort((-term, weight))
        heaviest[doc[o]] = term[o]
        o = np.lexsort((-term, often[term]))
        commonest[doc[o]] = term[o]
        shared = np.where(heaviest >= 0, often[np.maximum(heaviest, 0)], 0)
        alone = shared <= n // 100
        #: Example at each place.
        self.order = np.lexsort((np.arange(n), heaviest, commonest, np.where(alone, -1, heaviest)))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        at = place[doc]
        common = np.lexsort((np.arange(n_terms), -often))[:dense]
        common = common[often[common] > max(4, n // 100)]
        #: Row of each common term in a full table of weights, or -1.
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        full = self.row[term] >= 0
        self.rows = len(common)
        self.filled = self.row[term[full]].astype(np.int32), at[full].astype(np.int32), weight[full]
        self._table = None
        at, term, weight = at[~full], term[~full], weight[~full]
        o = np.lexsort((at, term))
        at, term, weight = at[o], term[o], weight[o]
        self.at, self.weight = at.astype(np.int32), weight
        entry = term * np.int64(self.blocks) + at // block
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
        #: For each other term and block that has it: the block, its largest weight, its postings.
        self.entry_block = (at[first] // block).astype(np.int32)
        most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        self.entry_most = np.nextafter(most.astype(np.float32), np.float32(2))  # rounded up: still a bound
        self.entry_start, self.entry_size = first.astype(np.int32), np.diff(np.append(first, len(entry))).astype(np.int32)
        self.term_start = np.searchsorted(term[first], np.arange(n_terms + 1))

    @property
    def table(self) -> np.ndarray:
        """Weights of the common terms, built where it is used."""
        if self._table is None:
            self._table = np.zeros((self.rows, self.blocks * self.block))
            self._table[self.filled[0], self.filled[1]] = self.filled[2]
        return self._table

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n queries, given as rows in order of doc: cosines and examples, best first, ties by example; only cosines
        above 0. skip: examples that a query leaves out."""
        for lo in range(0, n, QUERIES):
            hi = min(n, lo + QUERIES)
            a, b = np.searchsorted(doc, (lo, hi))
            d, t, w = doc[a:b] - lo, term[a:b], weight[a:b]
            full = self.row[t] >= 0
            dense = np.zeros((hi - lo, len(self.table)))
            dense[d[full], self.row[t[full]]] = w[full]
            sums = dense @ self.table
            d, t, w = d[~full], t[~full], w[~full]
            cuts = np.searchsorted(d, np.arange(hi - lo + 1)).tolist()
            for i in range(hi - lo):
                own = slice(cuts[i], cuts[i + 1])
                yield self._nearest(sums[i], t[own], w[own], k, skip[lo + i])

    def _nearest(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip) -> tuple[np.ndarray, np.ndarray]:
        """scores: of all places by the common terms alone, which are bounds from below."""
        out = np.flatnonzero(np.isin(self.order, skip)) if len(skip) else None
        if out is not None:
            scores[out] = 0
        start = self.term_start.take(terms)
        sizes = self.term_start.take(terms + 1) - start
        entries, w = _spread(start, sizes), np.repeat(weights, sizes)
        block = self.entry_block.take(entries)
        bounds = scores.reshape(-1, self.block).max(axis=1) + np.bincount(block, weights=w * self.entry_most.take(entries), minlength=self.blocks)
        seen = np.zeros(self.blocks, bool)
        least = np.partition(scores, -k)[-k] if self.n > k else 0.0
        for most in (1 + 2 * k // self.block, self.blocks):
            todo = ~seen & (bounds >= max(least - 1e-9, 1e-15))
            if most < todo.sum():
                todo[np.argsort(np.where(todo, -bounds, 1), kind="stable")[most:]] = False
            seen |= todo
            some = np.flatnonzero(todo.take(block))
            if len(some):
                e = entries.take(some)
                size = self.entry_size.take(e)
                postings = _spread(self.entry_start.take(e), size)
                scores += np.bincount(self.at.take(postings), weights=np.repeat(w.take(some), size) * self.weight.take(postings), minlength=len(scores))
                if out is not None:
                    scores[out] = 0
                least = np.partition(scores, -k)[-k] if self.n > k else 0.0
        top = np.flatnonzero(scores >= max(least - 1e-9, 1e-15))
        found, cosines = self.order[top], np.round(scores[top], 9)
        best = np.lexsort((found, -cosines))[:k]
        return cosines[best], found[best]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing fit of y by x, blocks pooled until their means rise."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        if pools and pools[-1][3] == x[i]:
            p = pools[-1]
            p[0], p[1], p[2] = p[0] + y[i], p[1] + 1, p[2] + x[i]
        else:
            pools.append([float(y[i]), 1.0, float(x[i]), float(x[i])])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            p = pools[-1]
            p[0], p[1], p[2], p[3] = p[0] + last[0], p[1] + last[1], p[2] + last[2], last[3]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.05) / (p[1] + 0.1) for p in pools])


def digest(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode(), digest_size=16).digest()


class Model:
    """What is broadcast: vocabulary, idf, relevance, index of examples, calibration."""

    def __init__(self, sample: Sample, ids: list[int], texts: list[str | None], labels: np.ndarray, df: np.ndarray, n_docs: int, k: int = K):
        self.known, self.plus, self.k = sample.known, sample.plus, k
        self.factor = (np.log((n_docs + 1) / (df + 1)) + 1) * relevance(sample, labels)
        self.ids, self.labels = np.array(ids, np.int64), labels.astype(np.int64)
        self.base = (float(labels.sum()) + 0.5) / (len(labels) + 1)
        self.copies: dict[bytes, list[int]] = {}
        for i, t in enumerate(texts):
            self.copies.setdefault(digest(t), []).append(i)
        self.index = Index(sample.doc, sample.term, self.weigh(sample.doc, sample.term, sample.n, sample.size), sample.size, len(self.known))
        self.knots = (np.array([0.0]), np.array([0.0]))

    def weigh(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
        w = (1 + np.log(n)) * self.factor[term]
        return w / np.sqrt(np.bincount(doc, weights=w * w, minlength=docs))[doc]

    def vote(self, cosines: np.ndarray, found: np.ndarray) -> float:
        w = 1 / (1.05 - np.minimum(cosines, 1.0))
        return float((self.base + w @ self.labels[found]) / (1.0 + w.sum()))

    def found(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: cosines and examples of its neighbours, without examples of the same text; its heaviest terms."""
        doc, term, n = counts_of(texts, self.known, self.plus)
        weight = self.weigh(doc, term, n, len(texts))
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        skip = [self.copies.get(digest(t), ()) for t in texts]
        for i, (cosines, found) in enumerate(self.index.nearest(doc, term, weight, len(texts), self.k, skip)):
            own = slice(cuts[i], cuts[i + 1])
            yield cosines, found, term[own][np.argsort(-weight[own], kind="stable")[:5]]

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: score, and what is found."""
        x, y = self.knots
        for cosines, found, heaviest in self.found(texts):
            raw = self.vote(cosines, found)
            # a hundredth of the raw vote keeps the order within a pooled block
            yield min(1.0, max(0.0, 0.99 * float(np.interp(raw, x, y)) + 0.01 * raw)), cosines, found, heaviest


def sample_of(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, most_bytes: int = EXAMPLE_BYTES) -> DataFrame:
    """doc_id, text, toxic of the examples: at most so many rows and about so many bytes. Staged."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    order = F.xxhash64(F.lit(9), "doc_id")
    drawn = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(order, "doc_id").limit(examples)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 16)
    texts = stage(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).withColumn("key", order), "examples")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > most_bytes:  # whole rows, by the hash
        texts = texts.where(F.col("key") < F.lit(int(most_bytes / total * (1 << 64)) - (1 << 63)))
    return texts.drop("key")


def _built(examples: DataFrame, build: Callable[[list, list, np.ndarray], object]) -> bytes | None:
    """What one task builds of all examples (ids, texts, labels, in order of id), packed; the driver sees the bytes only. None
    without examples."""

    def run(batches):
        rows = pa.Table.from_batches(list(batches)).sort_by("doc_id") if (batches := [b for b in batches if b.num_rows]) else None
        if rows is not None:
            made = build(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), np.array(rows.column("toxic"), dtype=np.int64))
            packed = zstandard.compress(pickle.dumps(made, protocol=5), 1)
            del rows, made
            trim()
            for i in range(0, len(packed), PART):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([packed[i : i + PART]], pa.binary())], names=["at", "data"])

    parts = examples.select("doc_id", "text", "toxic").coalesce(1).mapInArrow(run, "at long, data binary").collect()
    return b"".join(bytes(r["data"]) for r in sorted(parts, key=lambda r: r["at"])) or None


class Shared:
    """Something packed, broadcast; each Python worker unpacks it once."""

    def __init__(self, spark: SparkSession, packed: bytes):
        self.key, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(packed)

    def value(self):
        return kept(self.key, lambda: pickle.loads(zstandard.decompress(self.held.value)))


class Fitted(NamedTuple):
    """A model, packed and broadcast, and its calibration; None without examples."""

    shared: Shared | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def model(self) -> Model | None:
        """In a worker."""
        if self.shared is None:
            return None
        model = self.shared.value()
        model.knots = self.knots
        return model


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = K) -> Fitted:
    spark = docs.sparkSession
    rows = sample_of(docs, labels, examples)

    def vocabulary(ids, texts, labels):
        sample = Sample(texts)
        return sample.known, sample.plus

    packed = _built(rows, vocabulary)
    if packed is None:
        unstage(rows)
        return Fitted(None, None)
    terms = Shared(spark, packed)

    def frequencies(batches):
        known, plus = terms.value()
        df, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for part in slices(batch):
                _, term, _ = counts_of(part.column("text").to_pylist(), known, plus)
                df += np.bincount(term, minlength=len(known))
                n += part.num_rows
        trim()
        if n:
            for at in range(0, len(df) or 1, CHUNK):
                some = df[at : at + CHUNK]
                own = np.flatnonzero(some)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n if not at else 0], pa.int64()), pa.array([own.astype(np.int32)], pa.list_(pa.int32())), pa.array([some[own]], pa.list_(pa.int64()))], names=["at", "n", "term", "df"])

    found = docs.select("text").mapInArrow(frequencies, "at long, n long, term array<int>, df array<long>")

    def add(pdf):
        import pandas as pd

        df = np.zeros(CHUNK, np.int64)
        for t, n in zip(pdf["term"], pdf["df"], strict=True):
            df[t] += n
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "n": [pdf["n"].sum()], "df": [df.tobytes()]})

    sums = found.groupBy("at").applyInPandas(add, "at long, n long, df binary").collect()  # eight bytes a term of the vocabulary
    n_docs = sum(r["n"] for r in sums)
    df = np.frombuffer(b"".join(bytes(r["df"]) for r in sorted(sums, key=lambda r: r["at"])), np.int64)
    known_df = spark.sparkContext.broadcast(df)

    def model(ids, texts, labels):
        sample = Sample(texts)
        return Model(sample, ids, texts, labels, known_df.value[: len(sample.known)], n_docs, k)

    shared = Shared(spark, _built(rows, model))
    n = rows.count()

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "vote": [shared.value().vote(c, f) for c, f, _ in shared.value().found(batch.column("text").to_pylist())]}

    parts = max(1, min(n // 256, 2 * spark.sparkContext.defaultParallelism))
    votes = sorted(tuple(r) for r in map_batches(rows.repartition(parts), make, "doc_id long, vote double, toxic int").collect())  # a row an example
    terms.held.destroy()
    known_df.destroy()
    unstage(rows)
    collect_garbage(spark)
    return Fitted(shared, isotonic(np.array([v for _, v, _ in votes]), np.array([float(y) for _, _, y in votes])))


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, neighbours (doc_ids), cosines, votes (their labels), matched (heaviest terms)."""

    def make():
        model = fitted.model()

        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": batch.column("doc_id"), "score": [], "neighbours": [], "cosines": [], "votes": [], "matched": []}
            if model is None:
                return out | {"score": [0.0] * batch.num_rows} | {c: [[]] * batch.num_rows for c in ("neighbours", "cosines", "votes", "matched")}
            for s, cosines, found, terms in model.score(batch.column("text").to_pylist()):
                out["score"].append(s)
                out["neighbours"].append(model.ids[found[:5]])
                out["cosines"].append(cosines[:5])
                out["votes"].append(model.labels[found[:5]])
                out["matched"].append(terms)
            ends = np.cumsum([0, *map(len, out["matched"])])
            names = model.known.take(pa.array(np.concatenate([np.zeros(0, np.int64), *out["matched"]])))
            out["matched"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.cast(pa.string()))
            return out

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double, neighbours array<long>, cosines array<double>, votes array<int>, matched array<string>")


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The documents that score below `most`, with all their columns."""
    fitted = fit(docs, labels)

    def run(batches):
        model = fitted.model()
        for batch in batches:
            for part in slices(batch):
                scores = [s for s, *_ in model.score(part.column("text").to_pylist())] if model else [0.0] * part.num_rows
                yield part.filter(pa.array([s < most for s in scores], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines", "votes", "matched")

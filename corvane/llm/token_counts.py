"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary (operator 5).

An Aho-Corasick automaton of the vocabulary's pieces enumerates all matches in a text; dynamic programming over its
characters carries the best score and the number of pieces of the path that has it, and no path. Rules are those of the
unigram tokenizer: matches that end at one place are tried from the longest to the shortest and only a strictly better
score wins; a character that is no piece by itself may also be unknown, at 10 below the lowest score; unknown characters
become their UTF-8 bytes if the vocabulary has byte pieces, else a run of them is one token.

The vocabulary is a SentencePiece model file (its path is a parameter); pieces and scores are read as a unigram model,
whatever the model was trained as. Spaces become U+2581, one more stands before the text, and no other normalisation is
made. As no piece holds U+2581 after another character, paths never cross a U+2581 that follows another character; texts
are cut there and equal cuts are counted once while they are remembered. Scores that are whole numbers, as in the
default file, are summed exactly.

Defined results: null and empty texts have no tokens and score 0; repeated rows count alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces with scores; whether unknown characters fall back to bytes."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        import ahocorasick

        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on after a space; texts can't be cut at spaces")
        self.pieces, self.byte_fallback = pieces, byte_fallback
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.found = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.found.add_word(p, (len(p), score))
        self.found.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        return cls(normal, sum(model.is_byte(i) for i in ids) == 256)

    def count(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best path over the whole text, as it is."""
        n = len(text)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        unknown = [False] * (n + 1)  # does the best path to here end in an unknown character?
        done = 0
        best, count, single = None, 0, False

        def close(end: int) -> None:
            """No further match ends here."""
            nonlocal best, count, single
            if not single:
                tried = score[end - 1] + self.unknown
                if best is None or tried > best:
                    best, unknown[end] = tried, True
                    if self.byte_fallback:
                        count = pieces[end - 1] + len(text[end - 1].encode())
                    else:
                        count = pieces[end - 1] + (not unknown[end - 1])
            score[end], pieces[end] = best, count
            best, count, single = None, 0, False

        for at, (length, gain) in self.found.iter(text):
            while done < at:
                done += 1
                close(done)
            start = at + 1 - length
            tried = score[start] + gain
            if best is None or tried > best:
                best, count = tried, pieces[start] + 1
            if length == 1:
                single = True
        while done < n:
            done += 1
            close(done)
        return pieces[n], score[n]


class Counter:
    """Counts of many texts; what a cut counts is remembered."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 600_000):
        self.vocabulary, self.remember = vocabulary, remember
        self.known: dict[str, tuple[int, float]] = {}

    def _of(self, word: str) -> tuple[int, float]:
        """A word after its space."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.remember:
                self.known.clear()
            found = self.vocabulary.count(MARK + word)
            if len(word) < 64:
                self.known[word] = found
        return found

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        n, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        odd = [bool(t) and ("  " in t or t[0] == " " or MARK in t) for t in texts]
        for i, t in enumerate(texts):
            if odd[i]:
                for cut in re.findall(f"{MARK}+[^{MARK}]*", MARK + t.replace(" ", MARK)):
                    a, b = self._of(cut[1:])
                    n[i] += a
                    score[i] += b
        plain = [i for i, t in enumerate(texts) if t and not odd[i]]
        if plain:
            lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), pattern=" ")
            coded = lists.values.dictionary_encode()
            found = [self._of(w) for w in coded.dictionary.to_pylist()]
            which, starts = coded.indices.to_numpy(), lists.offsets.to_numpy()[:-1]
            n[plain] = np.add.reduceat(np.array([a for a, _ in found])[which], starts)
            score[plain] = np.add.reduceat(np.array([b for _, b in found])[which], starts)
        return n, score


_COUNTERS: dict[str, Counter] = {}


def kept_counter(path: str) -> Counter:
    """One in each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Vocabulary.read(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, score."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def make():
        counter = kept_counter(path)

        def run(batch: pa.RecordBatch) -> dict:
            n, score = counter(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "score": score}

        return run

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_tokens long, score double")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))

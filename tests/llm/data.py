"""Small documents with everything that may go wrong, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

#: Further columns with names that operators use themselves.
EXTRA = "k long, h long, n long, name string, size string, node string, term string, copies int, target double, score string, b binary, value_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", "Thor", "idiot,", "être", "naïve.", "x1", "don't", "日本", "a", "stone", "river", "long", "word\nline", "ABC"]) + (str(rng.randint(0, 60)) if rng.random() < 0.7 else "") for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """doc_id, text, source"""
    base = words(1, 120)
    other = words(2, 300)
    near = base.split(" ")
    near[60] = "changed"
    nearer = list(near)
    nearer[100] = "again"
    passage = words(3, 70)
    return [
        (5, base, "b"), (1, base, "a"), (9, " ".join(near), "b"), (12, " ".join(nearer), "b"), (3, other, "c"), (4, "", "a"), (7, None, "a"), (8, " \n\t ", None),
        (10, f"{words(4, 50)} {passage} {words(5, 20)}", "a"), (11, f"{words(6, 5)} {passage}", "b"), (2, "one two three", "c"), (13, "ONE two THREE", None), (14, "one two three four five six", "b"),
        (20, words(7, 20_000), "a"), (21, "a" * 5000, "a"), (22, "ab " * 700, "c"), (23, "x  double  space\n\n\nlines ", "b"), (30, words(8, 40), "b"), (30, words(8, 40), "b"), (31, base.upper(), "c"),
        (40, "idiot " * 3 + words(9, 30), "a"), (41, words(10, 200), "d"), (42, words(11, 200), "d"),
    ]


def frame(spark, rows=None, schema: str = SCHEMA):
    rows = texts() if rows is None else rows
    full = [(d, t, "en", s, len(t or ""), 1, 2, 3, "n", "s", "x", "t", 4, 0.5, "z", b"b", "v") for d, t, s in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def with_nulls():
    """Null doc_ids and sources too."""
    return [*texts(), (None, words(12, 80), None), (None, None, None), (None, words(12, 80), None)]


# ---- brute force ----------------------------------------------------------------------------------------------------
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_classes(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def repeats(rows: list[tuple[int | None, str | None]], length: int = 50):
    """(doc_id, bytes, removed, spans, digest) of each row."""
    raw = sorted(((-(1 << 63) if d is None else d, d, (t or "").encode()) for d, t in rows), key=lambda r: r[0])
    first: dict[bytes, int] = {}
    for key, _, b in raw:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], key)
    out = []
    for key, d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text: str | None, items: list[tuple[int | None, str | None]], window: int = 10):
    """Number of words, hit words, ids of items found."""
    w = WORD.findall((text or "").translate(LOWER))
    hit: set[int] = set()
    ids = set()
    for item, t in items:
        v = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(v) - window + 1) if v else 0):
            x = v[k : k + window]
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    ids.add(item)
    return len(w), len(hit), sorted(i for i in ids if i is not None)

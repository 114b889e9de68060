"""Document fingerprints after I-Match (operator 10), in DataFrame functions only.

A term is a run of ASCII digits, ASCII letters (lower-cased) and other characters from U+0080. The lexicon is the terms
whose inverse document frequency lies in a band: in at least LOW (and two) and at most HIGH of all documents; df is
counted over all of them. Its size is bounded by (distinct terms per document on average) / LOW. Randomised subsets of
the lexicon of two sizes (each term is in one with chance 1/64 or 1/512, by hash) give the fingerprint: of each
subset the document's distinct terms are sorted and hashed to 32 bits, an empty selection to nothing. Small subsets let
part of the fingerprint survive an edit of a long text, large ones say something of short texts. Likeness: equal non-empty
hashes divided by subsets that are non-empty in either. A text with nothing in any subset is known by the digest of the
text alone.

The lexicon is broadcast if it has at most BROADCAST_TERMS terms and joined by shuffle beyond that. Texts move once, to
their key; what the edit takes from the next document moves once more, cut to its length. The order of documents is found
on narrow rows in ranges, with the last of each range looking at the first of the next.

Defined results: null text counts as empty; order is by doc_id, null first, then by text hash; equal rows follow each
other; a single document is its own next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

LOW, HIGH = 0.002, 0.1
CHANCES = [64] * 12 + [512] * 12
BROADCAST_TERMS = 300_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Distinct terms."""
    return F.array_distinct(F.split(F.translate(text, UPPER, LOWER), SEPARATORS))


def lexicon_of(texts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """texts(text) -> term, mask: the band's terms with a bit for each subset that has them. Staged."""
    n = texts.count()
    found = texts.select(F.explode(terms(F.col("text"))).alias("term")).where("term != ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = found.where((F.col("df") >= F.lit(max(2.0, low * n))) & (F.col("df") <= F.lit(max(2.0, high * n))))
    mask = sum((F.when(F.pmod(F.xxhash64(F.lit(k), "term"), F.lit(c)) == 0, F.lit(1 << k)).otherwise(0) for k, c in enumerate(CHANCES)), F.lit(0))
    return stage(band.withColumn("mask", mask).where("mask != 0").select("term", "mask"), "lexicon")


def _hashes(ordered: Column) -> Column:
    """ordered: sorted distinct (term, mask). Four bytes of each subset, an empty string for an empty selection."""

    def one(k: int) -> Column:
        own = F.transform(F.filter(ordered, lambda x: x["mask"].bitwiseAND(F.lit(1 << k)) != 0), lambda x: x["term"])
        return F.substring(F.sha2(F.concat_ws(" ", own), 256), 1, 8)

    return F.replace(F.concat_ws(".", *[one(k) for k in range(len(CHANCES))]), F.lit(NOTHING), F.lit(""))


#: The first 32 bits of SHA-256 of an empty string.
NOTHING = "e3b0c442"
EMPTY = "." * (len(CHANCES) - 1)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    pairs = F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    same = F.size(F.filter(pairs, lambda z: (z["p"] == z["q"]) & (z["p"] != "")))
    either = F.size(F.filter(pairs, lambda z: (F.coalesce(z["p"], F.lit("")) != "") | (F.coalesce(z["q"], F.lit("")) != "")))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(same / F.nullif(either, F.lit(0)), F.lit(0.0)))


def with_next(keys: DataFrame) -> DataFrame:
    """keys(k, h, ...): distinct, with nk, nh: the next in order of (k, h), after the last the first. Staged."""
    ranged = stage(keys.repartitionByRange("k", "h").withColumn("part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("part").orderBy("k", "h")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("k", "h")).alias("first"))
    across = Window.orderBy("part")  # one row a range
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(across), F.min("first").over(Window.partitionBy()))).select("part", "after")
    led = ranged.withColumn("next", F.lead(F.struct("k", "h")).over(inner)).join(firsts, "part")
    led = led.withColumn("next", F.coalesce("next", "after"))
    return stage(led.select(*keys.columns, F.col("next.k").alias("nk"), F.col("next.h").alias("nh")), "order")


def fingerprint(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon = lexicon_of(docs, low, high)
    lexicon = F.broadcast(lexicon) if lexicon.count() <= BROADCAST_TERMS else lexicon
    lowest = -(1 << 63)
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(lowest))).withColumn("h", F.xxhash64(F.col("doc_id").isNull(), "text"))
    order = with_next(keyed.select("k", "h", F.length("text").alias("n")).groupBy("k", "h").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    # Used three times with the same columns (doc_id is carried along for that), so that its exchange is made once.
    rows = keyed.groupBy("k", "h").agg(F.first("text").alias("text"), F.first("doc_id").alias("doc_id"))
    # what each document gives to the one before it, cut to what that one takes
    taken = order.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.col("k").alias("pk"), F.col("h").alias("ph"), F.floor(F.col("n") / 4).cast("int").alias("take"), "copies")
    given = rows.join(taken, ["k", "h"]).select(F.col("pk").alias("k"), F.col("ph").alias("h"), "take", "copies", F.expr("left(text, take)").alias("given"), F.col("doc_id").alias("next_doc_id"))
    full = rows.join(given, ["k", "h"]).withColumn("n_chars", F.length("text").cast("long"))
    head = F.expr("left(text, cast(n_chars as int) - take)")
    # equal rows follow each other: all but the last of them take from their own text
    own = F.when(F.col("copies") > 1, F.concat(head, F.expr("left(text, take)")))
    full = full.withColumn("edited", F.concat(head, "given")).withColumn("own", own)
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")), F.struct(F.lit(2).alias("v"), F.col("own").alias("t")))
    words = full.select("k", "h", "doc_id", "next_doc_id", F.explode(versions).alias("x")).where("x.t IS NOT NULL")
    words = words.select("k", "h", "doc_id", "next_doc_id", F.col("x.v").alias("v"), F.explode(terms(F.col("x.t"))).alias("term"))
    found = words.join(lexicon, "term").groupBy("k", "h").agg(
        F.first("doc_id").alias("d"), F.first("next_doc_id").alias("nd"), *[F.collect_set(F.when(F.col("v") == v, F.struct("term", "mask"))).alias(f"s{v}") for v in range(3)]
    )
    none = F.array().cast("array<struct<term:string,mask:int>>")
    base = full.join(found, ["k", "h"], "left").select(
        "k", "h", "doc_id", "next_doc_id", "d", "nd", "copies", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"),
        F.sha2(F.col("own").cast("binary"), 256).alias("own_sha"), *[F.sort_array(F.coalesce(F.col(f"s{v}"), none)).alias(f"o{v}") for v in range(3)],
    )
    base = base.select("*", _hashes(F.col("o0")).alias("fp"), _hashes(F.col("o1")).alias("efp"), F.when(F.col("copies") > 1, _hashes(F.col("o2"))).alias("ofp")).drop("o0", "o1", "o2")
    base = base.withColumn("next_doc_id", F.coalesce("next_doc_id", "nd")).withColumn("doc_id", F.coalesce("doc_id", "d")).drop("d", "nd")
    for p, sha in (("fp", "text_sha"), ("efp", "sha"), ("ofp", "own_sha")):
        base = base.withColumn(p, F.when(F.col(p) == EMPTY, F.col(sha)).otherwise(F.col(p)))
    base = stage(base, "prints")
    after = order.select("k", "h", "nk", "nh").join(base.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("fp").alias("nfp")), ["nk", "nh"]).select("k", "h", "nfp")
    out = base.join(after, ["k", "h"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    last = F.col("copy") == F.col("copies")
    efp, nfp = F.when(last, F.col("efp")).otherwise(F.col("ofp")), F.when(last, F.col("nfp")).otherwise(F.col("fp"))
    return out.select(
        "doc_id", "n_chars", F.when(last, F.col("sha")).otherwise(F.col("own_sha")).alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        efp.alias("edited_fingerprint"), likeness(F.col("fp"), efp).alias("near_edited"), likeness(F.col("fp"), nfp).alias("near_next"), F.when(last, F.col("next_doc_id")).otherwise(F.col("doc_id")).alias("next_doc_id"),
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))

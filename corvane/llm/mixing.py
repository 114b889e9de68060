"""Mixing sources to target weights by Pareto order sampling (operator 7).

Targets: the words of all documents are shared among the sources in proportion to their weights; a source's target
stops at `most` times its own words, and the excess is shared again. The fixed point is found in closed form: with the
sources in order of most * words / weight, the first ones are capped and the others get weight * t.

Documents: each has a measure of its own (a weight column, or ln(e + words)), in steps of 1/LEVELS of an octave. Of a source,
a document with measure w is expected min(most, t * w) times; t makes the expected words the target and is found in closed
form from sums by level (levels are few), those whose share would pass `most` being capped and the rest shared again. The
whole copies floor(m) are certain. For the rest, documents are ranked by their random odds divided by their inclusion odds,
q = (u / (1 - u)) / (p / (1 - p)), u from a hash of doc_id, text and seed, and taken in that order until the source's
remaining words are reached. Nothing is sorted as a whole: q falls into buckets of about BUCKET_ROWS documents, sums of
buckets say in which the cut lies, and only that bucket is ordered. There, from the first document that no longer fits,
documents are still taken in order if they fit, and last the one that brings the sum nearer to the target.

Defined results: null text has size 0; the null source is a source of its own, last; equal rows are taken alike or, at
the cut, in any order; ties of q go by doc_id and size; a very long text is one document, which fits or does not; a null,
negative or NaN measure is 0, and what such a document would take others of its source take, as far as `most` allows; a
source without words has target 0; an empty table gives an empty result; further columns are ignored by mix() and kept by
mixed().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, words_of

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKET_ROWS, LEVELS = 4096, 16


def targets_of(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) -> with weight and target. One row a source, so the windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rest, all_ = by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # the level if this source and those after it are not capped; it holds for the first source whose ratio reaches it
    s = s.withColumn("level", (F.sum("source_size").over(all_) - F.col("capped")) / F.sum("weight").over(rest))
    s = s.withColumn("t", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(all_)["level"])
    return s.select("source", "source_size", "weight", F.when(F.col("t").isNull() | (F.col("ratio") < F.col("t")), F.col("cap")).otherwise(F.col("weight") * F.col("t")).alias("target"))


def _expected(levels: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """levels(source, _level, size, n), known(source, source_size, target, n) -> known with _level and m, how often a document
    of this level is expected: min(most, t * measure), with the words of all levels at the target."""
    w = F.when(F.col("_level").isNull(), 0.0).otherwise(F.pow(F.lit(2.0), F.col("_level") / LEVELS))
    x = levels.alias("l").join(known.alias("k"), F.expr("l.source <=> k.source")).select("k.source", "k.source_size", "k.target", "k.n", "l._level", "l.size").withColumn("w", w)
    by = Window.partitionBy("source").orderBy(F.desc("w"))  # a row a level
    x = x.withColumn("before", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the factor if the levels above this one are at most and the others are not; it holds for the first that stays below
    x = x.withColumn("t", F.try_divide(F.col("target") - most * F.col("before"), F.sum(F.col("w") * F.col("size")).over(by.rowsBetween(0, Window.unboundedFollowing))))
    x = x.withColumn("t", F.max(F.when((F.col("t") * F.col("w") <= most) & (F.col("w") > 0), F.struct(F.col("w").alias("at"), "t"))).over(Window.partitionBy("source")))
    m = F.when(F.col("w") == 0, 0.0).when(F.col("t").isNull() | (F.col("w") > F.col("t.at")), F.lit(float(most))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("t.t") * F.col("w"))))
    return x.select("source", "_level", "source_size", "target", "n", F.when(F.col("source_size") > 0, m).otherwise(0.0).alias("m"))


def _mix(docs: DataFrame, weights, most: int, seed: int, weight_col: str | None, keep: list[str]) -> DataFrame:
    """With the columns in keep as k_<name>."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    size = words_of("text")
    own = F.coalesce(F.nanvl(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.log(F.lit(float(np.e)) + size)
    level = F.when(own > 0, F.floor(F.log2(own) * LEVELS).cast("int"))  # null: never taken
    rows = docs.select("doc_id", "source", size.alias("_size"), u.alias("_u"), level.alias("_level"), *[F.col(c).alias(f"k_{c}") for c in keep])
    rows = stage(rows, "rows").withColumnRenamed("_size", "size")
    levels = stage(rows.groupBy("source", "_level").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "levels")
    sums = levels.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"))
    known = targets_of(sums.select("source", "source_size"), weights, most).alias("t").join(sums.alias("s"), F.expr("t.source <=> s.source")).selectExpr("t.source", "t.source_size", "target", "n")
    known = stage(known, "targets")
    expected = stage(_expected(levels, known, most), "expected")
    r = rows.alias("r").join(F.broadcast(expected).alias("k"), F.expr("r.source <=> k.source AND r._level <=> k._level")).select("r.*", "k.source_size", "k.target", "k.n", "k.m")
    r = r.withColumn("whole", F.floor("m").cast("int")).withColumn("p", F.col("m") - F.col("whole"))
    odds = F.col("_u") / (1 - F.col("_u")) * (1 - F.col("p")) / F.col("p")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    r = r.withColumn("q", F.when(F.col("p") > 0, odds / (1 + odds))).withColumn("bucket", F.floor(F.col("q") * buckets))
    by = Window.partitionBy("source").orderBy("bucket")
    cuts = r.groupBy("source", "bucket").agg(
        F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target")
    )
    cuts = cuts.withColumn("need", F.col("target") - F.sum("sure").over(Window.partitionBy("source"))).where("bucket IS NOT NULL")
    cuts = cuts.withColumn("to", F.sum("words").over(by)).withColumn("from", F.col("to") - F.col("words"))
    cuts = cuts.where("from < need").groupBy("source").agg(F.max_by(F.struct("bucket", (F.col("need") - F.col("from")).alias("gap")), "bucket").alias("c"))
    cuts = cuts.selectExpr("source source_c", "c.bucket at", "c.gap gap")
    r = r.join(cuts, F.expr("source <=> source_c"), "left").drop("source_c")
    kept = [f"k_{c}" for c in keep]
    r = r.select("doc_id", "source", "size", "source_size", "target", "whole", "q", "bucket", "at", "gap", *kept)
    sure = r.where("bucket IS NULL OR at IS NULL OR bucket != at").withColumn("more", F.coalesce((F.col("bucket") < F.col("at")).cast("int"), F.lit(0)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["q", "doc_id", "size"], kind="stable")
        gap, more = float(pdf["gap"].iloc[0]), np.zeros(len(pdf), dtype=np.int32)
        sizes = pdf["size"].to_numpy()
        for i, x in enumerate(sizes):
            if x <= gap:
                more[i], gap = 1, gap - x
        out = np.flatnonzero((more == 0) & (sizes < 2 * gap))
        if len(out):
            more[out[np.argmin(np.abs(sizes[out] - gap))]] = 1
        return pdf.assign(more=more)

    schema = r.withColumn("more", F.lit(0)).schema
    at_cut = r.where("bucket = at").groupBy("source").applyInPandas(fill, schema)
    out = sure.unionByName(at_cut).withColumn("copies", F.col("whole") + F.col("more"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *kept)


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7, weight_col: str | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, copies, taken."""
    return _mix(docs, weights, most, seed, weight_col, [])


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7, weight_col: str | None = None) -> DataFrame:
    """The documents that the mix takes, with all their columns, each as often as it is taken."""
    out = _mix(docs, weights, most, seed, weight_col, docs.columns).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
